"""Alert rules: conditions over five metrics, compiled to Columns.

A condition is an expression of these names, numbers, strings, and/or/not, comparisons, arithmetic, conditionals and the
functions abs, min, max, int, float, bool, round, str, len.  It is parsed, never executed as Python.
"""

from __future__ import annotations

import ast
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("new_template_count", "error_template_count", "spike_count", "total_templates", "processing_speed")
SEVERITY = {"critical": 3, "warning": 2, "info": 1}


class ConditionError(ValueError):
    """A condition that names something else: its rule is skipped."""


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: lambda a, b: F.when(b != 0, a - b * F.floor(a / F.nullif(b, F.lit(0)))), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)), ast.Pow: lambda a, b: F.pow(a, b)}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
_CALLS = {"abs": F.abs, "min": F.least, "max": F.greatest, "int": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)), "float": lambda x: x.cast("double"), "bool": lambda x: x.cast("boolean"), "round": lambda x, n=None: F.bround(x) if n is None else F.bround(x, n), "str": lambda x: x.cast("string"), "len": F.length}


def compiled(condition: str) -> Column:
    """The condition as a Column; null where Python would fail on types or divide by zero."""
    try:
        tree = ast.parse(condition, mode="eval").body
    except SyntaxError:
        return F.lit(False)

    def truth(x: Column | bool) -> Column:
        return x.cast("boolean") if isinstance(x, Column) else F.lit(bool(x))

    def walk(node: ast.AST) -> Any:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, bool, str)):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in METRICS:
                raise ConditionError(node.id)
            return F.col(node.id)
        if isinstance(node, ast.BoolOp):
            return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), [truth(walk(v)) for v in node.values])
        if isinstance(node, ast.UnaryOp):
            inner = walk(node.operand)
            return ~truth(inner) if isinstance(node.op, ast.Not) else -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.Compare):
            sides, out = [walk(x) for x in (node.left, *node.comparators)], None
            for op, a, b in zip(node.ops, sides, sides[1:], strict=False):
                if type(op) not in _COMPARE:
                    raise ConditionError(type(op).__name__)
                one = _COMPARE[type(op)](a, b)
                out = one if out is None else out & one
            return out
        if isinstance(node, ast.IfExp):
            return F.when(truth(walk(node.test)), walk(node.body)).otherwise(walk(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            if node.func.id == "round" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant):
                return F.bround(walk(node.args[0]), node.args[1].value)
            return _CALLS[node.func.id](*[walk(a) for a in node.args])
        raise ConditionError(ast.dump(node)[:60])

    return truth(walk(tree))


def interpolated(message: str, values: dict[str, Any]) -> str:
    """str.format over the metrics; where that fails, plain replacement of the names."""
    try:
        return message.format(**values)
    except (KeyError, IndexError, ValueError, AttributeError):
        return reduce(lambda m, kv: m.replace("{" + kv[0] + "}", str(kv[1])), values.items(), message)


def fired(metrics: DataFrame, rules: list[dict]) -> DataFrame:
    """(name, severity, condition, message_template, rank) of the rules that hold for the one row of ``metrics``, the most
    severe first, equal ones in their order; rules of forbidden names are skipped."""
    usable = []
    for rule in rules:
        try:
            usable.append((rule, compiled(rule["condition"])))
        except ConditionError:
            continue
    if not usable:
        return metrics.sparkSession.createDataFrame([], "name string, severity string, condition string, message_template string, rank int")
    made = [F.struct(F.lit(r["name"]).alias("name"), F.lower(F.lit(r.get("severity", "info"))).alias("severity"), F.lit(r["condition"]).alias("condition"), F.lit(r.get("message", "")).alias("message_template"), F.lit(i).alias("rank"), F.coalesce(c, F.lit(False)).alias("holds")) for i, (r, c) in enumerate(usable)]
    rows = metrics.select(F.explode(F.array(*made)).alias("r")).select("r.*").where("holds").drop("holds")
    weight = reduce(lambda acc, kv: acc.when(F.col("severity") == kv[0], kv[1]), SEVERITY.items(), F.when(F.lit(False), 0)).otherwise(0)
    return rows.orderBy(weight.desc(), "rank")


def triggered(metrics: DataFrame, rules: list[dict]) -> list[dict]:
    """The alerts with their messages, for reports."""
    row = metrics.first()
    values = {m: row[m] for m in METRICS}
    return [{"name": r.name, "severity": r.severity, "condition": r.condition, "message": interpolated(r.message_template, values), "variables": values} for r in fired(metrics, rules).collect()]


def metrics(templates: DataFrame, total_logs: int, seconds: float) -> DataFrame:
    """One row of the five metrics of flagged templates."""
    n = lambda c: F.count_if(F.col(c))
    speed = F.lit(float(total_logs) / max(seconds, 0.001))
    return templates.agg(n("is_new").alias("new_template_count"), n("is_error").alias("error_template_count"), n("is_spike").alias("spike_count"), F.count("*").alias("total_templates"), speed.alias("processing_speed"))


def identifiers(condition: str) -> set[str]:
    return set(re.findall(r"\b[A-Za-z_]\w*\b", condition))
