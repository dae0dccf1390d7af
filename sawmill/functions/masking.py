"""Masking of variable parts and tokenising, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.config import Section

WILDCARD, EMPTY = "<*>", "<EMPTY>"


def _guard(name: str, text: Column) -> Column:
    """A mask of these names applies only where its telling characters occur (for IP: a digit in the first 30)."""
    return {
        "IP": text.contains(".") & F.substring(text, 1, 30).rlike("[0-9]"), "NUM": text.rlike("[0-9]"), "UUID": text.contains("-"),
        "PATH": text.contains("/") | text.contains("\\"), "EMAIL": text.contains("@"),
    }.get(name, F.lit(True))


def mask(text: Column, name: str, pattern: str) -> Column:
    """``pattern`` replaced by ``<name>``, with Unicode word and digit classes; an invalid pattern changes nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return text
    # only classes that differ beyond ASCII need the Unicode flag
    flag = "(?U)" if re.search(r"\\[wWdDsSbB]", pattern) else ""
    return F.when(_guard(name, text), F.regexp_replace(text, flag + pattern, f"<{name}>")).otherwise(text)


def mask_all(df: DataFrame, column: str, options: Section) -> DataFrame:
    """``df`` with all masks applied to ``column`` in their order; each is a step of its own, so that none is repeated."""
    patterns = {p["name"]: p["regex"] for p in options.patterns}
    for name in options.order:
        if name in patterns:
            df = df.withColumn(column, mask(F.col(column), name, patterns[name]))
    return df


def tokenize(text: Column) -> Column:
    """White-space separated parts; ['<EMPTY>'] if there are none."""
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(EMPTY)))
