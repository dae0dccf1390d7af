"""New, failing and irregular templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSUFFICIENT = "数据点不足，无法进行频率分析（至少需要 {n} 个数据点）"


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def whitelisted(templates: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the templates that a pattern finds."""
    return templates.where(~any_match(F.col("template"), patterns)) if patterns else templates


def focused(templates: DataFrame, patterns: list[str]) -> DataFrame:
    """The templates that a pattern finds; all if there is none."""
    return templates.where(any_match(F.col("template"), patterns)) if patterns else templates


def new_templates(templates: DataFrame, baseline: DataFrame, match_ids: bool = True) -> DataFrame:
    """Templates whose text (and, with ``match_ids``, whose id) isn't in the baseline (template_id, template)."""
    out = templates.join(baseline.select("template").distinct(), "template", "left_anti")
    return out.join(baseline.select("template_id").distinct(), "template_id", "left_anti") if match_ids else out


def sufficiency(series: DataFrame, min_points: int = 24) -> DataFrame:
    """One row: templates with enough points, whether none has, and the message then."""
    n = series.groupBy("template_id").agg(F.count("*").alias("n"))
    enough = F.coalesce(F.sum((F.col("n") >= min_points).cast("bigint")), F.lit(0))
    return n.agg(enough.alias("enough"), (enough == 0).alias("data_insufficient"), F.when(enough == 0, INSUFFICIENT.format(n=min_points)).otherwise("").alias("message"))


def flagged(templates: DataFrame, series: DataFrame, baseline: DataFrame | None, whitelist: list[str], focus: list[str], match_ids: bool = True) -> DataFrame:
    """``templates`` with is_new, is_spike, is_vanished, is_periodic.  Whitelisted templates have no flags; only focused
    ones have those of the series; without a baseline every template is new."""
    t = templates.withColumn("_listed", any_match(F.col("template"), whitelist)).withColumn("_focus", any_match(F.col("template"), focus) if focus else F.lit(True))
    if baseline is None:
        t = t.withColumn("is_new", ~F.col("_listed"))
    else:
        fresh = new_templates(templates, baseline, match_ids).select("template_id", F.lit(True).alias("_fresh"))
        t = t.join(fresh, "template_id", "left").withColumn("is_new", F.coalesce("_fresh", F.lit(False)) & ~F.col("_listed")).drop("_fresh")
    flags = series.select("template_id", F.col("has_spike").alias("_s"), F.col("has_vanished").alias("_v"), F.col("is_periodic").alias("_p"))
    t = t.join(flags, "template_id", "left")
    on = lambda c: F.coalesce(c, F.lit(False)) & F.col("_focus") & ~F.col("_listed")
    t = t.withColumns({"is_spike": on(F.col("_s")), "is_vanished": on(F.col("_v")), "is_periodic": on(F.col("_p")), "is_error": F.col("is_error") & ~F.col("_listed")})
    return t.drop("_s", "_v", "_p", "_listed", "_focus")
