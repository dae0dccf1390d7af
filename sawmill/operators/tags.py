"""Hierarchical tags of templates by regex rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tags_of(text: Column, rules: list[dict]) -> Column:
    """The tags of every rule that finds something, in order, each once."""
    none = F.array().cast("array<string>")
    found = [F.when(text.rlike(r["pattern"]), F.array(*[F.lit(t) for t in r["tags"]])).otherwise(none) for r in rules if r["tags"]]
    return F.array_distinct(F.flatten(F.array(*found))) if found else none


def expanded(tags: Column) -> Column:
    """a/b/c as a, a/b, a/b/c; each once, in order."""
    parts = lambda t: F.split(t, "/")
    return F.array_distinct(F.flatten(F.transform(tags, lambda t: F.transform(F.sequence(F.lit(1), F.size(parts(t))), lambda i: F.array_join(F.slice(parts(t), F.lit(1), i), "/")))))


def filtered(templates: DataFrame, tag: str, hierarchical: bool = True) -> DataFrame:
    return templates.where(F.array_contains(expanded(F.col("tags")) if hierarchical else F.col("tags"), tag))


def tag_counts(templates: DataFrame) -> DataFrame:
    """Templates per tag and per ancestor of one."""
    return templates.select(F.explode(expanded(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def badges(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")
