"""Two template libraries compared: what came, went, rose and fell, and an exit code for a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_text(library: DataFrame) -> DataFrame:
    """One row per non-empty template text; of repeated ones the last (by ``rank``, else by id)."""
    order = "rank" if "rank" in library.columns else "template_id"
    last = F.row_number().over(Window.partitionBy("template").orderBy(F.desc(order)))
    return library.where("template <> ''").withColumn("_k", last).where("_k = 1").drop("_k")


def compare(old: DataFrame, new: DataFrame, spike_threshold: float = 2.0) -> DataFrame:
    """Full outer join of (template_id, template, count, is_error) by text: template_id (new, else old), counts,
    count_change, bucket (added, removed, increased, decreased, unchanged) and flags.

    count_change is (new - old) / old, infinity from 0 to more, else 0.  ``decreased`` needs a change of at most
    -spike_threshold, which thresholds over 1 never reach.
    """
    o, n = by_text(old), by_text(new)
    pick = lambda d, s: d.select("template", F.col("template_id").alias(f"id_{s}"), F.col("count").alias(f"c_{s}"), F.col("is_error").alias(f"e_{s}"))
    j = pick(o, "o").join(pick(n, "n"), "template", "full")
    old_n, new_n = F.coalesce("c_o", F.lit(0)), F.coalesce("c_n", F.lit(0))
    change = F.when(old_n > 0, (new_n - old_n) / old_n).when(new_n > 0, float("inf")).otherwise(0.0)
    up, down = (change >= spike_threshold) & (new_n > old_n), (change <= -spike_threshold) & (new_n < old_n)
    added, removed = F.col("id_o").isNull(), F.col("id_n").isNull()
    bucket = F.when(added, "added").when(removed, "removed").when(up, "increased").when(down, "decreased").otherwise("unchanged")
    error = F.coalesce("e_o", F.lit(False)) | F.coalesce("e_n", F.lit(False))
    spike = (added & (new_n > 0)) | (~added & ~removed & up)
    return j.select(
        F.coalesce("id_n", "id_o").alias("template_id"), "template", old_n.alias("count_old"), new_n.alias("count_new"), change.alias("count_change"), bucket.alias("bucket"),
        added.alias("is_new"), (removed | (~added & down)).alias("is_removed"), spike.alias("is_significant"), error.alias("is_error"),
    )


def exit_code(compared: DataFrame) -> DataFrame:
    """1 if an added template is an error, else 2 if one spikes, else 0; and the sizes of the buckets."""
    n = lambda c: F.count_if(c)
    bad, spike = n((F.col("bucket") == "added") & F.col("is_error")), n(F.col("is_significant"))
    sizes = [n(F.col("bucket") == b).alias(b) for b in ("added", "removed", "increased", "decreased", "unchanged")]
    return compared.agg(F.when(bad > 0, 1).when(spike > 0, 2).otherwise(0).alias("exit_code"), bad.alias("new_error_templates"), spike.alias("spike_templates"), *sizes)
