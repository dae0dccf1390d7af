"""Series of counts per template: tumbling buckets, gap filling, spikes, vanishing, periodicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"minute": 60, "hour": 3600, "day": 86400}


def bucket(ts: Column, unit: str = "hour") -> Column:
    """The begin of the minute, hour or day; another unit counts as hour."""
    return F.date_trunc(unit if unit in UNITS else "hour", ts).cast("timestamp_ntz")


def counts(events: DataFrame, unit: str = "hour") -> DataFrame:
    """(template_id, bucket, value) of events (template_id, ts)."""
    return events.where("ts is not null").groupBy("template_id", bucket(F.col("ts"), unit).alias("bucket")).agg(F.count("*").alias("value"))


#: Buckets of a series that are made, or correlated, as one row.
BLOCK = 4096


def _step(unit: str) -> int:
    return UNITS.get(unit, 3600) * 1_000_000


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def gap_filled(series: DataFrame, unit: str = "hour", until: Column | None = None) -> DataFrame:
    """Every bucket from a template's first to its last (or ``until``), zeros where there was none.  A long series is made
    a block at a time, so no row has all of it."""
    ends = series.groupBy("template_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    ends = ends.withColumn("z", F.greatest("z", until)) if until is not None else ends
    last = F.floor((_micros("z") - _micros("a")) / _step(unit)).cast("bigint")
    ends = ends.select("template_id", _micros("a").alias("a"), last.alias("last"))
    blocks = ends.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / BLOCK).cast("bigint"))))
    every = blocks.withColumn("i", F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("b") * BLOCK + (BLOCK - 1), "last"))))
    every = every.select("template_id", F.timestamp_micros(F.col("a") + F.col("i") * _step(unit)).cast("timestamp_ntz").alias("bucket"))
    return every.join(series, ["template_id", "bucket"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("bigint"))


def series_stats(filled: DataFrame) -> DataFrame:
    return filled.groupBy("template_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def spikes(filled: DataFrame, n_std: float = 3.0) -> DataFrame:
    """Buckets whose value exceeds mean + n_std deviations (of the population)."""
    stats = series_stats(filled)
    return filled.join(stats, "template_id").where(F.col("value") > F.col("mean") + n_std * F.col("std")).select("template_id", "bucket", "value", "mean", "std")


def vanished(filled: DataFrame, periods: int = 3) -> DataFrame:
    """Templates whose series ends with at least ``periods`` zeros, and since when."""
    last = filled.groupBy("template_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("value") > 0, F.col("bucket"))).alias("last_active"), F.max("bucket").alias("z"))
    tail = filled.join(last, "template_id").where("bucket > last_active").groupBy("template_id").agg(F.count("*").alias("zeros"), F.min("bucket").alias("vanished_since"))
    return tail.where(F.col("zeros") >= periods)


def autocorrelation(filled: DataFrame, max_lag: int = 48, unit: str = "hour", block: int = BLOCK) -> DataFrame:
    """(template_id, n, lag, value) for lags 1 to min(n div 2, max_lag) - 1; 0 for a constant series.

    A series is cut into blocks; the first values of a block also go to the blocks before it that a lag reaches, and each
    block gives a part of the sum of each lag.  So no row has more than a block and the largest lag.
    """
    stats = filled.groupBy("template_id").agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.min("bucket").alias("a"))
    at = filled.join(stats, "template_id").withColumn("i", F.floor((_micros("bucket") - _micros("a")) / _step(unit)).cast("bigint"))
    at = at.select("template_id", "n", "i", (F.col("value") - F.col("mu")).alias("d"))
    den = at.groupBy("template_id").agg(F.sum(F.col("d") * F.col("d")).alias("den"))
    first = F.floor(F.greatest(F.col("i") - max_lag, F.lit(0)) / block).cast("bigint")
    dealt = at.withColumn("b", F.explode(F.sequence(first, F.floor(F.col("i") / block).cast("bigint"))))
    cut = dealt.groupBy("template_id", "n", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("x"))
    lags = F.least(F.floor(F.col("n") / 2), F.lit(max_lag)) - 1
    parts = cut.where(lags >= 1).withColumn("lag", F.explode(F.sequence(F.lit(1), lags.cast("int"))))
    own = F.least(F.lit(block), F.size("x") - F.col("lag"))  # values of the block itself that have one a lag behind
    product = F.aggregate(F.zip_with(F.slice("x", F.lit(1), own), F.slice("x", F.col("lag") + 1, own), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sums = parts.groupBy("template_id", "n", "lag").agg(F.sum(F.when(own > 0, product)).alias("num"))
    value = F.when(F.col("den") == 0, 0.0).otherwise(F.col("num") / F.col("den"))
    return sums.join(den, "template_id").select("template_id", F.col("n").cast("int").alias("n"), "lag", value.alias("value"))


def periodicity(correlated: DataFrame, unit: str = "hour", min_points: int = 24) -> DataFrame:
    """(template_id, is_periodic, period_hours): the strongest inner peak above 0.3 (of equal ones the smallest lag), if
    above 0.5."""
    w = Window.partitionBy("template_id").orderBy("lag")
    peaks = correlated.withColumn("before", F.lag("value").over(w)).withColumn("after", F.lead("value").over(w))
    peak = (F.col("value") > F.col("before")) & (F.col("value") > F.col("after")) & (F.col("value") > 0.3) & (F.col("n") >= min_points)
    best = peaks.groupBy("template_id").agg(F.max(F.when(peak, F.struct("value", (-F.col("lag")).alias("neg")))).alias("best"))
    strong = F.coalesce(F.col("best.value") > 0.5, F.lit(False))
    return best.select("template_id", strong.alias("is_periodic"), F.when(strong, -F.col("best.neg") * UNITS.get(unit, 3600) / 3600.0).alias("period_hours"))


def analyze(events: DataFrame, unit: str = "hour", n_std: float = 3.0, periods: int = 3, min_points: int = 24, horizon: str = "template") -> DataFrame:
    """A row per template: n, mean, std, sufficient, spike_timestamps, has_spike, has_vanished, vanished_since, is_periodic,
    period_hours.  ``horizon``: 'template' ends each series at its own last bucket, where nothing can vanish; 'corpus' at
    the last bucket of all."""
    series = counts(events, unit)
    until = None
    if horizon == "corpus":
        last = series.agg(F.max("bucket").alias("z")).first().z
        until = F.lit(last).cast("timestamp_ntz") if last is not None else None
    filled = gap_filled(series, unit, until)
    stats = series_stats(filled).withColumn("sufficient", F.col("n") >= min_points)
    spiked = spikes(filled, n_std).groupBy("template_id").agg(F.array_sort(F.collect_list("bucket")).alias("spike_timestamps"))
    out = stats.join(spiked, "template_id", "left").join(vanished(filled, periods).select("template_id", "vanished_since"), "template_id", "left")
    out = out.join(periodicity(autocorrelation(filled, unit=unit), unit, min_points), "template_id", "left")
    flag = lambda c: F.col("sufficient") & c
    return out.select(
        "template_id", "n", "mean", "std", "sufficient", F.coalesce("spike_timestamps", F.array().cast("array<timestamp_ntz>")).alias("spike_timestamps"),
        flag(F.col("spike_timestamps").isNotNull()).alias("has_spike"), flag(F.col("vanished_since").isNotNull()).alias("has_vanished"), "vanished_since",
        flag(F.coalesce("is_periodic", F.lit(False))).alias("is_periodic"), "period_hours",
    )
