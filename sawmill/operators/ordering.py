"""Places in a total order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.plans.stored import stored


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` as a stored table with ``name``: 0, 1, ... in the given order.  Rows are dealt out by range and sorted within
    partitions; a partition's first place is the number of rows in those before it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id())
    dealt = stored(dealt, "ranked")
    part, place = F.shiftright("_k", 33).alias("_part"), F.col("_k").bitwiseAND((1 << 33) - 1)
    counts = sorted((r._part, r.n) for r in dealt.groupBy(part).agg(F.count("*").alias("n")).collect())
    base, before = [], 0
    for p, n in counts:  # a row for each partition
        base.append((p, before))
        before += n
    bases = df.sparkSession.createDataFrame(base, "_part bigint, _base bigint")
    out = dealt.join(F.broadcast(bases), F.shiftright("_k", 33) == F.col("_part"))
    return out.withColumn(name, (F.col("_base") + place).cast("bigint")).drop("_k", "_part", "_base")
