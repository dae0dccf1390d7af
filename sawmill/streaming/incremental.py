"""Mining as a stream: each micro-batch is matched against the templates so far, and the state grows by a version.

The state is a ``StateStore``; the name of a version's batch is the micro-batch's number, so a batch that runs again after a
failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sawmill.config import Settings
from sawmill.plans.analyze import advance_state, mine_batch
from sawmill.sources.lines import parsed
from sawmill.sources.state import TEMPLATES, StateStore, merged_templates


def advance(state: DataFrame, lines: DataFrame, settings: Settings) -> DataFrame:
    """The whole state (``TEMPLATES``) after a batch of parsed lines (seq, ts, level, source, message), without merging.
    ``state`` is a stored table: it is read several times."""
    last = state.agg(F.coalesce(F.max(F.substring("template_id", 2, 18).cast("bigint")), F.lit(0)).alias("n")).first().n
    mined = mine_batch(lines, settings, False, state, last)
    columns = [c.split()[0] for c in TEMPLATES.split(", ")]
    both = state.select(*columns, F.lit(0).cast("bigint").alias("version")).unionByName(mined.increments.select(*columns, F.lit(1).cast("bigint").alias("version")))
    return merged_templates(both)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TEMPLATES)


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The templates of the newest version of a stored state."""
    return StateStore(spark, path).templates()


def numbered(df: DataFrame, path_col: str = "path", position_col: str = "position") -> DataFrame:
    """``df`` with seq, which follows paths and positions: files are numbered (a row a file), never lines."""
    from pyspark.sql import Window

    ends = df.groupBy(path_col).agg((F.max(position_col) + 1).alias("_size"))
    before = Window.orderBy(path_col).rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(path_col, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return df.join(bases, path_col).withColumn("seq", (F.col("_base") + F.col(position_col)).cast("bigint")).drop("_base")


def mine_stream(lines: DataFrame, settings: Settings, state_path: str, checkpoint: str, year: int, available_now: bool = True, merge: bool = False) -> StreamingQuery:
    """Starts mining a stream of lines (path, position, value)."""

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        store = StateStore(df.sparkSession, state_path)
        entries = parsed(numbered(df).select("seq", "value"), settings.input, year)
        advance_state(store, entries, settings, batch=f"stream-{number}", merge=merge)
        store.expire()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def windowed_counts(events: DataFrame, unit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per template and tumbling window of a stream of (template_id, ts), for late data up to ``late``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", unit).alias("w"), "template_id").agg(F.count("*").alias("value")).select("template_id", F.col("w.start").alias("bucket"), "value")
