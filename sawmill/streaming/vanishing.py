"""Templates that fall silent, as a stream: state per template with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The only state store that keeps timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Silence(StatefulProcessor):
    """Holds the last time of a template (milliseconds); reports it once nothing followed for ``horizon``.  A gap that later
    rows close is reported with them, so that batches of any size give the same rows."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None:
            self.handle.deleteTimer(before + self.horizon)
        times = sorted(t for pdf in rows for t in pdf["ms"].tolist())
        silent, at = [], before
        for t in times:
            if at is not None and t - at > self.horizon:
                silent.append(at)
            at = t if at is None else max(at, t)
        self.last.update((at,))
        self.handle.registerTimer(at + self.horizon)
        if silent:
            yield pd.DataFrame({"template_id": [key[0]] * len(silent), "ms": silent})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"template_id": [key[0]], "ms": [at]})

    def close(self) -> None:
        pass


def vanished(events: DataFrame, horizon: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(template_id, vanished_since) of a stream of (template_id, ts): each last time of a template after which there was
    nothing for ``horizon``, as soon as the watermark, ``late`` behind the newest event, has passed that."""
    events.sparkSession.conf.set(*STORE)
    horizon_ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
    timed = events.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    kind = events.schema["template_id"].dataType.simpleString()
    silent = timed.groupBy("template_id").transformWithStateInPandas(Silence(horizon_ms), f"template_id {kind}, ms bigint", "Append", "eventTime")
    return silent.select("template_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("vanished_since"))


def to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream's rows to a table of Parquet files under ``path``."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def counts_to_table(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch's changed counts of a windowed stream under ``path``/batch=n; a batch that runs again replaces
    its own."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = counts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, bucket, value): the newest count of each window that ``counts_to_table`` wrote."""
    written = spark.read.parquet(path)
    return written.groupBy("template_id", "bucket").agg(F.max_by("value", "batch").alias("value"))
