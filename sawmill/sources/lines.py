"""Log lines with a total order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.config import Section
from sawmill.functions.parsing import normalize_level, parse_lines, strip


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(seq, file_idx, value) of text files (UTF-8, bad bytes replaced) in the order of ``paths`` and of their lines.

    Spark numbers partitions in file order for one file; files of a list are read one by one into a union, so that
    monotonically_increasing_id follows (file, position).  seq is unique and ordered, not dense.
    """
    parts = [spark.read.text(p).select(F.lit(i).alias("file_idx"), "value") for i, p in enumerate(paths)]
    if not parts:
        return spark.createDataFrame([], "seq bigint, file_idx int, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.monotonically_increasing_id().alias("seq"), "file_idx", "value")


def from_iterable(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Lines of a driver-side stream such as standard input, read to its end."""
    return spark.createDataFrame([(i, 0, x.rstrip("\r\n")) for i, x in enumerate(lines)], "seq bigint, file_idx int, value string")


def from_entries(spark: SparkSession, entries: Iterable[tuple]) -> DataFrame:
    """Entries (ts, level, source, message) that are parsed already."""
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "seq bigint, ts timestamp_ntz, level string, source string, message string")


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.length(strip(F.coalesce("value", F.lit("")))) > 0)


#: Inputs estimated below so many bytes a core are dealt out anew before they are parsed.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input that lies in few partitions (one compressed file, say) over all cores; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df


def parsed(lines: DataFrame, options: Section, year: int) -> DataFrame:
    """(seq, ts, level, source, message, raw) without blank lines and blank messages; levels normalised."""
    p = parse_lines(spread(not_blank(lines).select("seq", "value")), "value", options, year)
    p = p.select("seq", "ts", normalize_level(F.col("level")).alias("level"), "source", "message", F.col("value").alias("raw"))
    return p.where(F.length(strip(F.coalesce("message", F.lit("")))) > 0)
