"""Template libraries and states: JSON in any of its known shapes, Parquet as the engine's own form."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sawmill.operators.ordering import ranked

#: First and last line of a library with a template a line: one JSON document that tasks read and write by lines.
HEAD, TAIL = '{"templates":[', "]}"
LIBRARY = "template_id string, template string, count bigint, level_counts map<string,bigint>, is_error boolean, first_seen string, last_seen string, rank int"


def text_of_file(spark: SparkSession, path: str) -> str | None:
    """The whole file through Spark's readers, or None if it isn't there."""
    try:
        rows = spark.read.text(path, wholetext=True).head(1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise
    return rows[0].value if rows else ""


def template_dicts(data: Any) -> list[dict]:
    """Templates of a state (drain_state.templates), a report (templates) or a bare dict; dicts by id or lists."""
    if not isinstance(data, dict):
        return []
    found = data["drain_state"].get("templates", {}) if isinstance(data.get("drain_state"), dict) else data.get("templates", {k: v for k, v in data.items() if isinstance(v, dict)})
    if isinstance(found, dict):
        return [{"template_id": k, **v} for k, v in found.items() if isinstance(v, dict)]
    return [t for t in found if isinstance(t, dict) and "template_id" in t] if isinstance(found, list) else []


def _row(t: dict, rank: int) -> tuple:
    stats = t.get("stats") or {}
    levels = {k: int(v) for k, v in (stats.get("level_counts") or {}).items()}
    error = bool(t.get("is_error")) or bool({"ERROR", "FATAL"} & set(levels))
    return (str(t["template_id"]), t.get("template_str", t.get("template", "")), int(stats.get("count", t.get("count", 0)) or 0), levels, error, stats.get("first_seen"), stats.get("last_seen"), rank)


def library(spark: SparkSession, data: Any) -> DataFrame:
    """(template_id, template, count, level_counts, is_error, first_seen, last_seen, rank) of parsed JSON."""
    return spark.createDataFrame([_row(t, i) for i, t in enumerate(template_dicts(data))], LIBRARY)


def save_library(templates: DataFrame, path: str) -> None:
    """``templates`` (rank: 0, 1, ..., value: the JSON of a template) as one JSON document over the files of a folder, a
    template a line; no task holds all of it."""
    n = templates.count()
    ends = templates.sparkSession.createDataFrame([(-1, HEAD), (n, TAIL)], "rank bigint, value string")
    lines = templates.select(F.col("rank").cast("bigint").alias("rank"), F.when(F.col("rank") < n - 1, F.concat("value", F.lit(","))).otherwise(F.col("value")).alias("value"))
    lines.union(ends).repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.text(path)


def _by_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The library of a document with a template a line, by tasks; None if there is no such document.  A broken one raises
    ValueError."""
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise
    is_end = lambda c: F.coalesce(F.count_if(F.col("value") == c), F.lit(0))
    ends = text.agg(is_end(HEAD).alias("head"), is_end(TAIL).alias("tail")).first()
    if (ends.head, ends.tail) != (1, 1):
        return None
    at = ("_file", "_block", "_at")
    lines = text.select("value", F.col("_metadata.file_path").alias(at[0]), F.col("_metadata.file_block_start").alias(at[1])).withColumn(at[2], F.monotonically_increasing_id())
    lines = ranked(lines, [F.col(c) for c in at], "place").select("value", "place")
    n = lines.count()
    schema = to_arrow_schema(spark.createDataFrame([], LIBRARY).schema)

    def rows(batch: pa.RecordBatch):
        for value, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k in (0, n - 1):
                if value != (TAIL if k else HEAD):
                    raise ValueError(f"line {k + 1} of {n}: {value[:80]!r}")
                continue
            if (k < n - 2) != value.endswith(","):
                raise ValueError(f"line {k + 1} of {n}: a comma too few or too many")
            t = json.loads(value.removesuffix(","))
            if isinstance(t, dict) and "template_id" in t:
                yield _row(t, k - 1)

    def check(batches):
        for batch in batches:
            try:
                found = [(None, len(list(rows(batch))))]
            except (ValueError, TypeError, AttributeError) as e:
                found = [(str(e), 0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["error", "n"])

    def parse(batches):
        for batch in batches:
            found = list(rows(batch))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], schema.field(i).type) for i in range(len(schema))], schema=schema)

    error = lines.mapInArrow(check, "error string, n long").agg(F.min("error")).first()[0]
    if error is not None:
        raise ValueError(error)
    return lines.mapInArrow(parse, LIBRARY)


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """A JSON library, or the newest version of a stored state's folder; a missing or broken file raises.  A document with a
    template a line is read by tasks, any other on the driver."""
    if not path.endswith(".json"):
        from sawmill.sources.state import StateStore

        store = StateStore(spark, path)
        if store.versions():
            t = store.templates()
            rank = F.row_number().over(Window.orderBy("template_id")) - 1
            return t.select("template_id", "template", "count", "level_counts", "is_error", F.col("first_seen").cast("string"), F.col("last_seen").cast("string"), rank.alias("rank"))
    made = _by_lines(spark, path)
    if made is not None:
        return made
    text = text_of_file(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return library(spark, json.loads(text))


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """(template_id, template) of a baseline; None if there is no path or the file is missing or broken."""
    if not path:
        return None
    try:
        made = _by_lines(spark, path)
        if made is not None:
            return made.select("template_id", "template")
        text = text_of_file(spark, path)
        return None if text is None else library(spark, json.loads(text)).select("template_id", "template")
    except ValueError:
        return None


def is_state_file(spark: SparkSession, path: str) -> bool:
    if not path.endswith(".json"):
        from sawmill.sources.state import StateStore

        return bool(StateStore(spark, path).versions())
    try:
        data = json.loads(text_of_file(spark, path) or "")
    except ValueError:
        return False
    return isinstance(data, dict) and {"drain_state", "version"} <= set(data)


def save_state(templates: DataFrame, path: str) -> None:
    """The template table as Parquet under ``path``/templates."""
    templates.write.mode("overwrite").parquet(f"{path}/templates")


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/templates")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def save_correlation(pairs: DataFrame, counts: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def load_correlation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(pairs, counts) of Parquet tables, or of a JSON state with keys 'A|B'; None if missing or broken."""
    if path.endswith(".json"):
        try:
            data = json.loads(text_of_file(spark, path) or "")
            pairs = []
            for k, v in (data.get("co_occurrence") or {}).items():
                a, _, b = k.partition("|")
                co, sim = (v if isinstance(v, list) else [v, 0])[:2]
                pairs.append((a, b, int(co), int(sim)))
            counts = [(k, int(v)) for k, v in (data.get("template_counts") or {}).items()]
        except (ValueError, AttributeError):
            return None
        return spark.createDataFrame(pairs, "a string, b string, co bigint, sim bigint"), spark.createDataFrame(counts, "template_id string, n bigint")
    try:
        return spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/counts")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def synthetic_events(library: DataFrame) -> DataFrame:
    """Of each template (template_id, count, first_seen, last_seen): ``count`` evenly spaced times from first to last; the
    first alone for a count of one; a span of at least a second."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = library.where("count > 0 and first_seen is not null").withColumn("a", micros("first_seen"))
    t = t.withColumn("span", F.greatest(micros("last_seen") - F.col("a"), F.lit(1_000_000)))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))))
    at = F.col("a") + F.when(F.col("count") == 1, 0).otherwise(F.floor(F.col("span") * F.col("i") / (F.col("count") - 1)))
    return t.select("template_id", F.timestamp_micros(at.cast("bigint")).cast("timestamp_ntz").alias("ts"))
