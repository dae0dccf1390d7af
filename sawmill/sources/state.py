"""The engine's state between batches: templates, file offsets, events and the counter of ids.

Tables are immutable Parquet folders; a manifest names those that make up a version.  A batch writes rows only for what it
touched: increments of templates, offsets of files that moved on, new events.  Then it publishes the next manifest, by a
rename that fails where the name is taken.  What was written before a crash and isn't in a manifest is never read, so a
version is there whole or not at all, and a batch that runs again adds nothing twice.  Readers merge increments; compaction
writes a snapshot of the merged rows; expiry deletes what only old manifests name.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.operators.mining import SOURCES
from sawmill.sources.growing import OFFSETS
from sawmill.sources.libraries import text_of_file

#: n: the number of tokens, by which batches read; gone: merged away, and kept because it still shapes the routing.
TEMPLATES = (
    "template_id string, template string, tokens array<string>, n int, count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, "
    "level_counts map<string,bigint>, sources array<string>, is_error boolean, gone boolean"
)
EVENTS = "at timestamp_ntz, event_type string, template_id string, related_template_id string, details string"
_KINDS = {"templates": TEMPLATES + ", version bigint", "offsets": OFFSETS + ", version bigint", "events": EVENTS + ", version bigint"}
#: Increments that a reader merges at most; the commit behind that many writes a snapshot first.
MOST_DELTAS = 8


class Conflict(RuntimeError):
    """Another writer has published this version."""


def merged_levels(a: Column, b: Column) -> Column:
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: (at(a, k) + at(b, k)).cast("bigint")))


def merged_templates(deltas: DataFrame) -> DataFrame:
    """One row per template of increments (TEMPLATES and version): counts and levels add up, sources keep their order."""
    none = F.create_map().cast("map<string,bigint>")
    order = lambda a, b: F.when(a["version"] != b["version"], F.when(a["version"] < b["version"], -1).otherwise(1)).when(a["first_seen"] < b["first_seen"], -1).when(a["first_seen"] > b["first_seen"], 1).otherwise(0)
    part = F.struct("version", "first_seen", F.coalesce("level_counts", none).alias("levels"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    in_order = F.array_sort(F.collect_list(part), order)
    g = deltas.groupBy("template_id").agg(
        F.min_by("template", "version").alias("template"), F.min_by("tokens", "version").alias("tokens"), F.min("n").alias("n"), F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), in_order.alias("_d"), F.bool_or("is_error").alias("is_error"), F.bool_or("gone").alias("gone"),
    )
    levels = F.aggregate("_d", none, lambda s, x: merged_levels(s, x["levels"]))
    sources = F.slice(F.aggregate("_d", F.array().cast("array<string>"), lambda s, x: F.array_union(s, x["sources"])), 1, SOURCES)
    return g.withColumns({"level_counts": levels, "sources": sources}).select(*[c.split()[0] for c in TEMPLATES.split(", ")])


class StateStore:
    """The state under one folder, on any file system of Hadoop's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        at = self._path("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d{12})\.json", n)))

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """The newest manifest, or that of a version; an empty one before the first."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "counter": 0, "batch": None, "tables": {k: [] for k in _KINDS}}
        text = text_of_file(self.spark, f"{self.path}/manifests/v{found[-1] if version is None else version:012d}.json")
        return json.loads(text)

    def _read(self, table: str, manifest: dict | None = None) -> DataFrame:
        parts = (manifest or self.manifest())["tables"][table]
        if not parts:
            return self.spark.createDataFrame([], _KINDS[table])
        return self.spark.read.schema(_KINDS[table]).parquet(*[f"{self.path}/{p}" for p in parts])

    def templates(self, manifest: dict | None = None, gone: bool = False) -> DataFrame:
        """The templates (with ``gone``: also those that were merged into others)."""
        out = merged_templates(self._read("templates", manifest))
        return out if gone else out.where(~F.col("gone"))

    def offsets(self, manifest: dict | None = None) -> DataFrame:
        newest = self._read("offsets", manifest).groupBy("path").agg(F.max_by(F.struct("offset", "head_bytes", "head"), "version").alias("o"))
        return newest.select("path", "o.offset", "o.head_bytes", "o.head")

    def events(self, manifest: dict | None = None) -> DataFrame:
        return self._read("events", manifest)

    def _write(self, df: DataFrame, table: str, version: int, by: str | None = None) -> str:
        name = f"data/{table}-{version:012d}-{uuid.uuid4().hex}"
        df = df if "version" in df.columns else df.withColumn("version", F.lit(version).cast("bigint"))
        columns = [c.split()[0] for c in _KINDS[table].split(", ")]
        (df.sortWithinPartitions(by) if by else df).select(*columns).write.parquet(f"{self.path}/{name}")
        return name

    def _publish(self, manifest: dict) -> None:
        """The manifest under its final name, or Conflict if that is taken."""
        final = self._path(f"manifests/v{manifest['version']:012d}.json")
        tmp = self._path(f"manifests/.tmp-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        qualified = self.fs.makeQualified(final)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(tmp), qualified, options)
        except Py4JJavaError as e:
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                raise Conflict(f"version {manifest['version']}") from e
            raise

    def commit(self, counter: int, templates: DataFrame | None = None, offsets: DataFrame | None = None, events: DataFrame | None = None, batch: str | None = None, base: dict | None = None) -> dict:
        """Adds increments to the version ``base`` (the newest by default) and publishes the next one.

        ``batch`` names what is added: a batch whose name the newest version has is not added again.
        """
        base = base or self.manifest()
        if batch is not None and base["batch"] == batch:
            return base
        if max(len(x) for x in base["tables"].values()) >= MOST_DELTAS:
            base = self.compact(base)
        version, tables = base["version"] + 1, {k: list(v) for k, v in base["tables"].items()}
        for name, df, by in (("templates", templates, "n"), ("offsets", offsets, None), ("events", events, None)):
            if df is not None:
                tables[name].append(self._write(df, name, version, by))
        made = {"version": version, "counter": counter, "batch": batch, "tables": tables}
        self._publish(made)
        return made

    def compact(self, base: dict | None = None) -> dict:
        """A version with one folder a table, of the same rows."""
        base = base or self.manifest()
        version = base["version"] + 1
        old = F.lit(base["version"]).cast("bigint")
        tables = {
            "templates": [self._write(self.templates(base, gone=True).withColumn("version", old), "templates", version, "n")],
            "offsets": [self._write(self.offsets(base).withColumn("version", old), "offsets", version)],
            "events": [self._write(self.events(base), "events", version)],
        }
        made = {**base, "version": version, "tables": tables}
        self._publish(made)
        return made

    def reset(self) -> dict:
        """A version of no rows, whose ids start over."""
        made = {"version": self.manifest()["version"] + 1, "counter": 0, "batch": None, "tables": {k: [] for k in _KINDS}}
        self._publish(made)
        return made

    def expire(self, keep: int = 2) -> int:
        """Deletes manifests but the newest ``keep``, and the folders that none of those name; the number of folders deleted.
        Not to be run while a batch is being written: its folders are in no manifest yet."""
        found = self.versions()
        kept = found[-keep:]
        named = {p for v in kept for parts in self.manifest(v)["tables"].values() for p in parts}
        for v in found[: len(found) - len(kept)]:
            self.fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        at, gone = self._path("data"), 0
        for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
            if f"data/{s.getPath().getName()}" not in named:
                self.fs.delete(s.getPath(), True)
                gone += 1
        return gone

    def load_json(self, text: str) -> dict:
        """Publishes the state that another engine saved as JSON: version, drain_state (template_counter, templates, events)
        and file_offsets.  Files there have an inode instead of a head; their offset holds while they don't shrink.  Broken
        text leaves the state as it is."""
        try:
            data = json.loads(text)
            drain = data.get("drain_state") or {}
            templates = [_template_row(k, v) for k, v in (drain.get("templates") or {}).items()]
            offsets = [(_uri(k), int(v.get("offset", 0)), None, None) for k, v in (data.get("file_offsets") or {}).items()]
            events = [(e["timestamp"], e["event_type"], e["template_id"], e.get("related_template_id") or None, e.get("details") or "") for e in drain.get("events") or []]
            counter = int(drain.get("template_counter", 0))
        except (ValueError, KeyError, TypeError, AttributeError):
            return self.manifest()
        make = self.spark.createDataFrame
        timed = lambda df, *names: df.withColumns({n: F.col(n).try_cast("timestamp_ntz") for n in names})
        strings = TEMPLATES.replace("timestamp_ntz", "string")
        return self.commit(counter, timed(make(templates, strings), "first_seen", "last_seen"), make(offsets, OFFSETS), timed(make(events, EVENTS.replace("timestamp_ntz", "string")), "at"))


def _uri(path: str) -> str:
    return path if ":/" in path else f"file:{path}"


def _template_row(key: str, t: dict) -> tuple:
    s = t.get("stats") or {}
    tokens = list(t.get("tokens") or t["template_str"].split())
    levels = {k: int(v) for k, v in (s.get("level_counts") or {}).items()}
    return (key, t["template_str"], tokens, len(tokens), int(s.get("count", 0)), s.get("first_seen"), s.get("last_seen"), levels, list(s.get("sources") or []), bool(t.get("is_error")), False)
