"""The analyses end to end, as DataFrames: lines to templates, clusters, anomalies, alerts; events to rules and chains."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.config import Settings
from sawmill.functions.masking import mask_all, tokenize
from sawmill.functions.parsing import sealed
from sawmill.operators import alerts, anomaly, clustering, correlate, mining, tags, timeseries
from sawmill.plans.stored import dropped, stored
from sawmill.sources.lines import parsed
from sawmill.sources.libraries import text_of_file
from sawmill.sources.state import StateStore


def masked_lines(entries: DataFrame, settings: Settings) -> DataFrame:
    """Entries with the tokens of their masked messages."""
    masked = mask_all(entries.withColumn("_masked", F.col("message")), "_masked", settings.preprocess)
    return sealed(masked, {"tokens": tokenize(F.col("_masked"))}).drop("_masked")


@dataclass
class Analysis:
    """Lazy tables of one analysis; ``rows`` are the lines with their templates."""

    rows: DataFrame
    templates: DataFrame
    members: DataFrame
    clusters: DataFrame
    series: DataFrame
    lifecycle: DataFrame
    metrics: DataFrame
    alerts: list[dict] = field(default_factory=list)
    total_logs: int = 0
    seconds: float = 0.0

    def register(self, prefix: str = "") -> None:
        """Temp views for Spark SQL."""
        for name in ("rows", "templates", "members", "clusters", "series", "lifecycle", "metrics"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


@dataclass
class Mined:
    """What a batch of lines came to: its rows under their final templates, and what it adds to a state."""

    rows: DataFrame
    ids: DataFrame
    increments: DataFrame
    merges: DataFrame
    counter: int


NO_MERGES = "template_id string, related_template_id string, kind string, step int"
STATS = ("count", "first_seen", "last_seen", "level_counts", "sources", "is_error")


def _number(template_id) -> Column:
    return F.substring(template_id, 2, 18).try_cast("bigint")


def mine_batch(entries: DataFrame, settings: Settings, merge: bool = True, state: DataFrame | None = None, counter: int = 0) -> Mined:
    """Mines parsed entries (seq, ts, level, source, message) against the templates of a state (``sources.state.TEMPLATES``,
    with those that are gone) whose ids went up to ``counter``.  Only templates of the batch's token counts are read.

    ``increments`` has a row for each template that the batch touched: what its lines add, what it takes over from templates
    merged into it, and that those are gone.
    """
    spark = entries.sparkSession
    lines = stored(masked_lines(entries, settings).select("seq", "ts", "level", "source", "tokens"), "lines")
    old, seeds = None, None
    if state is not None:
        sizes = lines.select(F.size("tokens").alias("n")).distinct()
        old = stored(state.join(sizes, "n", "left_semi"), "old")
        seeds = old.select((_number(F.col("template_id")) - F.lit(1 << 62)).alias("seq"), "tokens", "gone")
    assigned = mining.assign_templates(lines, settings.drain, seeds)
    live = None if old is None else old.where(~F.col("gone"))
    created = assigned if live is None else assigned.join(live.select("template"), "template", "left_anti")
    fresh = stored(mining.template_ids(lines, created, counter + 1), "fresh")
    counter += fresh.count()
    ids = fresh.select("template_id", "template", "tokens")
    if live is not None:
        ids = ids.unionByName(live.select("template_id", "template", "tokens"))
    rows = mining.assignments(lines, assigned, ids)
    merges, lineage, events = None, None, spark.createDataFrame([], NO_MERGES)
    if merge:
        # only a token count that has a fresh template can have something to merge
        changed = ids.withColumn("n", F.size("tokens")).join(fresh.select(F.size("tokens").alias("n")).distinct(), "n", "left_semi").drop("n")
        merges, lineage, events = mining.merge_templates(changed, counter)
        counter += merges.where(_number(F.col("template_id")) > counter).count() if not events.isEmpty() else 0
        counter = max(counter, events.agg(F.max(_number(F.col("related_template_id"))).alias("n")).first().n or 0)
        rows = mining.merged_rows(rows, lineage, "left")
        untouched = ids.join(lineage.select(F.col("raw_id").alias("template_id")), "template_id", "left_anti")
        ids = untouched.unionByName(merges.select("template_id", "template", "tokens"))
    rows = stored(rows.select("seq", "ts", "level", "source", "template_id"), "rows")
    ids = stored(ids, "ids")
    touched = mining.template_stats(rows).drop("main_level")
    if old is not None and lineage is not None:
        moved = live.join(lineage.where("raw_id <> template_id").select(F.col("raw_id").alias("_raw"), F.col("template_id").alias("_into")), F.col("template_id") == F.col("_raw"))
        touched = touched.unionByName(moved.select(F.col("_into").alias("template_id"), *STATS))
    increments = touched.join(ids, "template_id").withColumns({"n": F.size("tokens"), "gone": F.lit(False)})
    if lineage is not None:
        every = fresh.select("template_id", "template", "tokens")
        every = every if live is None else every.unionByName(live.select("template_id", "template", "tokens"))
        ended = events.select("template_id").distinct()
        none = {"count": "bigint", "first_seen": "timestamp_ntz", "last_seen": "timestamp_ntz", "level_counts": "map<string,bigint>", "sources": "array<string>"}
        gone = every.join(ended, "template_id").withColumns({"n": F.size("tokens"), "gone": F.lit(True), "is_error": F.lit(False), **{c: F.lit(None).cast(t) for c, t in none.items()}})
        increments = increments.unionByName(gone)
    increments = stored(increments.withColumn("count", F.coalesce("count", F.lit(0))), "increments")
    dropped(lines, assigned, fresh, *([old] if old is not None else []))
    return Mined(rows, ids, increments, events, counter)


def mine(entries: DataFrame, settings: Settings, merge: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, templates, merge events) of parsed entries (seq, ts, level, source, message)."""
    lines = stored(masked_lines(entries, settings).select("seq", "ts", "level", "source", "tokens"), "lines")
    assigned = mining.assign_templates(lines, settings.drain)
    ids = stored(mining.template_ids(lines, assigned), "ids")
    rows = mining.assignments(lines, assigned, ids)
    events = None
    if merge:
        merged, lineage, events = mining.merge_templates(ids)
        rows = mining.merged_rows(rows, lineage)
        ids = merged.select("template_id", "template", "tokens")
    rows = stored(rows.select("seq", "ts", "level", "source", "template_id"), "rows")
    templates = stored(ids.select("template_id", "template", "tokens").join(mining.template_stats(rows), "template_id"), "templates")
    dropped(lines, assigned)
    if events is None:
        events = entries.sparkSession.createDataFrame([], NO_MERGES)
    return rows, templates, events


def analyze(entries: DataFrame, settings: Settings | None = None, baseline: DataFrame | None = None, tag: str | None = None, merge: bool = True, horizon: str = "template") -> Analysis:
    """The whole analysis of parsed entries.  ``tag`` keeps the templates with that tag, before clusters, anomalies and
    alerts."""
    settings = settings or Settings()
    began = time.monotonic()
    rows, templates, merges = mine(entries, settings, merge)
    return _analysis(rows, templates, merges, settings, baseline, tag, horizon, began)


def _analysis(rows: DataFrame, templates: DataFrame, merges: DataFrame, settings: Settings, baseline: DataFrame | None, tag: str | None, horizon: str, began: float, fresh: DataFrame | None = None) -> Analysis:
    """``fresh``: the ids that are new where there is no baseline (all by default)."""
    total = rows.count()
    templates = mining.compress(templates, settings.incremental.max_templates, settings.incremental.rare_template_count)
    lifecycle = mining.lifecycle_events(templates, merges)
    templates = templates.withColumn("tags", tags.tags_of(F.col("template"), settings.tags))
    if tag:
        templates = tags.filtered(templates, tag)
    templates = stored(templates, "tagged")
    members = clustering.cluster(templates, settings.clustering.merge_threshold)
    clusters = clustering.cluster_stats(members, templates)
    a = settings.anomaly
    kept = rows.join(templates.select("template_id"), "template_id", "left_semi")
    series = timeseries.analyze(kept.select("template_id", "ts"), a.freq_unit, a.freq_n_std, a.freq_m_periods, a.min_data_points, horizon)
    series = stored(series, "series")
    filters = settings.filters
    flagged = anomaly.flagged(templates, series, baseline, filters.whitelist, filters.focus)
    if fresh is not None and baseline is None:
        known = fresh.select("template_id", F.lit(True).alias("_fresh"))
        flagged = flagged.join(known, "template_id", "left").withColumn("is_new", F.col("is_new") & F.coalesce("_fresh", F.lit(False))).drop("_fresh")
    flagged = stored(flagged.join(members.select("template_id", "cluster_id"), "template_id", "left"), "flagged")
    seconds = time.monotonic() - began
    metrics = alerts.metrics(flagged, total, seconds)
    return Analysis(rows, flagged, members, clusters, series, lifecycle, metrics, alerts.triggered(metrics, settings.alerts), total, seconds)


def analyze_files(spark: SparkSession, paths: list[str], settings: Settings | None = None, year: int | None = None, **options) -> Analysis:
    from sawmill.sources.lines import scan_lines

    settings = settings or Settings()
    return analyze(parsed(scan_lines(spark, paths), settings.input, year or datetime.date.today().year), settings, **options)


def state_events(mined: Mined, counter_before: int) -> DataFrame:
    """created and merged events of a batch, as a state keeps them."""
    made = mined.ids.join(mined.increments.groupBy("template_id").agg(F.min("first_seen").alias("at")), "template_id")
    made = made.where(_number(F.col("template_id")) > counter_before)
    none = F.lit(None).cast("string")
    created = made.select("at", F.lit("created").alias("event_type"), "template_id", none.alias("related_template_id"), F.lit("").alias("details"))
    merged = mined.merges.select(F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("merged").alias("event_type"), "template_id", "related_template_id", F.col("kind").alias("details"))
    return created.unionByName(merged)


def main_level(level_counts: Column) -> Column:
    """The most frequent level of a histogram; of equal ones the first by name."""
    best = F.array_sort(F.map_entries(level_counts), lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["key"] < b["key"], -1).otherwise(1))
    return F.get(best, F.lit(0))["key"]


def advance_state(store: StateStore, entries: DataFrame, settings: Settings, offsets: DataFrame | None = None, batch: str | None = None, merge: bool = True) -> tuple[Mined | None, dict]:
    """Mines a batch against the newest version of the state and publishes the next; (None, manifest) if that version has
    this batch already."""
    base = store.manifest()
    if batch is not None and base["batch"] == batch:
        return None, base
    mined = mine_batch(entries, settings, merge, store.templates(base, gone=True), base["counter"])
    made = store.commit(mined.counter, mined.increments, offsets, state_events(mined, base["counter"]), batch, base)
    return mined, made


def state_folder(spark: SparkSession, path: str, resume: bool = True) -> str:
    """The folder of the state that ``path`` names.  A .json path stands for the folder beside it; a state that another
    engine saved there is taken over if the folder has none.  Without ``resume`` what the folder has is emptied by a new
    version."""
    folder = path.removesuffix(".json")
    store = StateStore(spark, folder)
    if not resume:
        if store.versions():
            store.reset()
    elif path.endswith(".json") and not store.versions():
        store.load_json(text_of_file(spark, path) or "")
    return folder


def analyze_incremental(spark: SparkSession, paths: list[str], state: str, settings: Settings | None = None, year: int | None = None, baseline: DataFrame | None = None, tag: str | None = None, unfinished: str = "read") -> Analysis:
    """Goes on from a stored state: reads what the files have since its offsets, mines it against its templates, publishes
    the next version, and analyses all templates with their whole statistics; series, rows and totals are the new lines'."""
    from sawmill.sources import growing

    settings, began = settings or Settings(), time.monotonic()
    store = StateStore(spark, state)
    before = store.manifest()
    lines, offsets = growing.incremental_append(spark, paths, store.offsets(before), unfinished)
    entries = parsed(lines, settings.input, year or datetime.date.today().year)
    mined, made = advance_state(store, entries, settings, offsets)
    store.expire()
    templates = stored(store.templates(made).withColumn("main_level", main_level(F.col("level_counts"))).drop("gone", "n"), "templates")
    fresh = templates.where(_number(F.col("template_id")) > before["counter"]).select("template_id")
    return _analysis(mined.rows, templates, mined.merges, settings, baseline, tag, "template", began, fresh)


@dataclass
class Correlation:
    rules: DataFrame
    significant: DataFrame
    chains: DataFrame
    bursts: DataFrame
    pairs: DataFrame
    counts: DataFrame
    total: int


def correlate_events(events: DataFrame, settings: Settings | None = None, state: tuple[DataFrame, DataFrame] | None = None) -> Correlation:
    """Rules and chains of events (template_id, ts); ``state``: (pairs, counts) of earlier runs, which are added."""
    c = (settings or Settings()).correlate
    window = correlate.check_window(c.window_size)
    counts = stored(correlate.event_counts(events, state[1] if state else None), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    common = correlate.frequent(counts, c.min_count)
    kept = events.join(common.select("template_id"), "template_id", "left_semi")
    bursts = correlate.burst_templates(kept, window, c.burst_threshold)
    pairs = correlate.symmetrised(correlate.co_occurrence(kept, window))
    if state:
        pairs = correlate.merged_state(pairs, state[0])
    pairs = stored(pairs, "pairs")
    rules = stored(correlate.rules(pairs, counts, total, c.min_support, c.min_confidence, c.min_lift, bursts), "rules")
    significant = rules.where("is_significant").orderBy(F.desc("lift"), "a", "b")
    return Correlation(rules, significant, correlate.causal_chains(significant), bursts, pairs, counts, total)
