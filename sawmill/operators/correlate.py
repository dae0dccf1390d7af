"""Windowed co-occurrence of templates, association rules and causal chains.

Events are (template_id, ts).  Counting goes by stretches of time and aggregates; the graph of the significant rules is walked
on the driver where it is small, else by joins in rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sawmill.operators import graph
from sawmill.plans.stored import stored

MIN_CHI2, STRONG_JACCARD, MANY_TEMPLATES = 3.841, 0.8, 100


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def check_window(seconds: int) -> int:
    if not 5 <= seconds <= 3600:
        raise ValueError("window_size must lie in 5..3600 seconds")
    return seconds


def event_counts(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(template_id, n), with the counts of a loaded state added."""
    now = events.groupBy("template_id").agg(F.count("*").alias("n"))
    return now if state is None else now.unionByName(state.select("template_id", "n")).groupBy("template_id").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, min_count: int = 10) -> DataFrame:
    """Counts of at least ``min_count``, where there are more than MANY_TEMPLATES templates; else all."""
    many = counts.agg((F.count("*") > MANY_TEMPLATES).alias("many")).first().many
    return counts.where(F.col("n") >= min_count) if many else counts


def burst_templates(events: DataFrame, window: int, threshold: int) -> DataFrame:
    """(template_id, peak): templates of which more than ``threshold`` events begin within [t, t + window] of one event."""
    width = window * 1_000_000
    # a window's events lie in one stretch of time or the next, so each is dealt to its own and the one before: no
    # template is sorted in one task
    e = events.where("ts is not null").select("template_id", micros(F.col("ts")).alias("u")).withColumn("at", F.floor(F.col("u") / width))
    e = e.withColumn("part", F.explode(F.array(F.col("at"), F.col("at") - 1)))
    w = Window.partitionBy("template_id", "part").orderBy("u").rangeBetween(0, width)
    counted = e.withColumn("k", F.count("*").over(w)).where("part = at")
    return counted.groupBy("template_id").agg(F.max("k").alias("peak")).where(F.col("peak") > threshold)


#: Stretches of time a window is cut into: each is swept by one task.
STRETCHES = 8
#: Pairs that a sweep gathers before it adds them up.
GATHERED = 1 << 20


class Sweep:
    """Counts pairs while going back in time: for each template the next event at or behind the present one, as long as the
    window reaches it.  Memory follows the templates of a window, not its events."""

    def __init__(self, width: int):
        self.width, self.names, self.codes = width, [], {}
        self.clear()
        self.gathered: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        self.waiting = 0

    def clear(self) -> None:
        """Forgets what came behind: another stretch begins."""
        self.ids, self.next, self.n = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
        self.at: dict[int, int] = {}

    def code(self, name) -> int:
        if name not in self.codes:
            self.codes[name] = len(self.names)
            self.names.append(name)
        return self.codes[name]

    def see(self, code: int, t: int) -> None:
        at = self.at.get(code)
        if at is None:
            if self.n == len(self.ids):
                self.ids, self.next = np.concatenate((self.ids, self.ids)), np.concatenate((self.next, self.next))
            at = self.at[code] = self.n
            self.ids[at], self.n = code, self.n + 1
        self.next[at] = t

    def count(self, events: list[tuple[int, int]], t: int) -> None:
        """All events (code, times) of one instant, after they were seen."""
        ahead = self.next[: self.n] - t
        near = ahead <= self.width
        if near.sum() * 2 + 64 < self.n:
            self.ids[: near.sum()], self.next[: near.sum()] = self.ids[: self.n][near], self.next[: self.n][near]
            self.n = int(near.sum())
            self.at = {int(c): k for k, c in enumerate(self.ids[: self.n])}
            ahead, near = self.next[: self.n] - t, np.ones(self.n, bool)
        ids, close = self.ids[: self.n][near], ahead[near] < 1_000_000
        for code, times in events:
            self.gathered.append((code, ids, close, times))
            self.waiting += len(ids)

    def taken(self) -> tuple[list, list, np.ndarray, np.ndarray]:
        """(a, b, co, sim) of what was gathered."""
        if not self.gathered:
            return [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        lens = [len(ids) for _, ids, _, _ in self.gathered]
        a, times = (np.repeat(np.array([g[k] for g in self.gathered], np.int64), lens) for k in (0, 3))
        b, close = np.concatenate([g[1] for g in self.gathered]), np.concatenate([g[2] for g in self.gathered])
        keys, place = np.unique(a * len(self.names) + b, return_inverse=True)
        co, sim = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(co, place, times)
        np.add.at(sim, place, np.where(close, times, 0))
        a, b = keys // len(self.names), keys % len(self.names)
        other = a != b
        self.gathered, self.waiting = [], 0
        return [self.names[x] for x in a[other]], [self.names[x] for x in b[other]], co[other], sim[other]


def co_occurrence(events: DataFrame, window: int, stretches: int = STRETCHES) -> DataFrame:
    """(a, b, co, sim): a-events with at least one b-event in [t, t + window], and in [t, t + 1 s).

    Only the next event of each other template counts, so no pairs of events are made.  Time is cut into stretches shorter
    than the window; a stretch needs its own events and, of those behind it, the first of each template and stretch.  A task
    sweeps its stretches from their ends, row by row; events of one template and time are one row with their number.
    """
    width = window * 1_000_000
    step = max(1, -(-width // stretches))
    kind = events.schema["template_id"].dataType.simpleString()
    e = events.where("ts is not null").select("template_id", micros(F.col("ts")).alias("u")).groupBy("template_id", "u").agg(F.count("*").alias("k"))
    own = e.withColumn("stretch", F.floor(F.col("u") / step))
    first = own.groupBy("template_id", "stretch").agg(F.min("u").alias("u"))
    ahead = first.select("template_id", "u", F.lit(0).cast("bigint").alias("k"), F.explode(F.sequence(F.col("stretch") - -(-width // step), F.col("stretch") - 1)).alias("stretch"))
    rows = own.unionByName(ahead).repartition(F.col("stretch")).sortWithinPartitions("stretch", F.desc("u"))
    schema = f"a {kind}, b {kind}, co bigint, sim bigint"

    def run(batches):
        sweep, now, instant = Sweep(width), None, []
        types = None

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(sweep.taken(), (types, types, pa.int64(), pa.int64()), strict=True)], names=["a", "b", "co", "sim"])

        for batch in batches:
            types = batch.column(0).type
            for name, u, k, stretch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (stretch, u) != now:
                    if instant:
                        sweep.count(instant, now[1])
                    if now is None or stretch != now[0]:
                        sweep.clear()
                    now, instant = (stretch, u), []
                code = sweep.code(name)
                sweep.see(code, u)
                if k:
                    instant.append((code, k))
                if sweep.waiting >= GATHERED:
                    yield flushed()
        if instant:
            sweep.count(instant, now[1])
        if sweep.gathered:
            yield flushed()

    near = rows.select("template_id", "u", "k", "stretch").mapInArrow(run, schema)
    return near.groupBy("a", "b").agg(F.sum("co").alias("co"), F.sum("sim").alias("sim"))


def symmetrised(pairs: DataFrame) -> DataFrame:
    """Pairs seen less than a second apart in either direction: the smaller directed count rises to the larger one, and
    its sim with it."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("co").alias("co2"), F.col("sim").alias("sim2"))
    both = pairs.join(back, ["a", "b"], "full").na.fill(0, ["co", "sim", "co2", "sim2"])
    touch = (F.col("sim") > 0) | (F.col("sim2") > 0)
    lift = touch & (F.col("co") < F.col("co2"))
    out = both.select("a", "b", F.when(lift, F.col("co2")).otherwise(F.col("co")).alias("co"), F.when(lift, F.col("co2")).otherwise(F.col("sim")).alias("sim"))
    return out.where("co > 0")


def merged_state(pairs: DataFrame, state: DataFrame) -> DataFrame:
    return pairs.unionByName(state.select("a", "b", "co", "sim")).groupBy("a", "b").agg(F.sum("co").alias("co"), F.sum("sim").alias("sim"))


def rules(pairs: DataFrame, counts: DataFrame, total: int, min_support: float = 0.01, min_confidence: float = 0.5, min_lift: float = 2.0, bursts: DataFrame | None = None) -> DataFrame:
    """Support, confidence, lift, chi2 (of the one cell), jaccard and flags of each directed pair."""
    ca, cb = counts.select(F.col("template_id").alias("a"), F.col("n").alias("a_count")), counts.select(F.col("template_id").alias("b"), F.col("n").alias("b_count"))
    r = pairs.join(ca, "a").join(cb, "b").where("a_count > 0 and b_count > 0")
    r = r.withColumn("co_count", F.least("co", "a_count", "b_count")).withColumn("sim_count", F.least("sim", "co_count"))
    n = F.lit(float(max(total, 1)))
    expected = F.col("a_count") * F.col("b_count") / n
    r = r.withColumns({
        "support": F.col("co_count") / n, "confidence": F.col("co_count") / F.col("a_count"), "lift": (F.col("co_count") / F.col("a_count")) / (F.col("b_count") / n),
        "chi2": F.pow(F.col("co_count") - expected, 2) / expected, "jaccard": F.col("co_count") / (F.col("a_count") + F.col("b_count") - F.col("co_count")),
    })
    r = r.withColumn("is_simultaneous", (F.col("sim_count") == F.col("co_count")) & (F.col("co_count") > 0)).withColumn("is_strong_correlation", F.col("jaccard") > STRONG_JACCARD)
    r = r.withColumn("is_significant", (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & (F.col("chi2") >= MIN_CHI2))
    if bursts is None:
        r = r.withColumn("is_burst", F.lit(False))
    else:
        hot = bursts.select("template_id")
        r = r.join(hot.select(F.col("template_id").alias("a"), F.lit(True).alias("_x")), "a", "left").join(hot.select(F.col("template_id").alias("b"), F.lit(True).alias("_y")), "b", "left")
        r = r.withColumn("is_burst", F.coalesce("_x", "_y", F.lit(False)))
    flags = ["is_strong_correlation", "is_burst", "is_simultaneous", "is_significant"]
    return r.select("a", "b", "support", "confidence", "lift", "chi2", "jaccard", "co_count", "a_count", "b_count", *flags)


def directed(edges: DataFrame) -> DataFrame:
    """One direction of each pair: clearly different ones keep the larger confidence (then count); else a pair whose both
    directions are simultaneous goes, and of others the larger confidence stays (ties: the smaller source)."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("confidence").alias("c2"), F.col("co_count").alias("n2"), F.col("is_simultaneous").alias("s2"))
    e = edges.join(back, ["a", "b"], "left")
    c, n, c2, n2 = (F.col(x) for x in ("confidence", "co_count", "c2", "n2"))
    clear = (F.abs(c - c2) >= 0.05) | (F.abs(n - n2) / F.greatest(n, n2, F.lit(1)) >= 0.05)
    first = F.col("a") < F.col("b")
    wins = (c > c2) | ((c == c2) & ((n > n2) | ((n == n2) & first)))
    calm = ~(F.col("is_simultaneous") & F.col("s2")) & ((c > c2) | ((c == c2) & first))
    return e.where(c2.isNull() | (clear & wins) | (~clear & calm)).drop("c2", "n2", "s2")


def strongly_connected(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components, each sorted, in order of their least node.  Iterative: depth is no limit."""
    after: dict[str, list[str]] = {}
    before: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b), before.setdefault(b, []).append(a)
        after.setdefault(b, []), before.setdefault(a, [])
    order, seen = [], set()
    for start in sorted(after):
        stack = [(start, iter(sorted(after[start])))] if start not in seen else []
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(sorted(after[step]))))
    out, placed = [], set()
    for start in reversed(order):
        if start in placed:
            continue
        group, todo = [], [start]
        placed.add(start)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in before[x]:
                if y not in placed:
                    placed.add(y)
                    todo.append(y)
        out.append(sorted(group))
    return sorted(out)


def longest_chains(edges: list[tuple[str, str, float]]) -> list[tuple[list[str], list[float], float]]:
    """(path, weights, total) of the heaviest path that ends in each component of the condensed graph, of at least two
    steps; longest first, then heaviest.  A component of several nodes stands as '[a, b]'."""
    groups = strongly_connected([(a, b) for a, b, _ in edges])
    of = {x: i for i, g in enumerate(groups) for x in g}
    weight: dict[int, dict[int, float]] = {i: {} for i in range(len(groups))}
    for a, b, w in edges:
        i, j = of[a], of[b]
        if i != j:
            weight[i][j] = max(w, weight[i].get(j, w))
    entering = {i: 0 for i in weight}
    for i in weight:
        for j in weight[i]:
            entering[j] += 1
    ready, best, prev = [i for i in weight if not entering[i]], {i: 0.0 for i in weight}, {}
    while ready:
        i = ready.pop(0)
        for j, w in sorted(weight[i].items()):
            if best[i] + w > best[j] or (best[i] + w == best[j] and j in prev and i < prev[j][0]):
                best[j], prev[j] = best[i] + w, (i, w)
            entering[j] -= 1
            if not entering[j]:
                ready.append(j)
    found = {}
    for end in weight:
        path, weights, at = [end], [], end
        while at in prev:
            at, w = prev[at]
            path.append(at), weights.append(w)
        if len(path) >= 2:
            names = [groups[i][0] if len(groups[i]) == 1 else "[" + ", ".join(groups[i]) + "]" for i in reversed(path)]
            found[tuple(names)] = (names, weights[::-1], sum(weights[::-1]))
    return sorted(found.values(), key=lambda c: (-len(c[0]), -c[2], c[0]))


#: So many edges at most are walked on the driver, more by joins in rounds.
HERE = 100_000


def causal_chains(significant: DataFrame, here: int = HERE) -> DataFrame:
    """path, edge_weights, total_confidence, length of the chains of significant rules (no bursts, not simultaneous): the
    heaviest path that ends in each strong component, of at least two of them."""
    edges = stored(directed(significant.where("not is_burst and not is_simultaneous")).select("a", "b", "confidence"), "edges")
    if edges.count() <= here:
        made = [(p, w, t, len(p)) for p, w, t in longest_chains(sorted((r.a, r.b, r.confidence) for r in edges.collect()))]
        return significant.sparkSession.createDataFrame(made, "path array<string>, edge_weights array<double>, total_confidence double, length int")
    of = stored(graph.strong_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "strong")
    named = of.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("x"))
    named = named.select("component", F.when(F.size("x") == 1, F.col("component")).otherwise(F.concat(F.lit("["), F.array_join("x", ", "), F.lit("]"))).alias("name"))
    to = lambda c, d: of.select(F.col("node").alias(c), F.col("component").alias(d))
    joined = edges.join(to("a", "u"), "a").join(to("b", "v"), "b").where("u <> v").groupBy("u", "v").agg(F.max("confidence").alias("w"))
    paths = graph.heaviest_paths(stored(joined, "condensed")).where(F.size("path") >= 2)
    steps = paths.select("node", "weights", "total", F.posexplode("path").alias("k", "component")).join(named, "component")
    back = steps.groupBy("node", "weights", "total").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("path"))
    return back.select("path", F.col("weights").alias("edge_weights"), F.col("total").alias("total_confidence"), F.size("path").alias("length"))


def scc_table(edges: DataFrame, here: int = HERE) -> DataFrame:
    """(node, component): the least node of each strongly connected component."""
    pairs = stored(edges.select("a", "b").distinct(), "edges")
    if pairs.count() > here:
        return graph.strong_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    made = [(x, g[0]) for g in strongly_connected([(r.a, r.b) for r in pairs.collect()]) for x in g]
    return edges.sparkSession.createDataFrame(made, "node string, component string")
