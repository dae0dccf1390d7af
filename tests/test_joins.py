"""Merging, clustering, co-occurrence and graphs by joins, against sequential and brute-force versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sawmill.operators import clustering, correlate, graph, merging, mining, ordering

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", range(2))
def test_merging_by_components(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d"] + (["<*>"] if seed % 2 else [])
    lists = {tuple(f"{g}{rng.choice(words)}" if rng.random() < 0.5 and k else rng.choice(words) for k in range(rng.randint(1, 4))) for g in range(6) for _ in range(25)}
    rows = [(f"T{k + 1:06d}", list(t)) for k, t in enumerate(sorted(lists, key=lambda t: rng.random()))]
    df = spark.createDataFrame(rows, "template_id string, tokens array<string>").repartition(3)
    merger = mining.Merger(rows, 500)
    kept = merger.run()
    merged, lineage, events = merging.merge_by_components(df, 500)
    assert [(r.template_id, list(r.tokens)) for r in merged.orderBy("rank").collect()] == kept
    assert [tuple(r)[:3] for r in events.orderBy("step").collect()] == merger.events
    assert {r.raw_id: r.template_id for r in lineage.collect()} == merger.lineage()


def test_merging_of_nothing(spark):
    for rows in ([], [("T000001", ["a", "b"])], [("T000001", ["a"]), ("T000002", ["a", "b"])]):
        merged, lineage, events = merging.merge_by_components(spark.createDataFrame(rows, "template_id string, tokens array<string>"))
        assert [(r.template_id, list(r.tokens)) for r in merged.orderBy("rank").collect()] == rows and events.count() == 0 and lineage.count() == len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_leaders_in_rounds(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)} | {(i, i + 1) for i in range(60, 75)})
    followers = set()
    for y in range(80):
        if any(x not in followers for x, b in pairs if b == y):
            followers.add(y)
    df = spark.createDataFrame([(*p, 0.1) for p in pairs], "x long, y long, distance double")
    for here in (0, 20, 10**6):
        assert sorted(r.y for r in clustering.leaders(df, here).collect()) == sorted(followers)
    assert clustering.leaders(df.limit(0)).count() == 0


def test_clusters_against_one_after_the_other(spark):
    rng = random.Random(9)
    rows = [(f"T{k:03d}", [rng.choice("abcd") for _ in range(rng.randint(1, 8))], rng.randint(1, 9)) for k in range(120)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1] / max(len(a), len(b))

    heads, want = [], {}
    for i, t, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        near = min(((distance(t, u), k) for k, (_, u) in enumerate(heads)), default=(1, 0))
        if near[0] < 0.3:
            want[i] = (f"C{near[1] + 1:04d}", heads[near[1]][0])
        else:
            heads.append((i, t))
            want[i] = (f"C{len(heads):04d}", i)
    df = spark.createDataFrame([(i, t, n) for i, t, n in rows], "template_id string, tokens array<string>, count long")
    got = clustering.cluster(df, 0.3).orderBy("rank").collect()
    assert {r.template_id: (r.cluster_id, r.representative_id) for r in got} == want
    assert [r.template_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))] and [r.rank for r in got] == list(range(120))


def test_places(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("w")).repartition(7)
    got = ordering.ranked(df, [F.desc("w"), F.asc("v")], "at").orderBy("at").collect()
    assert [(r.w, r.v) for r in got] == sorted(((r.w, r.v) for r in got), key=lambda x: (-x[0], x[1])) and [r.at for r in got] == list(range(1000))
    assert ordering.ranked(df.limit(0), [F.asc("v")], "at").count() == 0


def brute(rows, window):
    out = {}
    for a, t in rows:
        near = {}
        for b, u in rows:
            if b != a and t <= u <= t + window * 1_000_000:
                near[b] = min(near.get(b, u - t), u - t)
        for b, d in near.items():
            co, sim = out.get((a, b), (0, 0))
            out[a, b] = (co + 1, sim + (d < 1_000_000))
    return out


@pytest.mark.parametrize("seed,stretches", [(1, 8), (2, 1), (3, 50)])
def test_co_occurrence(spark, seed, stretches):
    rng = random.Random(seed)
    # a burst within a second, instants with many templates, hours of silence, times before the epoch
    rows = [(f"t{rng.randrange(300)}", rng.randrange(0, 20) * 50_000) for _ in range(300)]
    rows += [(f"t{rng.randrange(8)}", -3_600_000_000 + rng.randrange(0, 400) * 250_000) for _ in range(300)]
    rows += [("hot", rng.randrange(0, 90_000_000)) for _ in range(400)]
    df = spark.createDataFrame([(t, START) for t, _ in rows[:0]] + [(t, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=u)) for t, u in rows] + [("none", None)], "template_id string, ts timestamp_ntz").repartition(5)
    got = {(r.a, r.b): (r.co, r.sim) for r in correlate.co_occurrence(df, 30, stretches).collect()}
    assert got == brute(rows, 30)


def test_a_sweep_forgets_what_the_window_leaves(monkeypatch):
    sweep = correlate.Sweep(10)
    for k in range(5000):
        t = -k
        code = sweep.code(f"t{k}")
        sweep.see(code, t)
        sweep.count([(code, 1)], t)
    assert sweep.n < 200 and len(sweep.taken()[0]) == 5000 * 10 - 55


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("seed", range(3))
def test_best_matches(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "<*>"] if seed else ["a", "b"]
    side = lambda name, n: [(f"{name}{k:03d}", [rng.choice(words) if rng.random() < 0.8 else f"{name}{k}" for _ in range(rng.choice([1, 3, 7]))]) for k in range(n)]
    a, b = side("A", 70), side("B", 70)
    a += [("A900", ["only", "one", "of", "nine", "tokens", "it", "is", "so", "x"])]
    b += [("B900", ["<*>"] * 8 + ["y"]), ("B901", ["<*>"] * 3), ("B902", ["far"] * 11)]
    th = (0.4, 0.6, 0.95)[seed]
    df = lambda rows: spark.createDataFrame([(i, " ".join(t), t, 1) for i, t in rows], "template_id string, template string, tokens array<string>, count long")
    got = {}
    for r in mining.reconcile(df(a), df(b), th).collect():
        got.setdefault(r.b_id, []).append((r.match, r.a_id, r.score, r.wildcard_pos))
    for i, t in b:
        same = sorted(("exact", j, 1.0, None) for j, u in a if u == t)
        if same:
            assert sorted(got[i]) == same
            continue
        best = min(((-sum(x == y or "<*>" in (x, y) for x, y in zip(t, u)) / len(t), j, u) for j, u in a if len(u) == len(t)), default=(0, "", []))
        if -best[0] < th:
            assert got[i] == [("new", None, 0.0, None)]
            continue
        off = [k for k, (x, y) in enumerate(zip(t, best[2], strict=True)) if not (x == y or "<*>" in (x, y))]
        assert got[i] == [("similar", best[1], -best[0], off[0] if len(off) == 1 else None)]


@pytest.mark.parametrize("block", [3, 10, 50, 4096])
def test_series_in_blocks(spark, monkeypatch, block):
    import numpy as np

    from sawmill.operators import timeseries

    rng = random.Random(block)
    monkeypatch.setattr(timeseries, "BLOCK", block)
    hours = {"a": sorted(rng.sample(range(300), 120)), "b": [5], "c": [0, 1], "d": list(range(100)), "e": [0, 4]}
    rows = [(t, START + dt.timedelta(hours=h), rng.randint(1, 9) if t != "d" else 2) for t, hs in hours.items() for h in hs]
    filled = timeseries.gap_filled(spark.createDataFrame(rows, "template_id string, bucket timestamp_ntz, value long"))
    values = {(t, b): v for t, b, v in rows}
    want = {t: [values.get((t, START + dt.timedelta(hours=h)), 0) for h in range(hs[0], hs[-1] + 1)] for t, hs in hours.items()}
    got = {}
    for r in filled.orderBy("bucket").collect():
        got.setdefault(r.template_id, []).append((r.bucket, r.value))
    assert {t: [v for _, v in x] for t, x in got.items()} == want
    assert all(x[0][0] == START + dt.timedelta(hours=hours[t][0]) for t, x in got.items())
    lagged = {(r.template_id, r.lag): r.value for r in timeseries.autocorrelation(filled, 48, block=block).collect()}
    for t, x in want.items():
        d = np.array(x, float) - np.mean(x)
        lags = range(1, min(len(x) // 2, 48))
        assert {k for n, k in lagged if n == t} == set(lags)
        for k in lags:
            assert abs(lagged[t, k] - (0 if not (d * d).sum() else (d[:-k] * d[k:]).sum() / (d * d).sum())) < 1e-9


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_and_chains(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(30)]
    pairs = {tuple(rng.sample(names, 2)) for _ in range((34, 70)[seed])} | {("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "x4")}
    pairs = {(a, b) for a, b in pairs if (b, a) not in pairs or a < b}
    rows = [(a, b, rng.choice([0.25, 0.5, 0.75]), 10, False, False) for a, b in sorted(pairs)]
    df = spark.createDataFrame(rows, "a string, b string, confidence double, co_count long, is_burst boolean, is_simultaneous boolean")
    pick = lambda d: sorted(map(tuple, d.collect()))
    assert pick(correlate.scc_table(df, here=0)) == pick(correlate.scc_table(df))
    assert pick(correlate.causal_chains(df, here=0)) == pick(correlate.causal_chains(df))
