"""The distributed miner against a naive sequential one, and its parts."""

import random

import pytest

from sawmill.config import Section, Settings, overridden
from sawmill.operators import clustering, mining
from sawmill.plans import analyze as plans

STAR = "<*>"


class Naive:
    """One line after the other, as the semantics are written."""

    def __init__(self, depth, max_child, sim):
        self.depth, self.max_child, self.sim, self.tree, self.templates = depth, max_child, sim, {}, []

    def leaf(self, tokens, make):
        node = self.tree.setdefault(len(tokens), [{}, []]) if make else self.tree.get(len(tokens))
        for t in tokens[: max(0, min(len(tokens), self.depth - 2))]:
            if node is None:
                return None
            kids = node[0]
            if t in kids:
                node = kids[t]
            elif not make:
                node = kids.get(STAR)
            elif len(kids) < self.max_child:
                node = kids[t] = [{}, []]
            else:
                node = kids.setdefault(STAR, [{}, []])
        return node

    def add(self, tokens):
        n, need = len(tokens), len(tokens) - int((1.0 - self.sim) * len(tokens))
        node = self.leaf(tokens, False)
        best, score = None, -1.0
        for k in node[1] if node else ():
            m = sum(a == b or STAR in (a, b) for a, b in zip(tokens, self.templates[k]))
            s = 0.0 if m < need or not m else (1.0 if need == n else (need + 0.001) / n)
            if s >= self.sim and s > score:
                best, score = k, s
        if best is None:
            best = len(self.templates)
            self.templates.append(tokens)
            self.leaf(tokens, True)[1].append(best)
        return best


@pytest.mark.parametrize("seed", range(4))
def test_against_the_naive_miner(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e"] + ([STAR] if seed == 3 else [])
    depth, most, sim = rng.choice([2, 3, 4, 5]), rng.choice([1, 2, 100]), rng.choice([0.3, 0.4, 0.5, 0.9])
    corpus = [[rng.choice(words) for _ in range(rng.randint(1, 5))] for _ in range(160)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "seq long, tokens array<string>")
    options = Section({"depth": depth, "max_child": most, "sim_th": sim})
    assigned = mining.assign_templates(df, options)
    ids = mining.template_ids(df, assigned)
    naive = Naive(depth, most, sim)
    want = [naive.add(t) for t in corpus]
    got = {r.line: r.template for r in assigned.collect()}
    assert [got[" ".join(t)] for t in corpus] == [" ".join(naive.templates[k]) for k in want]
    assert [r.template for r in ids.orderBy("template_id").collect()] == [" ".join(t) for t in naive.templates]


def naive_merge(templates):
    live, last = dict(templates), len(templates)
    while True:
        names = list(live)
        for i, j in ((i, j) for i in range(len(names)) for j in range(i + 1, len(names))):
            a, b = live[names[i]], live[names[j]]
            if len(a) != len(b) or sum(x != y for x, y in zip(a, b)) != 1:
                continue
            p = next(k for k in range(len(a)) if a[k] != b[k])
            if a[p] == STAR:
                del live[names[j]]
            elif b[p] == STAR:
                del live[names[i]]
            else:
                made = [*a[:p], STAR, *a[p + 1 :]]
                if made not in live.values():
                    last += 1
                    live[f"T{last:06d}"] = made
                del live[names[i]], live[names[j]]
            break
        else:
            return list(live.items())


@pytest.mark.parametrize("seed", range(30))
def test_merge_order(seed):
    rng = random.Random(seed)
    lists = list({tuple(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 25))})
    templates = [(f"T{i + 1:06d}", list(t)) for i, t in enumerate(lists)]
    merger = mining.Merger(templates)
    assert merger.run() == naive_merge(templates)
    final = {i for i, _ in merger.run()}
    assert set(merger.lineage().values()) == final


def test_merging_one_position_takes_no_square():
    import time

    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        merger = mining.Merger([(f"T{i:06d}", ["user", f"u{i}", "in", "room", f"r{i % 7}"]) for i in range(n)])
        assert len(merger.run()) == 1
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5])
def test_near_pairs_against_all_pairs(spark, threshold):
    from functools import cache

    rng = random.Random(int(10 * threshold))
    lists = list({tuple(rng.choice("abcdef") for _ in range(rng.randint(1, 12))) for _ in range(90)})

    def edits(a, b):
        @cache
        def d(i, j):
            return max(i, j) if not i or not j else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

        return d(len(a), len(b))

    t = spark.createDataFrame([(f"T{i}", list(x)) for i, x in enumerate(lists)], "template_id string, tokens array<string>")
    got = {(r.a, r.b): r.distance for r in clustering.near_pairs(t, threshold).collect()}
    want = {}
    for i, a in enumerate(lists):
        for j, b in enumerate(lists):
            d = edits(a, b) / max(len(a), len(b))
            if f"T{i}" < f"T{j}" and d < threshold:
                want[f"T{i}", f"T{j}"] = d
    assert got == want


def entries(spark, messages, level="INFO"):
    rows = [(i, None, level if not isinstance(m, tuple) else m[1], f"s{i % 3}", m if not isinstance(m, tuple) else m[0]) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, level string, source string, message string")


def test_known_corpora(spark):
    rows, templates, _ = plans.mine(entries(spark, ["Connection from 192.168.1.1 port 22", "Connection from 10.0.0.1 port 8080", "Connection from 172.16.0.1 port 443"]), Settings())
    t = templates.collect()
    assert [(x.template, x["count"]) for x in t] == [("Connection from <IP> port <NUM>", 3)] and list(t[0].sources) == ["s0", "s1", "s2"]
    rows, templates, merges = plans.mine(entries(spark, [("User ann logged in successfully", "ERROR"), "User bob logged in successfully", "Out of memory"]), overridden(Settings(), {"drain.sim_th": 0.9}))
    got = {x.template: x for x in templates.collect()}
    assert set(got) == {"User <*> logged in successfully", "Out of memory"}
    merged = got["User <*> logged in successfully"]
    assert merged["count"] == 2 and merged.is_error and dict(merged.level_counts) == {"ERROR": 1, "INFO": 1} and merged.main_level == "ERROR" and merges.count() == 2


def test_clusters(spark):
    rows = [("T1", "a b c d", 10), ("T2", "a b c e", 5), ("T3", "x y", 7), ("T4", "a b c d f", 1), ("T5", "x", 1)]
    t = spark.createDataFrame([(i, x, x.split(), n, None, None) for i, x, n in rows], "template_id string, template string, tokens array<string>, count long, first_seen timestamp_ntz, last_seen timestamp_ntz")
    m = clustering.cluster(t, 0.3)
    assert {r.template_id: r.cluster_id for r in m.collect()} == {"T1": "C0001", "T2": "C0001", "T4": "C0001", "T3": "C0002", "T5": "C0003"}
    assert [(r.cluster_id, r.total_count) for r in clustering.cluster_stats(m, t).collect()] == [("C0001", 16), ("C0002", 7), ("C0003", 1)]


def test_leaves_of_a_task(spark):
    rng = random.Random(5)
    tokens = lambda n: [rng.choice(["a", "b", "c", "d", "<*>"] if rng.random() < 0.3 else ["a", "b", "c"]) for _ in range(n)]
    rows = [(f"leaf{i % 70}", i, f"line{i}", tokens(3 + i % 70 % 5), i < 140) for i in range(4000)]
    got = {r.line: r.template for r in mining._solved(spark.createDataFrame(rows, "leaf string, at long, line string, tokens array<string>, seed boolean").repartition(3), 0.4).collect()}
    made = {}
    for leaf, _, line, ts, seed in rows:
        known, need = made.setdefault(leaf, []), mining.min_required(len(ts), 0.4)
        fits = [name for name, other in known if sum(x == y or "<*>" in (x, y) for x, y in zip(ts, other, strict=True)) >= need]
        if seed or not fits:
            known.append((line, ts))
        assert got[line] == (line if seed or not fits else fits[0])
    assert len(got) == 4000 and max(len(x) for x in made.values()) > 5


def test_ids_are_ranked_by_tasks(spark):
    df = spark.createDataFrame([(i, [f"x{i}", "y"]) for i in range(50, 0, -1)], "seq long, tokens array<string>")
    ids = mining.template_ids(df, df.selectExpr("concat_ws(' ', tokens) AS template"), 7)
    assert "SinglePartition" not in ids._jdf.queryExecution().toString()
    assert [(r.template_id, r.created_seq) for r in ids.orderBy("created_seq").collect()] == [(f"T{i + 6:06d}", i) for i in range(1, 51)]
