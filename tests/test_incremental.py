"""Batches of growing files, the versioned state, and mining that goes on from it, against plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sawmill import cli
from sawmill.config import Section, Settings, overridden
from sawmill.operators import mining
from sawmill.plans import analyze as plans
from sawmill.plans.stored import stored
from sawmill.sources import growing, libraries
from sawmill.sources.lines import from_iterable, parsed
from sawmill.sources.state import Conflict, StateStore
from tests.test_mining import STAR, Naive


def read(spark, path, offsets=None, **options):
    lines, after = growing.incremental_append(spark, [str(path)], offsets, **options)
    return [(r.path.rsplit("/", 1)[1], r.position, r.value) for r in lines.orderBy("seq").collect()], stored(after, "offsets")


def test_append_shrink_replace_and_unfinished_lines(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("a.log", b"one\r\ntwo\n\nthree\n")
    put("b.log", b"x\nunfinished")
    put("c.log", b"c1\nc2\n")
    put("d.log", b"")
    got, offsets = read(spark, tmp_path / "*.log", unfinished="wait")
    assert got == [("a.log", 0, "one"), ("a.log", 5, "two"), ("a.log", 9, ""), ("a.log", 10, "three"), ("b.log", 0, "x"), ("c.log", 0, "c1"), ("c.log", 3, "c2")]
    assert read(spark, tmp_path / "*.log", offsets, unfinished="wait")[0] == []
    put("a.log", b"one\r\ntwo\n\nthree\nfour\n")  # appended to
    put("b.log", b"x\nunfinished no more\n")  # the last line is finished
    put("c.log", b"c1\n")  # cut
    put("d.log", b"\xff\xfe bad\n")
    put("e.log", b"new\n")
    got, offsets = read(spark, tmp_path / "*.log", offsets, unfinished="wait")
    assert got == [("a.log", 16, "four"), ("b.log", 2, "unfinished no more"), ("c.log", 0, "c1"), ("d.log", 0, "�� bad"), ("e.log", 0, "new")]
    put("a.log", b"ONE\ntwo\n\nthree\nfour\nand more than before\n")  # replaced, and longer
    assert [x[:2] for x in read(spark, tmp_path / "a.log", offsets)[0]] == [("a.log", p) for p in (0, 4, 8, 9, 15, 20)]
    put("f.log", b"p\nq")
    got, offsets = read(spark, tmp_path / "f.log")
    assert got == [("f.log", 0, "p"), ("f.log", 2, "q")]
    put("f.log", b"p\nqr\n")  # read as it was; the rest of it comes as a line of its own
    assert read(spark, tmp_path / "f.log", offsets)[0] == [("f.log", 3, "r")]
    with pytest.raises(ValueError):
        growing.pending(spark, [str(tmp_path)], unfinished="other")


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1000])
def test_chunks_cut_no_line(spark, tmp_path, monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(60)]
    (tmp_path / "x.log").write_text("\n".join(texts) + rng.choice(["", "\n"]), "utf-8")
    want = (tmp_path / "x.log").read_text("utf-8").split("\n")
    want = want[:-1] if want[-1] == "" else want
    monkeypatch.setattr(growing, "BLOCK", 16)
    files = stored(growing.pending(spark, [str(tmp_path / "x.log")]), "files")
    got = growing.read_pending(files, chunk).orderBy("seq").collect()
    assert [r.value for r in got] == want and len({r.seq for r in got}) == len(got)
    after = files.withColumn("start", F.lit(len((texts[0] + "\n").encode())).cast("bigint"))  # goes on behind the first line
    assert [r.value for r in growing.read_pending(after, chunk).orderBy("seq").collect()] == want[1:]


def test_written_files_and_their_order(spark, tmp_path):
    df = spark.createDataFrame([(f"f{k % 3}.log", k, f"line {k}") for k in range(50)], "name string, seq long, value string").repartition(4)
    assert {r.name: r.bytes for r in growing.write_files(df, str(tmp_path)).collect()} == {f"f{i}.log": (tmp_path / f"f{i}.log").stat().st_size for i in range(3)}
    lines, _ = growing.incremental_append(spark, [str(tmp_path / "f2.log"), str(tmp_path / "f0.log"), str(tmp_path)])
    got = [r.value for r in lines.orderBy("seq").collect()]
    assert got == [f"line {k}" for first in (2, 0, 1) for k in range(first, 50, 3)]


class NaiveState(Naive):
    """Batches one after the other: a tree that stays, templates that merge after each batch."""

    def __init__(self, depth, max_child, sim):
        super().__init__(depth, max_child, sim)
        self.names, self.live, self.counter, self.counts = [], {}, 0, {}

    def batch(self, lists):
        for tokens in lists:
            at = self.add(tokens)
            if at == len(self.names):
                self.counter += 1
                self.names.append(f"T{self.counter:06d}")
                self.live[self.names[at]] = at
            name = self.names[at]
            self.counts[name] = self.counts.get(name, 0) + 1
        merger = mining.Merger([(n, self.templates[k]) for n, k in self.live.items()], self.counter)
        final = merger.run()
        self.counter = merger.last
        for gone, into, _ in merger.events:
            self.counts[into] = self.counts.get(into, 0) + self.counts.pop(gone)
            if gone in self.live:
                self.forget(self.live.pop(gone))
        for name, tokens in final:
            if name not in self.live:
                self.live[name] = len(self.templates)
                self.names.append(name)
                self.templates.append(tokens)
                self.leaf(tokens, True)[1].append(self.live[name])
        # templates that were made and merged away within the pass shaped the tree too, in order of their ids
        self.live = dict(sorted(self.live.items()))

    def forget(self, at):
        def walk(node):
            if at in node[1]:
                node[1].remove(at)
            for kid in node[0].values():
                walk(kid)

        for node in self.tree.values():
            walk(node)

    def rows(self):
        return {n: (" ".join(self.templates[k]), self.counts[n]) for n, k in self.live.items()}


def as_entries(spark, lists, first=0):
    rows = [(first + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=first + i), "ERROR" if i % 7 == 0 else "INFO", f"s{i % 3}", " ".join(t)) for i, t in enumerate(lists)]
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, level string, source string, message string")


@pytest.mark.parametrize("seed", range(3))
def test_batches_against_the_naive_miner(spark, tmp_path, seed):
    rng = random.Random(seed)
    settings = overridden(Settings(), {"drain.max_child": rng.choice([2, 100]), "drain.sim_th": (0.5, 0.8, 0.9)[seed], "drain.depth": 4})
    naive = NaiveState(4, settings.drain.max_child, settings.drain.sim_th)
    store = StateStore(spark, str(tmp_path / "state"))
    # words that no mask changes; leading words are few, so that merged templates seldom have a leading wildcard
    batches = [[[rng.choice("ab"), rng.choice("cd"), *[rng.choice("efghij") for _ in range(rng.randint(0, 3))]] for _ in range(40)] for _ in range(3)]
    for k, lists in enumerate(batches):
        naive.batch(lists)
        plans.advance_state(store, as_entries(spark, lists, 1000 * k), settings, batch=str(k))
        plans.advance_state(store, as_entries(spark, lists, 1000 * k), settings, batch=str(k))  # again: adds nothing
        got = {r.template_id: (r.template, r["count"]) for r in store.templates().collect()}
        assert got == naive.rows() and store.manifest()["counter"] == naive.counter
    total = store.templates().agg(F.sum("count").alias("n"), F.min("first_seen").alias("a"), F.max("last_seen").alias("z")).first()
    assert (total.n, total.a, total.z) == (120, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=2039))
    levels = store.templates().select(F.explode("level_counts").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("n")).collect()
    assert {r.k: r.n for r in levels} == {"ERROR": 18, "INFO": 102}
    events = store.events().groupBy("event_type").count().collect()
    assert {r.event_type for r in events} == {"created", "merged"} and store.events().select("template_id", "event_type").distinct().count() == store.events().count()


def test_versions_survive_crashes(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.manifest()["counter"] == 0 and store.templates().count() == 0 and store.offsets().count() == 0
    lists = [["job", w, "done"] for w in "abcabcddd"]
    settings = overridden(Settings(), {"drain.sim_th": 0.9})
    plans.advance_state(store, as_entries(spark, lists), settings, batch="0", merge=False)
    rows = lambda: sorted((r.template_id, r.template, r["count"], r.first_seen, r.last_seen, sorted(r.level_counts.items()), r.sources) for r in store.templates().collect())
    before = rows()
    offsets = spark.createDataFrame([("file:/x", 10, 3, "h")], growing.OFFSETS)
    write, publish = StateStore._write, StateStore._publish

    for crash in range(4):  # after each write, and just before the manifest has its name
        left = [crash]

        def dying(self, *a, left=left, **k):
            if left[0] == 0:
                raise OSError("lost")
            left[0] -= 1
            return write(self, *a, **k)

        monkeypatch.setattr(StateStore, "_write", dying)
        if crash == 3:
            monkeypatch.setattr(StateStore, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            plans.advance_state(store, as_entries(spark, lists, 100), settings, offsets, "1", merge=False)
        monkeypatch.setattr(StateStore, "_write", write)
        monkeypatch.setattr(StateStore, "_publish", publish)
        assert rows() == before and store.offsets().count() == 0 and store.manifest()["counter"] == 4
    plans.advance_state(store, as_entries(spark, lists, 100), settings, offsets, "1", merge=False)
    after = rows()
    assert [x[2] for x in after] == [2 * x[2] for x in before] and store.offsets().first().offset == 10 and store.manifest()["counter"] == 4
    with pytest.raises(Conflict):
        store.commit(9, base=store.manifest(1))
    assert store.expire() > 0  # what the crashes left
    store.commit(4, offsets=spark.createDataFrame([("file:/x", 20, 3, "h")], growing.OFFSETS))
    store.compact()
    assert rows() == after and store.offsets().first().offset == 20 and max(len(x) for x in store.manifest()["tables"].values()) == 1
    assert store.events().count() == 4
    store.expire(1)
    assert rows() == after and len(store.versions()) == 1
    for k in range(12):  # compaction sets in by itself
        store.commit(4, offsets=spark.createDataFrame([("file:/x", 30 + k, 3, "h")], growing.OFFSETS))
    assert rows() == after and store.offsets().first().offset == 41 and max(len(x) for x in store.manifest()["tables"].values()) <= 9


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    settings = overridden(Settings(), {"drain.sim_th": 0.9})
    plans.advance_state(store, as_entries(spark, [["job", w, "done"] for w in "abcdef"]), settings, merge=False)
    made = plans.advance_state(store, as_entries(spark, [["job", "a", "done"], ["other", "one"]], 50), settings, merge=False)[1]
    assert spark.read.parquet(f"{store.path}/{made['tables']['templates'][-1]}").count() == 2


def test_state_of_another_engine(spark, tmp_path):
    t = lambda name, text, n: {"template_id": name, "template_str": text, "tokens": text.split(), "stats": {"count": n, "first_seen": "2024-01-01T00:00:00", "last_seen": "2024-01-01T00:00:10", "level_counts": {"INFO": n}, "sources": ["a"]}, "is_error": False}
    log = tmp_path / "x.log"
    log.write_text("2024-01-15 10:00:00 INFO srv disk sda is full now\n2024-01-15 10:00:01 ERROR srv other thing\n")
    first = len(log.read_text().split("\n")[0]) + 1
    state = {
        "version": "1.0",
        "drain_state": {"template_counter": 7, "templates": {"T000003": t("T000003", "disk sda is full now", 5)}, "root": {}, "events": [{"timestamp": "2024-01-01T00:00:00", "event_type": "created", "template_id": "T000003", "related_template_id": "", "details": "d"}]},
        "file_offsets": {str(log): {"path": str(log), "offset": first, "inode": 5}},
    }
    (tmp_path / "s.json").write_text(json.dumps(state))
    folder = plans.state_folder(spark, str(tmp_path / "s.json"))
    store = StateStore(spark, folder)
    assert store.manifest()["counter"] == 7 and store.events().first().details == "d" and store.offsets().first().offset == first
    a = plans.analyze_incremental(spark, [str(log)], folder, year=2024)
    got = {r.template_id: (r.template, r["count"], r.is_new) for r in a.templates.collect()}
    assert got == {"T000003": ("disk sda is full now", 5, False), "T000008": ("other thing", 1, True)} and a.total_logs == 1
    assert StateStore(spark, str(tmp_path / "none")).load_json("{broken")["version"] == 0
    assert libraries.load_library(spark, folder).count() == 2 and libraries.is_state_file(spark, folder)


def test_command_line_goes_on(spark, tmp_path, capsys):
    log, state = tmp_path / "x.log", str(tmp_path / "state")
    line = "2024-01-15 10:{:02d}:01 INFO srv request {} took 5 ms\n"
    log.write_text("".join(line.format(i, i) for i in range(10)))
    run = lambda *more: cli.main(["analyze", str(log), "--state", state, "--incremental", "--format", "json", "--output-dir", str(tmp_path / "out"), *more])
    report = lambda: json.loads((tmp_path / "out/report.json").read_text())
    assert run() == 0 and report()["summary"]["total_logs"] == 10
    with log.open("a") as f:
        f.write(line.format(50, 5) + "2024-01-15 11:00:00 ERROR srv something else broke\n")
    assert run() == 0
    got = {t["template_str"]: (t["stats"]["count"], t["is_new"]) for t in report()["templates"]}
    assert got == {"request <NUM> took <NUM> ms": (11, False), "something else broke": (1, True)} and report()["summary"]["total_logs"] == 2
    assert cli.main(["save-state", str(log), "--state", state]) == 0  # without --incremental it starts over
    assert StateStore(spark, state).templates().agg(F.sum("count").alias("n")).first().n == 12


@pytest.mark.parametrize("seed", range(3))
def test_large_leaves_in_rounds(spark, seed):
    rng = random.Random(seed)
    sim = rng.choice([0.4, 0.6, 0.9])
    corpus = [["x", "y", *[rng.choice("abcdefg" + (STAR if k % 50 == 0 else "")) for _ in range(rng.choice([4, 6]))]] for k in range(300)]
    corpus = [[*t[:2], *[STAR if w == STAR[0] else w for w in t[2:]]] for t in corpus]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "seq long, tokens array<string>")
    options = Section({"depth": 4, "max_child": 100, "sim_th": sim})
    rows = lambda d: sorted(map(tuple, d.collect()))
    naive = Naive(4, 100, sim)
    for t in corpus:
        naive.add(t)
    whole, rounds = rows(mining.assign_templates(df, options)), rows(mining.assign_templates(df, options, hot=20, block=16))
    assert whole == rounds and {t for _, t in whole} == {" ".join(t) for t in naive.templates}


def test_parsed_lines_from_a_stream_state(spark, tmp_path):
    e = parsed(from_iterable(spark, ["2024-01-15 10:00:01 INFO srv request 1"]), Settings().input, 2024)
    store = StateStore(spark, str(tmp_path))
    assert plans.advance_state(store, e, Settings(), batch="a")[0] is not None and plans.advance_state(store, e, Settings(), batch="a")[0] is None


def test_silence_is_reported_once_whatever_the_batches(spark, tmp_path):
    from sawmill.streaming import vanishing

    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = sorted((start + dt.timedelta(minutes=rng.randrange(0, 6000)), f"t{rng.randrange(12)}") for _ in range(200))
    want, newest = [], rows[-1][0]
    for t in {t for _, t in rows}:
        times = [at for at, x in rows if x == t]
        want += [(t, a) for a, b in zip(times, [*times[1:], None], strict=True) if (a + dt.timedelta(hours=10) <= newest - dt.timedelta(minutes=10) if b is None else b - a > dt.timedelta(hours=10))]
    stream = lambda: spark.readStream.schema("template_id string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    for k in range(4):  # each run goes on from the checkpoint of the one before
        part = rows[50 * k : 50 * k + 50]
        rng.shuffle(part)
        spark.createDataFrame([(t, at) for at, t in part], "template_id string, ts timestamp_ntz").write.mode("append").parquet(str(tmp_path / "in"))
        vanishing.to_table(vanishing.vanished(stream(), "10 hours", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [(r.template_id, r.vanished_since) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 30
