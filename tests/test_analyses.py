import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sawmill import cli
from sawmill.config import Settings, overridden
from sawmill.operators import alerts, anomaly, correlate, diff, tags, timeseries
from sawmill.plans import analyze as plans
from sawmill.plans import reports
from sawmill.plans.stored import stored
from sawmill.sources import growing, libraries
from sawmill.streaming import incremental

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(t, START + dt.timedelta(seconds=s)) for t, s in rows], "template_id string, ts timestamp_ntz")


def test_series(spark):
    hours = [("a", 3600 * h) for h in range(72) for _ in range(9 if h % 24 == 12 else 1)] + [("b", 0)]
    r = {x.template_id: x for x in timeseries.analyze(events(spark, hours), horizon="corpus").collect()}
    assert r["a"].is_periodic and r["a"].period_hours == 24.0 and len(r["a"].spike_timestamps) == 3 and r["a"].has_spike
    assert r["b"].has_vanished and r["b"].vanished_since == START + dt.timedelta(hours=1)
    assert not timeseries.analyze(events(spark, hours)).where("has_vanished").count()
    assert timeseries.analyze(events(spark, [])).count() == 0


def brute_pairs(rows, window):
    out = {}
    for i, (a, t) in enumerate(rows):
        near = {}
        for b, u in rows:
            if b != a and t <= u <= t + window:
                near[b] = min(near.get(b, u - t), u - t)
        for b, d in near.items():
            co, sim = out.get((a, b), (0, 0))
            out[a, b] = (co + 1, sim + (d < 1))
    return out


def test_co_occurrence_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("abcd"), rng.randrange(0, 4000) / 2) for _ in range(300)]
    got = {(r.a, r.b): (r.co, r.sim) for r in correlate.co_occurrence(events(spark, rows), 30).collect()}
    assert got == brute_pairs(rows, 30)


def test_rules_and_chains(spark):
    rows = [(t, 1000 * i + k * 10) for i in range(20) for k, t in enumerate("abc")] + [("z", 500 + 1000 * i) for i in range(200)]
    s = overridden(Settings(), {"correlate.window_size": 30, "correlate.min_lift": 1.5})
    got = plans.correlate_events(events(spark, rows), s)
    assert {(r.a, r.b) for r in got.significant.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert [list(r.path) for r in got.chains.collect()][0] == ["a", "b", "c"]
    again = plans.correlate_events(events(spark, rows), s, (got.pairs, got.counts))
    assert again.counts.where("template_id = 'a'").first().n == 40
    assert reports.correlation_report(got)["total_events"] == 260
    with pytest.raises(ValueError):
        plans.correlate_events(events(spark, rows), overridden(Settings(), {"correlate.window_size": 1}))
    assert correlate.strongly_connected([("a", "b"), ("b", "a"), ("b", "c")]) == [["a", "b"], ["c"]]
    assert correlate.longest_chains([("a", "b", 0.9), ("b", "a", 0.8), ("b", "c", 0.7)]) == [(["[a, b]", "c"], [0.7], 0.7)]


def test_diff(spark):
    lib = lambda rows: spark.createDataFrame(rows, "template_id string, template string, count long, is_error boolean")
    c = diff.compare(lib([("1", "a", 1, False), ("2", "b", 10, False), ("3", "c", 0, False), ("9", "", 5, True)]), lib([("1", "a", 5, False), ("4", "d", 2, True), ("3", "c", 4, False)]))
    got = {r.template: (r.bucket, r.count_change) for r in c.collect()}
    assert got == {"a": ("increased", 4.0), "b": ("removed", -1.0), "c": ("increased", float("inf")), "d": ("added", float("inf"))}
    assert diff.exit_code(c).first().exit_code == 1 and diff.exit_code(c.where("template = 'a'")).first().exit_code == 2 and diff.exit_code(c.limit(0)).first().exit_code == 0


def test_alerts_and_tags(spark):
    m = spark.createDataFrame([(15, 8, 12, 42, 20000.0)], "new_template_count long, error_template_count long, spike_count long, total_templates long, processing_speed double")
    assert [a["name"] for a in alerts.triggered(m, Settings().alerts)] == ["high_error_templates", "spike_surge", "slow_processing"]
    assert "8" in alerts.triggered(m, Settings().alerts)[0]["message"]
    rules = [{"name": n, "condition": c} for n, c in (("x", "open('f')"), ("y", "spike_count / 0"), ("z", "abs(-1) < min(2, spike_count) and not False"), ("w", "1 +"), ("v", "0 < spike_count <= 12"))]
    assert [a["name"] for a in alerts.triggered(m, rules)] == ["z", "v"]
    assert alerts.interpolated("{spike_count:.1f} {nope}", {"spike_count": 2}) == "{spike_count:.1f} {nope}"
    t = spark.createDataFrame([("ERROR Database connection failed, retrying...",), ("INFO User login successful",), ("FATAL Out of memory exception",)], "template string")
    t = t.withColumn("tags", tags.tags_of(F.col("template"), Settings().tags))
    assert [list(r.tags) for r in t.collect()] == [["error/general", "infra/database/connection"], [], ["error/general", "infra/resource/memory"]]
    assert tags.filtered(t, "infra").count() == 2 and tags.filtered(t, "infra", False).count() == 0
    assert {r.tag: r.n for r in tags.tag_counts(t).collect()} == {"error": 2, "error/general": 2, "infra": 2, "infra/database": 1, "infra/database/connection": 1, "infra/resource": 1, "infra/resource/memory": 1}


LINES = [f"2024-01-15 10:{i % 60:02d}:01 {'ERROR' if i % 5 == 0 else 'INFO'} srv request {i} took {i * 7} ms on node{i % 2}" for i in range(60)] + ["2024-01-15 12:00:00 INFO srv started fine"]


def test_analysis_and_reports(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(LINES) + "\n")
    base = spark.createDataFrame([("T9", "started fine")], "template_id string, template string")
    a = plans.analyze_files(spark, [str(tmp_path / "x.log")], Settings(), 2024, baseline=base)
    report = reports.json_report(a, timeseries.gap_filled(timeseries.counts(a.rows.select("template_id", "ts"))))
    assert report["summary"]["total_logs"] == 61 and sum(t["stats"]["count"] for t in report["templates"]) == 61
    assert [t["template_str"] for t in report["templates"] if t["is_new"]] and report["anomalies"]["data_insufficient"]
    assert not any(t["is_new"] for t in report["templates"] if t["template_str"] == "started fine")
    path = reports.write_json(report | {"odd": float("inf")}, str(tmp_path / "out/report.json"))
    assert json.loads(open(path).read())["odd"] is None
    assert "<svg" in reports.html_report(report) and "lines" in reports.text_report(report)
    lib = libraries.load_library(spark, path)
    assert lib.count() == len(report["templates"]) and libraries.load_baseline(spark, str(tmp_path / "nope.json")) is None
    a.register("v_")
    assert spark.sql("select sum(count) n from v_templates").first().n == 61
    assert anomaly.whitelisted(a.templates, ["started"]).count() == a.templates.count() - 1


def test_state_shapes(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"version": "1.0", "drain_state": {"templates": {"T1": {"template_str": "a", "stats": {"count": 3, "level_counts": {"ERROR": 1}, "first_seen": "2024-01-01T00:00:00", "last_seen": "2024-01-01T00:00:10"}}}}}))
    assert libraries.is_state_file(spark, str(tmp_path / "s.json"))
    lib = libraries.load_library(spark, str(tmp_path / "s.json"))
    assert lib.first().is_error and lib.first()["count"] == 3
    made = libraries.synthetic_events(lib.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in ("first_seen", "last_seen")}))
    assert [r.ts.second for r in made.orderBy("ts").collect()] == [0, 5, 10]
    assert libraries.template_dicts({"templates": [{"template_id": "x"}, 5]}) == [{"template_id": "x"}] and libraries.template_dicts([]) == []


def test_library_by_lines(spark, tmp_path, monkeypatch):
    made = [{"template_id": f"T{i}", "template_str": f"a, {i}", "stats": {"count": i, "level_counts": {"ERROR" if i % 7 == 0 else "INFO": 1}}} for i in range(500)]
    path = str(tmp_path / "lib")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    libraries.save_library(spark.createDataFrame([(i, json.dumps(t)) for i, t in reversed(list(enumerate(made)))], "rank long, value string").repartition(5), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "lib").glob("part-*"))
    assert len(files) > 1 and json.loads("".join(f.read_text() for f in files)) == {"templates": made}

    def whole(spark, path):
        raise AssertionError("read on the driver")

    monkeypatch.setattr(libraries, "text_of_file", whole)
    lib = libraries.load_library(spark, path).orderBy("rank").collect()
    assert lib == libraries.library(spark, {"templates": made}).collect()
    libraries.save_library(spark.createDataFrame([], "rank long, value string"), str(tmp_path / "none"))
    assert libraries.load_library(spark, str(tmp_path / "none")).count() == 0
    for k, broken in enumerate(('{"template_id":"a"}\n{"template_id":"b"}', '{"template_id":"a"},', '{"template_id":', "")):
        at = tmp_path / f"broken{k}.json"
        at.write_text('{"templates":[\n' + broken + "\n]}\n" if broken else ']}\n{"templates":[\n')
        with pytest.raises(ValueError):
            libraries.load_library(spark, str(at))
        assert libraries.load_baseline(spark, str(at)) is None


def test_incremental_equals_batch(spark, tmp_path):
    from sawmill.sources.lines import from_iterable, parsed

    s = Settings()
    e = parsed(from_iterable(spark, LINES), s.input, 2024)
    whole = incremental.advance(incremental.empty_state(spark), e, s)
    half = incremental.advance(stored(incremental.advance(incremental.empty_state(spark), e.where("seq < 30"), s), "half"), e.where("seq >= 30"), s)
    assert {(r.template_id, r.template, r["count"]) for r in whole.collect()} == {(r.template_id, r.template, r["count"]) for r in half.collect()}


def test_growing_files(spark, tmp_path):
    log = tmp_path / "g.log"
    log.write_text("".join(x + "\n" for x in LINES[:10]) + "half a li")
    spark.dataSource.register(growing.GrowingFiles)
    stream = lambda: spark.readStream.format("growing_files").option("path", str(log)).load()

    def once():
        q = incremental.mine_stream(stream(), Settings(), str(tmp_path / "state"), str(tmp_path / "cp"), 2024, available_now=False)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return incremental.current_state(spark, str(tmp_path / "state")).agg(F.sum("count").alias("n")).first().n

    assert once() == 10
    with log.open("a") as f:
        f.write("ne\n" + LINES[11] + "\n")
    assert once() == 12


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["init-config", str(tmp_path / "c.yaml")]) == 0
    for name, n in (("old", 1), ("new", 9)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"T1": {"template_str": "a", "count": n}}))
    assert cli.main(["diff", str(tmp_path / "old.json"), str(tmp_path / "new.json")]) == 2
    assert cli.main(["diff", str(tmp_path / "old.json"), str(tmp_path / "new.json"), "--no-exit-code", "--format", "json"]) == 0
    assert "increased" in capsys.readouterr().out


def test_terminal_forms(spark, tmp_path, capsys):
    (tmp_path / "x.log").write_text("\n".join([f"2024-01-15 10:{i:02d}:0{k} {'ERROR' if k else 'INFO'} srv {w} number {i} <b>&" for i in range(50) for k, w in enumerate(("alpha begins", "beta ends"))]) + "\n")
    args = [str(tmp_path / "x.log"), "--output-dir", str(tmp_path / "out"), "--format"]
    assert cli.main(["analyze", *args, "all"]) == 0
    shown, page = capsys.readouterr().out, (tmp_path / "out/report.html").read_text()
    for words in ("模板聚类组", "最近创建的模板", "活跃时间最长的模板", "49.0分钟", "错误", "2024-01-15 10:49:01", "ERROR", "INFO", "C0001"):
        assert words in shown and (words in page or words == "模板聚类组")
    assert "&lt;b&gt;&amp;" in page and "<b>&" not in page and "<b>&" in shown
    opts = ["--window", "5", "--min-support", "0.01", "--min-lift", "1", "--min-confidence", "0.1"]
    assert cli.main(["correlate", str(tmp_path / "x.log"), *opts]) == 0
    assert "总事件数" in capsys.readouterr().out
    assert cli.main(["correlate", str(tmp_path / "x.log"), *opts, "--format", "json", "--top", "1"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["summary"]["total_events"] == 100 and len(got["rules"]) <= 1
    report = {"summary": dict.fromkeys(("total_events", "template_count", "filtered_template_count", "rule_count", "burst_template_count", "chain_count"), 1234), "rules": [{"a": "T1", "b": "T2", "support": 0.5, "confidence": 0.25, "lift": 2.0, "chi2": 4.0, "jaccard": 0.9, "is_strong_correlation": True, "is_burst": False, "is_simultaneous": True}], "chains": [{"path": ["T1", "[T2, T3]"], "edge_weights": [0.25], "total_confidence": 0.25, "length": 2}]}
    text = reports.correlation_text(report, {"T1": "one", "T2": "two"})
    assert "1,234" in text and "强关联 同时" in text and "one → two" in text and "[T2, T3]" in text and "累计conf=0.2500" in text
    for name, lib in (("old", {"T1": {"template_str": "a", "count": 1}, "T2": {"template_str": "gone", "count": 3}}), ("new", {"T1": {"template_str": "a", "count": 9}, "T3": {"template_str": "made", "count": 2, "is_error": True}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(lib))
    assert cli.main(["diff", str(tmp_path / "old.json"), str(tmp_path / "new.json"), "-o", str(tmp_path / "d/diff.json")]) == 1
    shown = capsys.readouterr().out
    assert all(w in shown for w in ("旧版本日志总数: 4", "新版本日志总数: 11", "新增模板: 1 个", "消失模板: 1 个", "显著增加: 1 个", "+800.0%", "∞", "exit code: 1"))
    assert [r["template"] for r in json.loads((tmp_path / "d/diff.json").read_text())["added_templates"]] == ["made"]
