"""Reports of an analysis: JSON, HTML with charts, plain text; driver-side, over tables of templates."""

from __future__ import annotations

import datetime
import html
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.plans.analyze import Analysis, Correlation

# Words of the reports.
UNKNOWN = "未知"
STATUS = [("is_new", "新模板"), ("is_error", "错误"), ("is_spike", "激增"), ("is_vanished", "消失"), ("is_periodic", "周期"), ("is_rare", "稀有")]
NORMAL = "正常"


def status_text(columns: list[str]) -> Column:
    """The words of a template's flags, comma-separated; one word if it has none."""
    words = [F.when(F.col(c), w) for c, w in STATUS if c in columns]
    joined = F.concat_ws(", ", *words)
    return F.when(joined == "", NORMAL).otherwise(joined)


def top_templates(templates: DataFrame, n: int = 20) -> DataFrame:
    cut = F.when(F.char_length("template") > 80, F.concat(F.substring("template", 1, 77), F.lit("..."))).otherwise(F.col("template"))
    return templates.orderBy(F.desc("count"), "template_id").limit(n).select("template_id", "count", "main_level", cut.alias("template"), status_text(templates.columns).alias("status"))


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes, hours or days; halves of the last digit are rounded up."""
    return (
        F.when(seconds < 60, F.format_string("%.0f秒", seconds)).when(seconds < 3600, F.format_string("%.1f分钟", seconds / 60))
        .when(seconds < 86400, F.format_string("%.1f小时", seconds / 3600)).otherwise(F.format_string("%.1f天", seconds / 86400))
    )


def evolution(lifecycle: DataFrame, templates: DataFrame, n: int = 5) -> DataFrame:
    """(part, rank, template_id, at): the latest created, the latest merged or compressed, the longest active."""
    from pyspark.sql import Window

    created = lifecycle.where("event_type = 'created'").select(F.lit("created").alias("part"), "template_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("at").cast("string").alias("k"))
    dead = lifecycle.where("event_type <> 'created'").select(F.lit("ended").alias("part"), "template_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce(F.col("at").cast("string"), F.lit("")).alias("k"))
    active = F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))
    longest = templates.select(F.lit("longest").alias("part"), "template_id", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lpad(active.cast("string"), 20, "0").alias("k"))
    all_parts = created.unionByName(dead).unionByName(longest)
    return all_parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("k"), "template_id"))).where(F.col("rank") <= n).drop("k")


def totals(rows: DataFrame, templates: DataFrame, clusters: DataFrame, seconds: float) -> DataFrame:
    """One row: total_logs, total_templates, total_clusters (of rows that name a cluster_id) and lines a second."""
    n = rows.agg(F.count("*").alias("total_logs"))
    t = templates.agg(F.count("*").alias("total_templates"))
    c = clusters.agg(F.countDistinct("cluster_id").alias("total_clusters"))
    return n.join(t, F.lit(True)).join(c, F.lit(True)).withColumn("processing_speed", F.col("total_logs") / F.lit(max(seconds, 0.001)))


def summary(a: Analysis) -> dict[str, Any]:
    r = totals(a.rows, a.templates, a.clusters, a.seconds).first().asDict()
    return {**r, "duration_seconds": a.seconds, "generated_at": datetime.datetime.now().isoformat()}


def _iso(x: Any) -> Any:
    return x.isoformat() if isinstance(x, (datetime.datetime, datetime.date)) else x


def _template(r: Any) -> dict[str, Any]:
    stats = {"count": r["count"], "first_seen": _iso(r.first_seen), "last_seen": _iso(r.last_seen), "level_counts": r.level_counts, "sources": r.sources}
    flags = {k: bool(r[k]) for k in ("is_new", "is_error", "is_periodic", "is_spike", "is_vanished", "is_rare")}
    return {"template_id": r.template_id, "template_str": r.template, "tokens": r.tokens, "stats": stats, "main_level": r.main_level, **flags, "cluster_id": r.cluster_id, "tags": r.tags}


def json_report(a: Analysis, points: DataFrame | None = None) -> dict[str, Any]:
    """The whole report; ``points``: gap-filled series (template_id, bucket, value) to include."""
    rows = [_template(r) for r in a.templates.orderBy(F.desc("count"), "template_id").collect()]
    having = lambda flag: [t["template_id"] for t in rows if t[flag]]
    series = a.series.orderBy("template_id").collect()
    lacking = not any(s.sufficient for s in series)
    data: dict[str, list] = {}
    if points is not None:
        for p in points.orderBy("template_id", "bucket").collect():
            data.setdefault(p.template_id, []).append({"timestamp": _iso(p.bucket), "value": p.value})
    anomalies = {k: having(f) for k, f in (("new_templates", "is_new"), ("error_templates", "is_error"), ("spike_templates", "is_spike"), ("vanished_templates", "is_vanished"), ("periodic_templates", "is_periodic"))}
    clusters = [{k: _iso(v) for k, v in c.asDict().items()} for c in a.clusters.collect()]
    out = {
        "summary": summary(a), "templates": rows, "clusters": clusters,
        "anomalies": {"has_anomaly": any(anomalies.values()), **anomalies, "data_insufficient": lacking, "data_insufficient_message": _lack(lacking)},
        "time_series": {s.template_id: {
            "template_id": s.template_id, "is_periodic": s.is_periodic, "periodicity_hours": s.period_hours, "has_spike": s.has_spike,
            "spike_timestamps": [_iso(x) for x in s.spike_timestamps], "has_vanished": s.has_vanished, "vanished_since": _iso(s.vanished_since),
            "mean": s["mean"], "std": s["std"], "data_points": data.get(s.template_id, []),
        } for s in series},
        "events": [{k: _iso(v) for k, v in e.asDict().items()} for e in a.lifecycle.orderBy("at", "event_type", "template_id").collect()],
    }
    if a.alerts:
        out["triggered_alerts"] = a.alerts
    return out


def _lack(lacking: bool) -> str:
    from sawmill.operators.anomaly import INSUFFICIENT

    return INSUFFICIENT.format(n=24) if lacking else ""


def write_json(report: Any, path: str) -> str:
    """Infinite numbers become null, which JSON has no token for."""

    def finite(x: Any) -> Any:
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: finite(v) for k, v in x.items()}
        return [finite(v) for v in x] if isinstance(x, list) else x

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(finite(report), ensure_ascii=False, indent=2), "utf-8")
    return path


def chart_points(filled: DataFrame, width: float = 600.0, height: float = 100.0) -> DataFrame:
    """(template_id, bucket, x, y): each series spread over the width and scaled to its maximum, y downwards."""
    from pyspark.sql import Window

    w = Window.partitionBy("template_id")
    i = F.row_number().over(w.orderBy("bucket")) - 1
    n, top = F.count("*").over(w), F.greatest(F.max("value").over(w), F.lit(1))
    return filled.select("template_id", "bucket", F.when(n > 1, i * width / (n - 1)).otherwise(width / 2).alias("x"), (height - F.col("value") * height / top).alias("y"))


def svg(points: list[tuple[float, float]], marks: set[int] = frozenset(), width: int = 600, height: int = 100) -> str:
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in points)
    dots = "".join(f'<circle cx="{points[i][0]:.1f}" cy="{points[i][1]:.1f}" r="3" fill="red"/>' for i in sorted(marks) if i < len(points))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="steelblue" points="{line}"/>{dots}</svg>'


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def _time(iso: str | None) -> str:
    return iso[:19].replace("T", " ") if iso else UNKNOWN


def _status(t: dict) -> str:
    return ", ".join(w for f, w in STATUS if t.get(f)) or NORMAL


def _badges(tags: list[str] | None, most: int = 3) -> str:
    found = tags or []
    return " ".join(f"[{x}]" for x in found[:most]) + (f" +{len(found) - most}" if len(found) > most else "")


def _lasted(seconds: float) -> str:
    for most, size, unit, digits in ((60, 1, "秒", 0), (3600, 60, "分钟", 1), (86400, 3600, "小时", 1)):
        if seconds < most:
            return f"{seconds / size:.{digits}f}{unit}"
    return f"{seconds / 86400:.1f}天"


def evolution_of(report: dict[str, Any], n: int = 5) -> dict[str, list[tuple]]:
    """created: (time, id, details), ended: (time, kind, id, related id, details), both latest first; longest: (id, how long,
    first, last, count, template) of the longest active."""
    at = lambda e: e["at"] or ""
    latest = lambda *kinds: sorted((e for e in report["events"] if e["event_type"] in kinds), key=at, reverse=True)[:n]
    parse = datetime.datetime.fromisoformat
    spans = [((parse(t["stats"]["last_seen"]) - parse(t["stats"]["first_seen"])).total_seconds(), t) for t in report["templates"] if t["stats"]["first_seen"]]
    longest = sorted(spans, key=lambda x: -x[0])[:n]
    return {
        "created": [(_time(e["at"]), e["template_id"], e["details"][:80]) for e in latest("created")],
        "ended": [(_time(e["at"]), "合并" if e["event_type"] == "merged" else "压缩", e["template_id"], e["related_template_id"] or "-", e["details"][:80]) for e in latest("merged", "compressed")],
        "longest": [(t["template_id"], _lasted(max(0.0, d)), _time(t["stats"]["first_seen"]), _time(t["stats"]["last_seen"]), f"{t['stats']['count']:,}", _cut(t["template_str"], 63)) for d, t in longest],
    }


_COLUMNS = {
    "templates": ("#", "模板ID", "频率", "级别", "标签", "模板内容", "状态"),
    "clusters": ("组ID", "总频率", "模板数", "代表模板", "首次出现", "最近出现"),
    "created": ("时间", "模板ID", "详情"),
    "ended": ("时间", "类型", "模板ID", "关联ID", "详情"),
    "longest": ("模板ID", "活跃时长", "首次出现", "最后活跃", "频率", "模板内容"),
}
_TITLES = {"created": "最近创建的模板", "ended": "最近消亡的模板", "longest": "活跃时间最长的模板"}


def _tables(report: dict[str, Any], top: int, clusters: int = 20) -> dict[str, list[tuple]]:
    """The rows of each table of a report."""
    templates = [(i, t["template_id"], f"{t['stats']['count']:,}", t.get("main_level") or UNKNOWN, _badges(t["tags"]), _cut(t["template_str"], 80), _status(t)) for i, t in enumerate(report["templates"][:top], 1)]
    groups = [(c["cluster_id"], f"{c['total_count']:,}", len(c["templates"]), _cut(c["representative_str"] or "", 60), _time(c["first_seen"]), _time(c["last_seen"])) for c in report["clusters"][:clusters]]
    return {"templates": templates, "clusters": groups, **evolution_of(report)}


def _width(text: str) -> int:
    import unicodedata

    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def text_table(head: tuple, rows: list[tuple]) -> list[str]:
    """Lines of aligned columns; wide characters take two places."""
    cells = [[str(x) for x in r] for r in [head, *rows]]
    widths = [max(_width(r[k]) for r in cells) for k in range(len(head))]
    return ["  ".join(x + " " * (w - _width(x)) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells]


def html_report(report: dict[str, Any], max_templates: int = 50) -> str:
    e = lambda x: html.escape(str(x))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    table = lambda name, rows: "<table>" + row(map(e, _COLUMNS[name]), "th") + "".join(row(map(e, r)) for r in rows) + "</table>"
    rows = _tables(report, max_templates)
    body = ["<h1>Log templates</h1><table>" + "".join(row((e(k), e(v))) for k, v in report["summary"].items()) + "</table>"]
    if report.get("triggered_alerts"):
        body.append("<h2>Alerts</h2><ul>" + "".join(f"<li>[{e(x['severity'])}] {e(x['name'])}: {e(x['message'])}</li>" for x in report["triggered_alerts"]) + "</ul>")
    body.append("<h2>Templates</h2><table>" + row(map(e, (*_COLUMNS["templates"], "首次出现", "最近出现")), "th"))
    for t, cells in zip(report["templates"], rows["templates"], strict=False):
        series = report["time_series"].get(t["template_id"], {})
        data = series.get("data_points", [])
        chart = ""
        if data:
            top = max(1, *(p["value"] for p in data))
            step = 600 / max(1, len(data) - 1)
            marks = {i for i, p in enumerate(data) if p["timestamp"] in set(series.get("spike_timestamps", ()))}
            chart = svg([(i * step, 100 - p["value"] * 100 / top) for i, p in enumerate(data)], marks)
        shown = [e(x) for x in cells]
        shown[4], shown[5] = e(_badges(t["tags"], len(t["tags"] or ()))), e(t["template_str"]) + chart
        body.append(row((*shown, e(_time(t["stats"]["first_seen"])), e(_time(t["stats"]["last_seen"])))))
    body.append("</table><h2>Clusters</h2>" + table("clusters", rows["clusters"]))
    body.append("<h2>Evolution</h2>" + "".join(f"<h3>{_TITLES[k]}</h3>" + table(k, rows[k]) for k in _TITLES if rows[k]))
    body.append("<h2>Anomalies</h2>" + "".join(f"<p>{e(k)}: {e(', '.join(v[:20]))}</p>" for k, v in report["anomalies"].items() if isinstance(v, list)))
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Log templates</title></head><body>" + "".join(body) + "</body></html>"


def text_report(report: dict[str, Any], top: int = 20) -> str:
    s, rows = report["summary"], _tables(report, top)
    out = [f"{s['total_logs']} lines, {s['total_templates']} templates, {s['total_clusters']} clusters, {s['duration_seconds']:.2f} s ({s['processing_speed']:.0f}/s)"]
    out += [f"! [{x['severity']}] {x['name']}: {x['message']}" for x in report.get("triggered_alerts", ())]
    for title, name in ((f"Top {len(rows['templates'])} 模板", "templates"), ("模板聚类组", "clusters")):
        out += ["", title, *text_table(_COLUMNS[name], rows[name])]
    if report["anomalies"].get("data_insufficient"):
        out += ["", report["anomalies"]["data_insufficient_message"]]
    for k, v in report["anomalies"].items():
        if isinstance(v, list) and v:
            out.append(f"{k}: {', '.join(v[:10])}" + (f" +{len(v) - 10}" if len(v) > 10 else ""))
    for name, title in _TITLES.items():
        if rows[name]:
            out += ["", title, *text_table(_COLUMNS[name], rows[name])]
    return "\n".join(out)


def diff_report(compared: DataFrame, code: dict[str, Any]) -> dict[str, Any]:
    rows = [r.asDict() for r in compared.orderBy("bucket", F.desc("count_new"), "template").collect()]
    return {**code, **{f"{b}_templates": [r for r in rows if r["bucket"] == b] for b in ("added", "removed", "increased", "decreased", "unchanged")}}


_CHANGES = {"added": "新增模板", "removed": "消失模板", "increased": "显著增加", "decreased": "显著减少"}


def diff_text(report: dict[str, Any], most: int = 20) -> str:
    """The terminal form: totals, then a table of each kind of change."""
    every = [r for b in (*_CHANGES, "unchanged") for r in report[f"{b}_templates"]]
    total = lambda c: sum(r[c] or 0 for r in every)
    out = [f"旧版本日志总数: {total('count_old'):,}", f"新版本日志总数: {total('count_new'):,}"]
    for kind, title in _CHANGES.items():
        rows = report[f"{kind}_templates"]
        if not rows:
            continue
        change = lambda r: "∞" if r["count_change"] == math.inf else f"{r['count_change']:+.1%}"
        cells = [(r["template_id"], f"{r['count_old'] or 0:,}", f"{r['count_new'] or 0:,}", change(r), "✓" if r["is_error"] else "", _cut(r["template"], 80)) for r in rows[:most]]
        out += ["", f"{title}: {len(rows)} 个", *text_table(("模板ID", "原频率", "新频率", "变化", "错误", "模板内容"), cells)]
    return "\n".join([*out, "", f"exit code: {report['exit_code']}"])


_NOTES = {"is_strong_correlation": "强关联", "is_burst": "突发", "is_simultaneous": "同时"}


def correlation_text(report: dict[str, Any], texts: dict[str, str]) -> str:
    """The terminal form of ``correlation_report``; ``texts``: templates by id."""
    name = lambda i, most: _cut(texts.get(i, i), most)
    labels = (("总事件数", "total_events"), ("模板总数", "template_count"), ("参与分析模板数", "filtered_template_count"), ("关联规则数", "rule_count"), ("突发模板数", "burst_template_count"), ("因果链数", "chain_count"))
    out = text_table(("指标", "值"), [(label, f"{report['summary'][k]:,}") for label, k in labels])
    if report["rules"]:
        rows = []
        for i, r in enumerate(report["rules"], 1):
            notes = " ".join(w for k, w in _NOTES.items() if r[k]) or "-"
            rows.append((i, f"{r['a']} → {r['b']}", f"{name(r['a'], 40)} → {name(r['b'], 40)}", *[f"{r[m]:.4f}" for m in ("support", "confidence", "lift", "chi2", "jaccard")], notes))
        out += ["", "Top 关联规则", *text_table(("#", "A → B", "模板内容", "support", "confidence", "lift", "chi2", "jaccard", "标注"), rows)]
    for i, c in enumerate(report["chains"], 1):
        first = lambda node: node.strip("[]").split(", ")[0] if node.startswith("[") else node
        steps = [(k + 1, node, name(first(node), 50), f"{c['edge_weights'][k]:.4f}" if k < len(c["edge_weights"]) else "") for k, node in enumerate(c["path"])]
        out += ["", f"#{i} 因果链 (长度={c['length']}, 累计conf={c['total_confidence']:.4f})", *text_table(("步骤", "模板", "模板内容", "边confidence"), steps)]
    return "\n".join(out)


def correlation_report(c: Correlation, top: int = 20, texts: dict[str, str] | None = None) -> dict[str, Any]:
    """``texts``: templates by id, which the rules then name."""
    number = lambda v: round(v, 6) if isinstance(v, float) else v
    rules = [{k: number(v) for k, v in r.asDict().items()} for r in c.significant.limit(top).collect()]
    if texts is not None:
        rules = [{**r, "source_template": texts.get(r["a"], r["a"]), "target_template": texts.get(r["b"], r["b"])} for r in rules]
    bursts = [r.template_id for r in c.bursts.orderBy("template_id").collect()]
    chains = c.chains.orderBy(F.desc("length"), F.desc("total_confidence"), "path")
    taking_part = c.rules.select(F.col("a").alias("x")).union(c.rules.select("b")).distinct().count()
    shown = {"total_events": c.total, "template_count": c.counts.count(), "filtered_template_count": taking_part, "burst_template_count": len(bursts), "rule_count": c.significant.count(), "chain_count": c.chains.count()}
    return {"summary": shown, "total_events": c.total, "rules": rules, "chains": [r.asDict() for r in chains.limit(top).collect()], "burst_templates": bursts}
