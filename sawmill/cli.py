"""Command line: analyze, stream, save-state, diff, correlate, init-config, version."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import functions as F

from sawmill.config import CONFIG_FILE, load_settings, overridden, write_sample
from sawmill.operators import diff, timeseries
from sawmill.plans import analyze as plans
from sawmill.plans import reports
from sawmill.session import session
from sawmill.sources import libraries, lines

VERSION = "0.1.0"


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sawmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "stream", "save-state"):
        c = sub.add_parser(name)
        if name != "stream":
            c.add_argument("files", nargs="+")
        c.add_argument("--config")
        c.add_argument("--format", choices=("terminal", "json", "html", "all"))
        c.add_argument("--output-dir")
        c.add_argument("--baseline", default="")
        c.add_argument("--depth", type=int)
        c.add_argument("--similarity", type=float)
        c.add_argument("--top", type=int)
        c.add_argument("--tag")
        c.add_argument("--state", help="folder of the state; one of another engine's .json files is taken over into it")
        if name != "stream":
            c.add_argument("-i", "--incremental", action="store_true", help="go on from the state, at the offsets of the files")
    c = sub.add_parser("diff")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--spike-threshold", type=float, default=2.0)
    c.add_argument("--format", choices=("terminal", "json"), default="terminal")
    c.add_argument("--no-exit-code", action="store_true")
    c.add_argument("-o", "--output", help="also write the result as JSON")
    c = sub.add_parser("correlate")
    c.add_argument("file")
    c.add_argument("--config")
    for option, kind in (("window", int), ("min-support", float), ("min-confidence", float), ("min-lift", float), ("burst-threshold", int)):
        c.add_argument(f"--{option}", type=kind)
    c.add_argument("--save-state")
    c.add_argument("--load-state")
    c.add_argument("--format", choices=("terminal", "json"), default="terminal")
    c.add_argument("--top", type=int, default=20)
    c = sub.add_parser("init-config")
    c.add_argument("path", nargs="?", default=CONFIG_FILE)
    sub.add_parser("version")
    return p


def _report(a: plans.Analysis, settings, spark) -> dict:
    points = timeseries.gap_filled(timeseries.counts(a.rows.select("template_id", "ts"), settings.anomaly.freq_unit), settings.anomaly.freq_unit)
    return reports.json_report(a, points)


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "init-config":
        print(write_sample(args.path))
        return 0
    spark = session()
    year = datetime.date.today().year
    if args.command == "diff":
        compared = diff.compare(libraries.load_library(spark, args.old), libraries.load_library(spark, args.new), args.spike_threshold)
        code = diff.exit_code(compared).first().asDict()
        out = reports.diff_report(compared, code)
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str) if args.format == "json" else reports.diff_text(out))
        if args.output:
            print(reports.write_json(out, args.output))
        return 0 if args.no_exit_code else code["exit_code"]
    if args.command == "correlate":
        names = {"window": "window_size", "min_support": "min_support", "min_confidence": "min_confidence", "min_lift": "min_lift", "burst_threshold": "burst_threshold"}
        settings = overridden(load_settings(args.config), {f"correlate.{v}": getattr(args, k) for k, v in names.items()})
        if libraries.is_state_file(spark, args.file):
            lib = libraries.load_library(spark, args.file)
            events = libraries.synthetic_events(lib.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in ("first_seen", "last_seen")}))
        else:
            a = plans.analyze_files(spark, [args.file], settings, year)
            events, lib = a.rows.select("template_id", "ts"), a.templates
        got = plans.correlate_events(events, settings, libraries.load_correlation(spark, args.load_state) if args.load_state else None)
        if args.save_state:
            libraries.save_correlation(got.pairs, got.counts, args.save_state)
        report = reports.correlation_report(got, args.top)
        shown = {x for r in report["rules"] for x in (r["a"], r["b"])} | {x for c in report["chains"] for n in c["path"] for x in n.strip("[]").split(", ")}
        texts = {r.template_id: r.template for r in lib.where(F.col("template_id").isin(*shown)).collect()} if shown else {}
        for r in report["rules"]:
            r["source_template"], r["target_template"] = texts.get(r["a"], r["a"]), texts.get(r["b"], r["b"])
        print(json.dumps(report, ensure_ascii=False, indent=2, default=str) if args.format == "json" else reports.correlation_text(report, texts))
        return 0
    over = {"drain.depth": args.depth, "drain.st": args.similarity, "drain.sim_th": args.similarity, "output.top_n": args.top, "output.format": args.format, "output.output_dir": args.output_dir}
    settings = overridden(load_settings(args.config), over)
    baseline, state = libraries.load_baseline(spark, args.baseline), args.state or settings.incremental.state_file
    if args.command == "stream":
        a = plans.analyze(lines.parsed(lines.from_iterable(spark, sys.stdin), settings.input, year), settings, baseline, args.tag)
    elif args.incremental or args.state or args.command == "save-state":
        a = plans.analyze_incremental(spark, args.files, plans.state_folder(spark, state, args.incremental), settings, year, baseline, args.tag)
    else:
        a = plans.analyze(lines.parsed(lines.scan_lines(spark, args.files), settings.input, year), settings, baseline, args.tag)
    if args.command == "save-state":
        print(f"{a.total_logs} lines, {a.templates.count()} templates, state: {state.removesuffix('.json')}")
        return 0
    report, fmt, folder = _report(a, settings, spark), settings.output.format, settings.output.output_dir
    if fmt in ("terminal", "all"):
        print(reports.text_report(report, settings.output.top_n))
    if fmt in ("json", "all"):
        print(reports.write_json(report, f"{folder}/report.json"))
    if fmt in ("html", "all"):
        from pathlib import Path

        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(folder, "report.html").write_text(reports.html_report(report, settings.output.html_max_templates), "utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
