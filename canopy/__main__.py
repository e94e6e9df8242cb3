"""Command line: analyze, dead-code, diff, watch, config init. Exit code 3 means that a gate failed."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from canopy.operators import deadcode, diff, metrics
from canopy.plans.analysis import DEAD_EXCLUDES, DEFAULT_CACHE, analyze, dead_code
from canopy.sinks import reports as R
from canopy.sources.files import checked_root
from canopy.sources.reports import init_config, read_config, read_report

GATE_FAILED = 3


def session() -> SparkSession:
    spark = SparkSession.builder.appName("canopy").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def confidence(value: str) -> int:
    n = int(value)
    if not 0 <= n <= 100:
        raise argparse.ArgumentTypeError("confidence must be from 0 to 100")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="canopy")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "watch", "dead-code"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--format", "-f", default=None)
        c.add_argument("--verbose", "-v", action="store_true")
        if name != "watch":
            c.add_argument("--exclude", "-e", action="append", default=[])
            c.add_argument("--threshold")
            c.add_argument("--output", "-o")
        if name == "analyze":
            c.add_argument("--baseline")
            c.add_argument("--dead-code", action="store_true")
        if name == "dead-code":
            c.add_argument("--min-confidence", type=confidence, default=80)
    c = sub.add_parser("diff")
    c.add_argument("old")
    c.add_argument("new")
    sub.add_parser("config").add_argument("action", choices=["init"])
    return p


def run_analyze(spark: SparkSession, a: argparse.Namespace, config: dict) -> int:
    found = analyze(spark, a.path, a.exclude + config.get("analysis", {}).get("exclude", []), dead=a.dead_code)
    if a.baseline:
        base = metrics.summary(read_report(spark, a.baseline))
        gate = metrics.baseline_gate(found.summary, base).first()
        if gate["failed"]:
            print(f"LOC grew by {gate['change_pct']:.1f} %", file=sys.stderr)
            return GATE_FAILED
    if a.threshold:
        beyond = metrics.threshold_violations(found.metrics if a.dead_code else found.metrics.withColumn("dead_code_ratio", F.lit(None).cast("double")), [a.threshold])
        few = beyond.limit(20).collect()
        if few:
            print("beyond the threshold: " + ", ".join(r["path"] for r in few), file=sys.stderr)
            return GATE_FAILED
    form = a.format or config.get("output", {}).get("format", "text")
    out = {"json": lambda: R.json_report(found.metrics, found.summary), "csv": lambda: R.csv_report(found.metrics)}.get(form, lambda: R.text_report(found.metrics, found.summary))
    R.emit(out(), a.output)
    return 0


def run_dead(spark: SparkSession, a: argparse.Namespace, config: dict) -> int:
    cache = os.path.join(a.path, DEFAULT_CACHE) if config.get("cache", {}).get("enabled", True) else None
    found = dead_code(spark, a.path, [*DEAD_EXCLUDES, *a.exclude], cache)
    kept = deadcode.confident(found.dead, a.min_confidence)
    summary = deadcode.filtered_summary(found.dead, found.symbols, a.min_confidence)
    R.emit(R.dead_json(kept, summary) if a.format == "json" else R.dead_text(kept, summary), a.output)
    return GATE_FAILED if a.threshold and not deadcode.summary_gate(summary, [a.threshold]).isEmpty() else 0


def run_diff(spark: SparkSession, a: argparse.Namespace) -> int:
    old, new = read_report(spark, a.old), read_report(spark, a.new)
    total = lambda rows: metrics.summary(rows).first()["total_loc"]
    R.emit(R.diff_text(diff.diff_summary(diff.report_diff(old, new)), total(old), total(new)))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "config":
        try:
            print(f"created {init_config('.')}")
        except FileExistsError:
            print("there is a configuration already", file=sys.stderr)
            return 1
        return 0
    try:
        if a.command == "diff":
            return run_diff(spark or session(), a)
        config = read_config(checked_root(a.path))
        if a.command == "analyze":
            return run_analyze(spark or session(), a, config)
        if a.command == "dead-code":
            return run_dead(spark or session(), a, config)
        from canopy.streaming.watch import watch_tree

        return watch_tree(spark or session(), a.path, as_json=a.format == "json")
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
