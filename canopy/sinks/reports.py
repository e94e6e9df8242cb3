"""Reports as text, JSON and CSV. They are streamed from sorted partitions, so a report of any length needs one partition at a time."""

from __future__ import annotations

import csv
import io
import json
import os
import sys
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.paths import component_order
from canopy.operators import deadcode
from canopy.operators.metrics import largest_files

FILE_FIELDS = ("path", "language", "loc", "size_bytes", "function_count", "last_modified")
DEAD_FIELDS = ("dead_function_count", "dead_code_loc", "dead_code_ratio")
# fixed values: the tiers of the two text reports
PLAIN_TIERS, FINE_TIERS = (80, 60), (90, 70)


def emit(chunks: Iterable[str], path: str | None = None) -> None:
    """To a file, whose folders are made, or to standard output."""
    if path is None:
        sys.stdout.writelines(chunks)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(chunks)


def _file(row: dict, skip_times: bool) -> dict:
    out = {k: row[k] for k in FILE_FIELDS if k in row and not (skip_times and k == "last_modified")}
    if isinstance(out.get("last_modified"), datetime):
        out["last_modified"] = out["last_modified"].isoformat()
    return out | {k: row[k] for k in DEAD_FIELDS if row.get(k) is not None}


def _summary(metrics: DataFrame, summary: DataFrame) -> dict:
    return summary.first().asDict() | {"largest_files": [r["path"] for r in largest_files(metrics).collect()]}


def json_report(metrics: DataFrame, summary: DataFrame, pretty: bool = True, at: datetime | None = None, times: bool = True) -> Iterator[str]:
    """One JSON document: summary, files by path component, timestamp. Null fields on dead code are left out. pretty=False gives one line."""
    indent = 2 if pretty else None
    joint, end = ((",\n", "\n") if pretty else (",", ""))
    separators = None if pretty else (",", ":")
    shift = lambda text, by: text.replace("\n", "\n" + " " * by)
    head = shift(json.dumps(_summary(metrics, summary), indent=indent, separators=separators), 2)
    yield (f'{{\n  "summary": {head},\n  "files": [' if pretty else f'{{"summary":{head},"files":[')
    first = True
    for row in metrics.orderBy(component_order(F.col("path"))).toLocalIterator():
        text = json.dumps(_file(row.asDict(), not times), indent=indent, separators=separators, ensure_ascii=False)
        yield ("" if first else joint.rstrip("\n")) + ("\n    " + shift(text, 4) if pretty else text)
        first = False
    yield ("]" if first or not pretty else "\n  ]")
    if times:
        stamp = json.dumps((at or datetime.now(UTC)).isoformat())
        yield (f',\n  "timestamp": {stamp}' if pretty else f',"timestamp":{stamp}')
    yield end + "}" + "\n"


def csv_report(metrics: DataFrame) -> Iterator[str]:
    """path, language, loc, functions, size_bytes; if any row has a ratio, three columns on dead code, with zeros for files without."""
    with_dead = "dead_code_ratio" in metrics.columns and not metrics.filter("dead_code_ratio is not null").isEmpty()

    def line(values: list) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(values)
        return out.getvalue()

    yield line(["path", "language", "loc", "functions", "size_bytes"] + (["dead_functions", "dead_loc", "dead_code_ratio"] if with_dead else []))
    for r in metrics.orderBy(component_order(F.col("path"))).toLocalIterator():
        row = [r["path"], r["language"], r["loc"], r["function_count"], r["size_bytes"]]
        if with_dead:
            row += [r["dead_function_count"] or 0, r["dead_code_loc"] or 0, "0.0" if r["dead_code_ratio"] is None else f"{r['dead_code_ratio']:.4f}"]
        yield line(row)


def csv_table(metrics: DataFrame) -> DataFrame:
    """The same columns as a DataFrame, for df.write.csv where the report is too long for one file."""
    return metrics.select("path", "language", "loc", F.col("function_count").alias("functions"), "size_bytes", *(
        [F.coalesce("dead_function_count", F.lit(0)).alias("dead_functions"), F.coalesce("dead_code_loc", F.lit(0)).alias("dead_loc"), F.round(F.coalesce("dead_code_ratio", F.lit(0.0)), 4).alias("dead_code_ratio")] if "dead_code_ratio" in metrics.columns else []))


def json_table(metrics: DataFrame) -> DataFrame:
    """path and the file's JSON object as the report has it, for reports too long for one file. Null fields are left out."""
    fields = [f for f in (*FILE_FIELDS, *DEAD_FIELDS) if f in metrics.columns]
    return metrics.select("path", F.to_json(F.struct(*fields)).alias("json"))


def dead_json_table(dead: DataFrame) -> DataFrame:
    """path and the file's JSON object of the report on dead code."""
    found = F.transform("dead_code", lambda d: F.struct(*[d[c].alias(_camel(c)) for c in ("symbol", "kind", "line_start", "line_end", "loc", "confidence", "reason")]))
    return deadcode.nested_by_file(dead).select("path", F.to_json(F.struct("path", found.alias("deadCode"))).alias("json"))


# fixed values: the headings and line shapes of the text reports below are a format
def text_report(metrics: DataFrame, summary: DataFrame) -> Iterator[str]:
    s = summary.first()
    yield f"Code Analysis Summary\n=====================\nTotal Files: {s['total_files']}\nTotal LOC:   {s['total_loc']}\nFunctions:   {s['total_functions']}\n\nLargest Files:\n"
    for i, r in enumerate(largest_files(metrics).collect(), 1):
        yield f"  {i}. {r['path']} ({r['loc']} LOC)\n"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def dead_json(dead: DataFrame, summary: DataFrame) -> Iterator[str]:
    """summary and files with their dead symbols, in camel case."""
    head = {_camel(k): v for k, v in summary.first().asDict().items()}
    yield '{\n  "summary": ' + json.dumps(head, indent=2).replace("\n", "\n  ") + ',\n  "files": ['
    first = True
    for r in deadcode.nested_by_file(dead).orderBy(component_order(F.col("path"))).toLocalIterator():
        found = [{"symbol": d["symbol"], "kind": d["kind"], "lineStart": d["line_start"], "lineEnd": d["line_end"], "loc": d["loc"], "confidence": d["confidence"], "reason": d["reason"], "lastModified": None} for d in r["dead_code"]]
        yield ("" if first else ",") + "\n    " + json.dumps({"path": r["path"], "deadCode": found}, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        first = False
    yield ("]" if first else "\n  ]") + "\n}\n"


def dead_text(dead: DataFrame, summary: DataFrame, tiers: tuple[int, int] = PLAIN_TIERS) -> Iterator[str]:
    """Counts, the ten files with most dead lines, symbols by tier and by file."""
    s, (high, medium) = summary.first(), tiers
    share = s["files_with_dead_code"] / s["total_files"] * 100 if s["total_files"] else 0.0
    yield "Dead Code Analysis Summary\n" + "=" * 50 + "\n"
    yield f"Total files analyzed: {s['total_files']}\nFiles with dead code: {s['files_with_dead_code']} ({share:.1f}%)\nTotal dead code: {s['total_dead_loc']} LOC ({s['dead_code_ratio'] * 100:.1f}%)\nDead functions: {s['dead_functions']}\nDead classes: {s['dead_classes']}\n"
    top = deadcode.by_file(dead).orderBy(F.desc("dead_code_loc"), component_order(F.col("path"))).limit(10).collect()
    if top:
        yield "\nTop files by dead code:\n"
    for i, r in enumerate(top, 1):
        yield f"  {i}. {r['path']} - {r['dead_code_loc']} LOC ({r['n_symbols']} symbols)\n"
    count = {r["tier"]: r["count"] for r in dead.groupBy(deadcode.tier(F.col("confidence"), high, medium).alias("tier")).count().collect()}
    yield f"\nConfidence:\n  High (>={high}): {count.get('high', 0)} symbols\n  Medium ({medium}-{high - 1}): {count.get('medium', 0)} symbols\n  Low (<{medium}): {count.get('low', 0)} symbols\n"
    for r in deadcode.nested_by_file(dead).orderBy(component_order(F.col("path"))).toLocalIterator():
        yield f"\n  {r['path']}\n"
        for d in sorted(r["dead_code"], key=lambda d: -d["confidence"]):
            yield f"    {d['kind']} {d['symbol']} (lines {d['line_start']}-{d['line_end']}, {d['loc']} LOC, confidence: {d['confidence']})\n"


def diff_text(summary: DataFrame, old_loc: int, new_loc: int) -> Iterator[str]:
    s = summary.first()
    yield f"{s['added']} files added\n{s['deleted']} files deleted\n{s['modified']} files modified (LOC changed)\nTotal LOC: {old_loc} -> {new_loc} ({new_loc - old_loc:+d})\n"
    if s["largest_growth_path"] is not None:
        yield f"Largest growth: {s['largest_growth_path']} (+{s['largest_growth']} LOC)\n"
