"""Import graph of files: resolution, edges, reachability."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.paths import file_name, is_entry_file, is_test_file, parent
from canopy.plans.work import cut

# fixed values, in the order in which they are tried
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx")
INDEXES = ("index.ts", "index.tsx", "index.js", "index.jsx")
#: Edges that are walked in one task: two paths each, some 200 MB of Python objects at most.
ONE_TASK_EDGES = 500_000


class NoEntryPoints(Exception):
    pass


def resolve_imports(imports: DataFrame, files: DataFrame, resolve_parent: bool = False) -> DataFrame:
    """imports(path, ordinal, source) with `resolved`: the first candidate that is a file.

    A relative source is joined to the importer's folder; @/ and ~/ stand for the top; others are packages and stay
    unresolved. An extension replaces the last one that is there. Interior ./ go; ../ resolves only with resolve_parent.
    """
    source = F.regexp_replace("source", r"""^["'`]|["'`]$""", "")
    folder = parent(F.col("path"))
    joined = F.when(source.rlike(r"^[@~]/"), F.substring(source, 3, 1 << 30)).when(source.rlike(r"^\.\.?(?:/|$)"), F.when(folder == "", source).otherwise(F.concat_ws("/", folder, source)))
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"(^|/)(?:\./)+", "$1"), r"/\.?$", ""), r"/{2,}", "/")
    if resolve_parent:
        parts = F.aggregate(F.split(base, "/"), F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
        base = F.array_join(parts, "/")
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    candidates = F.array(base, *[F.concat(stem, F.lit(s)) for s in SUFFIXES[1:]], *[F.concat(base, F.lit(f"/{x}")) for x in INDEXES])
    tried = imports.withColumn("_base", base).select("path", "ordinal", "source", F.posexplode(candidates).alias("pos", "candidate")).filter("candidate is not null")
    # estimates know neither what Python makes nor the candidates: a broadcast chosen by them would hold all of them on the driver
    known = files.select(F.col("path").alias("candidate")).distinct().hint("merge")
    hit = tried.join(known, "candidate").groupBy("path", "ordinal").agg(F.min_by("candidate", "pos").alias("resolved"))
    return imports.join(hit, ["path", "ordinal"], "left")


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each id: the one with the last ordinal, if there is one."""
    if "ordinal" not in symbols.columns:
        return symbols.dropDuplicates(["id"])
    others = [c for c in symbols.columns if c != "id"]
    return symbols.groupBy("id").agg(F.max_by(F.struct(*others), "ordinal").alias("s")).select("id", "s.*")


def exports(symbols: DataFrame) -> DataFrame:
    return symbols.filter("is_exported").select("path", "id")


def symbol_edges(symbols: DataFrame, file_edges: DataFrame) -> DataFrame:
    """src, dst: every symbol of an importing file to every export of the imported one. For reports; reachability works on files."""
    src = symbols.select(F.col("path").alias("src_path"), F.col("id").alias("src"))
    dst = exports(symbols).select(F.col("path").alias("dst_path"), F.col("id").alias("dst"))
    return file_edges.select("src_path", "dst_path").distinct().join(src, "src_path").join(dst, "dst_path").select("src", "dst")


def entry_points(symbols: DataFrame) -> DataFrame:
    """Symbols named main, in test files, or exported from entry files; ids once each."""
    at = F.col("path")
    return symbols.filter((F.col("name") == "main") | is_test_file(at) | (F.col("is_exported") & is_entry_file(at))).select("id", "path").distinct()


def walk_in_one_task(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """path: all that edges lead to from starts, for edges that one task holds."""
    inside = starts.join(edges.select(F.col("src_path").alias("path")).distinct(), "path", "left_semi")
    rows = edges.unionByName(inside.select(F.lit(None).cast("string").alias("src_path"), F.col("path").alias("dst_path"))).repartition(1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after, todo = {}, []
        for b in batches:
            for src, dst in zip(b["src_path"], b["dst_path"], strict=True):
                if src is None:
                    todo.append(dst)
                else:
                    after.setdefault(src, []).append(dst)
        seen = set()
        while todo:
            new = [d for d in after.get(todo.pop(), ()) if d not in seen]
            seen.update(new)
            todo += new
        yield pd.DataFrame({"path": sorted(seen)}, dtype=object)

    return rows.mapInPandas(walk, "path string")


def reachable_files(starts: DataFrame, file_edges: DataFrame, one_task: int = ONE_TASK_EDGES, whole: bool = False) -> DataFrame:
    """Files from which edges count: starts, and all that edges lead to. whole: file_edges are distinct, without nulls, and a written table.

    Up to one_task edges are walked in a task. Beyond, a frontier a round is joined, each cut by a written table; rounds are bounded by the graph's diameter.
    """
    edges = file_edges if whole else cut(file_edges.select("src_path", "dst_path").filter("src_path is not null and dst_path is not null").distinct())
    begun = starts.select("path").distinct()
    if edges.count() <= one_task:
        return begun.union(walk_in_one_task(begun, edges)).distinct()
    frontier = cut(begun)
    seen = frontier
    while True:
        step = edges.join(frontier, edges["src_path"] == frontier["path"]).select(F.col("dst_path").alias("path")).distinct()
        frontier = cut(step.join(seen, "path", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)  # each part is a written table, so this stays shallow


def reachable_symbols(symbols: DataFrame, file_edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids reached from entries. All symbols of a file share their edges, so files are traversed: a symbol is reached if it is an entry, or is exported from a file that an edge of a reached file leads to."""
    targets = exports(symbols).select(F.col("path").alias("dst_path")).distinct()
    # both the walk and what it leads to read the edges
    edges = cut(file_edges.select("src_path", "dst_path").filter("src_path is not null").distinct().join(targets, "dst_path", "left_semi").select("src_path", "dst_path"))
    reached = reachable_files(entries.select("path"), edges, whole=True)
    led = edges.join(reached, edges["src_path"] == reached["path"], "left_semi").select(F.col("dst_path").alias("path")).distinct()
    return entries.select("id").union(exports(symbols).join(led, "path", "left_semi").select("id")).distinct()


def reach(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node: reached from entries(node) over edges(src, dst), on any graph; ends that are nobody's source count."""
    if entries.isEmpty():
        raise NoEntryPoints("no entry points")
    found = reachable_files(entries.select(F.col("node").alias("path")), edges.select(F.col("src").alias("src_path"), F.col("dst").alias("dst_path")))
    return found.select(F.col("path").alias("node"))


__all__ = ["NoEntryPoints", "entry_points", "exports", "file_name", "reach", "reachable_symbols", "resolve_imports", "symbol_edges", "unique_symbols"]
