"""Directory trees as flat nodes: rollup, lookups by path, depth limits, chart rows."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.paths import ancestors, component_order, file_name, parent
from canopy.functions.scalars import complexity, complexity_color
from canopy.plans.work import cut


def directories(files: DataFrame) -> DataFrame:
    """path, loc, n_files, last_modified of every folder above files(path, loc[, last_modified]); the root is ''. One shuffle, combined before it, no recursion."""
    changed = F.col("last_modified") if "last_modified" in files.columns else F.lit(None).cast("timestamp")
    up = files.select("loc", changed.alias("last_modified"), F.lit(1).alias("one"), F.explode(F.concat(F.array(F.lit("")), F.filter(ancestors(F.col("path")), lambda x: x != ""))).alias("path"))
    # the root is there without files too
    up = up.union(files.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(None).cast("timestamp"), F.lit(0), F.lit("")))
    return up.groupBy("path").agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.sum("one").alias("n_files"), F.max("last_modified").alias("last_modified"))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("int")


def nodes(files: DataFrame, root_name: str = "root") -> DataFrame:
    """All nodes of the tree: path, parent_id (null at the root), name, type, depth, loc, complexity, last_modified. A leading ./ goes."""
    clean = files.withColumn("path", F.regexp_replace("path", r"^(?:\./)+", ""))
    changed = F.col("last_modified") if "last_modified" in files.columns else F.lit(None).cast("timestamp")
    leaves = clean.select("path", "loc", changed.alias("last_modified"), F.lit("file").alias("type"))
    dirs = directories(clean).select("path", "loc", "last_modified", F.lit("directory").alias("type"))
    at = F.col("path")
    return leaves.unionByName(dirs).select("path", F.when(at == "", None).otherwise(parent(at)).alias("parent_id"), F.when(at == "", root_name).otherwise(file_name(at)).alias("name"), "type", depth(at).alias("depth"), "loc", complexity(F.col("loc")).alias("complexity"), "last_modified")


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.filter("parent_id is not null").groupBy(F.col("parent_id").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))


def dfs_key(path: Column, kind: Column) -> Column:
    """Sorts nodes in page order: a folder before what it holds; files by name, then folders."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.concat(F.when((i == F.size(parts) - 1) & (kind == "file"), "0").otherwise("1"), x))


def filter_by_path(tree: DataFrame, segments: list[str]) -> DataFrame:
    """The node that segments lead to: each is the name of the node reached or of any node below it; the first in page order. No segments: the root.

    A node qualifies if the segments are a subsequence of the names from the root to it, ending at itself, so no recursion is needed.
    """
    wanted = [s for s in segments if s]
    if not wanted:
        return tree.filter(F.col("path") == "")
    root = tree.filter(F.col("path") == "").select(F.col("name").alias("_root")).limit(1)
    names = F.concat(F.array("_root"), F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")))
    goal = F.array(*map(F.lit, wanted))
    matched = F.aggregate(names, F.lit(0), lambda k, x: k + F.when((k < len(wanted)) & (F.get(goal, k) == x), 1).otherwise(0))
    before = F.aggregate(F.slice(names, 1, F.size(names) - 1), F.lit(0), lambda k, x: k + F.when((k < len(wanted)) & (F.get(goal, k) == x), 1).otherwise(0))
    found = tree.crossJoin(F.broadcast(root)).filter((matched == len(wanted)) & (before < len(wanted)))  # the other side is one row
    return found.orderBy(F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(dfs_key(F.col("path"), F.col("type")))).limit(1).drop("_root")


def find_by_path(tree: DataFrame, path: str | None) -> DataFrame:
    """The node at a path, slashes at its ends ignored; no row for an empty path."""
    if not path:
        return tree.limit(0)
    return filter_by_path(tree, path.strip("/").split("/"))


def subtree(tree: DataFrame, path: str) -> DataFrame:
    return tree if path == "" else tree.filter((F.col("path") == path) | F.col("path").startswith(f"{path}/"))


def limited(tree: DataFrame, levels: int) -> DataFrame:
    return tree.filter(F.col("depth") <= levels)


def page_key(path: Column, kind: Column) -> Column:
    """dfs_key, with the root before all."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(dfs_key(path, kind))


def flattened(tree: DataFrame) -> DataFrame:
    """Nodes in page order."""
    return tree.orderBy(page_key(F.col("path"), F.col("type")))


def numbered(tree: DataFrame) -> DataFrame:
    """Nodes with `at`, their place in page order from 1."""
    return in_places(tree, page_key(F.col("path"), F.col("type")))


def in_places(rows: DataFrame, key: Column) -> DataFrame:
    """rows with `at`, their place from 1 in the order of a key. Ranges of the order are sorted apart and each starts where the one before ends, so that no task has all rows."""
    # the id is the range's number and, in the lower 33 bits, the place in it
    ranged = cut(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    ends, before = [], 0
    for r in sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        ends.append((r["part"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(ends, "_part long, _before long")
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("at", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")


def selected(tree: DataFrame, path: str, report: DataFrame) -> DataFrame:
    """The node at a path with what a report says of it (nulls: nothing)."""
    return tree.filter(F.col("path") == path).join(report, "path", "left")


def ring_order(tree: DataFrame) -> DataFrame:
    """Nodes below the root with rank, their place among their siblings: by lines, the largest first, ties by name."""
    siblings = Window.partitionBy("parent_id").orderBy(F.desc("loc"), "name")
    return tree.filter("parent_id IS NOT NULL").withColumn("rank", F.row_number().over(siblings).cast("long"))


_charts: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def chart_of(tree: DataFrame) -> DataFrame:
    """chart_nodes, written once for each tree as long as the tree is held."""
    if tree not in _charts:
        _charts[tree] = cut(chart_nodes(tree))
    return _charts[tree]


def visible(tree: DataFrame) -> DataFrame:
    """Nodes that the keyboard reaches: files, and folders that hold something; `flattened` puts them in order."""
    parents = tree.filter("parent_id is not null").select(F.col("parent_id").alias("_held")).distinct()
    return tree.join(parents, (tree["type"] == "directory") & (tree["path"] == parents["_held"]), "left_semi").unionByName(tree.filter(F.col("type") == "file"))


def lazy_chart(tree: DataFrame, above: int = 50_000) -> DataFrame:
    """One row: n_files, lazy (whether the chart is drawn bit by bit)."""
    return tree.agg(F.count_if(F.col("type") == "file").alias("n_files")).withColumn("lazy", F.col("n_files") > above)


def chart_nodes(tree: DataFrame) -> DataFrame:
    """name, path, type, value, color (files only)."""
    return tree.select("name", "path", "type", F.coalesce("loc", F.lit(0)).alias("value"), F.when(F.col("type") == "file", complexity_color(F.col("complexity"))).alias("color"))


def common_root(files: DataFrame) -> DataFrame:
    """One row: root, the longest folder that all files share; one level up if they all lie in it directly and are several. From the least and largest folder only."""
    folder = F.split(parent(F.col("path")), "/")
    ends = files.select(folder.alias("f")).agg(F.min("f").alias("a"), F.max("f").alias("b"), F.count(F.lit(1)).alias("n"))
    same = F.zip_with(F.slice("a", 1, F.least(F.size("a"), F.size("b"))), F.slice("b", 1, F.least(F.size("a"), F.size("b"))), lambda x, y: x == y)
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")))["n"]
    level = F.when((F.col("a") == F.col("b")) & (F.col("n") > 1), F.size("a") - 1).otherwise(shared)
    return ends.select(F.coalesce(F.array_join(F.slice("a", F.lit(1), F.greatest(level, F.lit(0))), "/"), F.lit("")).alias("root"))


def breadcrumb(segments: list[str], to: int | None = None) -> list[str]:
    """The drill-down path after a click on crumb `to`; after going back, without its last part."""
    return segments[:-1] if to is None else segments[: to + 1]


__all__ = ["breadcrumb", "chart_nodes", "chart_of", "child_counts", "common_root", "component_order", "directories", "filter_by_path", "find_by_path", "flattened", "in_places", "lazy_chart", "limited", "nodes", "numbered", "ring_order", "selected", "subtree", "visible"]


def ancestors_of(tree: DataFrame, path: str) -> DataFrame:
    """The crumbs of a path: the nodes from the root down to it, in order."""
    parts = [p for p in path.split("/") if p]
    return tree.filter(F.col("path").isin("", *("/".join(parts[: i + 1]) for i in range(len(parts))))).orderBy("depth")


def by_size(tree: DataFrame) -> DataFrame:
    """Nodes as rings take them: siblings by lines, the largest first, ties by name."""
    return tree.orderBy(F.col("parent_id").asc_nulls_first(), F.desc("loc"), "name")
