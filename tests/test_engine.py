import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canopy.functions import scalars as S
from canopy.functions.loc import loc
from canopy.functions.paths import glob_to_regex
from canopy.operators import deadcode, diff, graph, metrics, tree, watch_state
from canopy.plans import queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [("let x = 1; // Comment", 1), ("/* a\n b\n*/", 0), ("/* c */ let x = 1;", 1), ("a\n/* x\ny\n*/ b", 2), ("/* a */ /* b */", 1), ("/* a */", 0), ("/* a */ ", 1), ("", 0), ('s = "// no";\n\n//x', 1)],
)
def test_loc(spark, source, want):
    assert one(spark, loc(F.lit(source), "typescript")) == want


def test_scalars(spark):
    assert [one(spark, S.format_number(F.lit(x))) for x in (None, 1234567, 2.5)] == ["0", "1,234,567", "3"]
    assert [one(spark, S.format_bytes(F.lit(x))) for x in (None, 0, -5, 1023, 1024, 1536, 1048576)] == ["0 B", "0 B", "0 B", "1023.00 B", "1.00 KB", "1.50 KB", "1.00 MB"]
    assert [one(spark, S.complexity_color(F.lit(x))) for x in (-1, 0, 30, 60, 100, 300, float("nan"))] == ["#22c55e", "#22c55e", "#eab308", "#ef4444", "#dc2626", "#dc2626", "#94a3b8"]
    assert [one(spark, S.complexity_label(F.lit(x))) for x in (29, 30, 60, 80)] == ["Low", "Medium", "High", "Very High"]
    assert one(spark, S.format_path(F.lit("a/" * 40 + "file.ts"), 30)) == "..." + ("a/" * 40)[:-1][-16:] + "/file.ts"
    assert [one(spark, S.complexity(F.lit(x))) for x in (0, 50, 100, 1000, 2000)] == [0, 5, 10, 100, 100]
    now = F.lit(datetime(2024, 1, 10, 12)).cast("timestamp")
    assert [one(spark, S.format_relative_date(F.lit(datetime(2024, 1, *t)), now)) for t in ((10, 11, 59, 30), (10, 11, 59), (10, 10), (8, 12))] == ["just now", "1 minute ago", "2 hours ago", "2 days ago"]


@pytest.mark.parametrize(("glob", "path", "want"), [("**/node_modules/**", "a/node_modules/x", True), ("node_modules/**", "a/node_modules/x", False), ("**/*.test.ts", "x.test.ts", True), ("*.ts", "a/b.ts", True), ("a.?s", "a.ts", True), ("*.{js,ts}", "b.js", True)])
def test_globs(spark, glob, path, want):
    assert one(spark, F.lit(path).rlike(glob_to_regex(glob))) == want


def test_confidence(spark):
    flags = [(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 1, 0, 0), (1, 0, 1, 0), (1, 1, 1, 1)]
    assert [one(spark, deadcode.confidence(*(F.lit(bool(b)) for b in f))) for f in flags] == [100, 70, 75, 85, 80, 45, 10]
    assert [one(spark, deadcode.dynamic_name(F.lit(n))) for n in ("on_handler", "Plugin_x", "hooked")] == [True, True, False]


def test_tree(spark):
    files = spark.createDataFrame([("a/b/x.ts", 300), ("a/y.ts", 50), ("a/b/c/z.ts", 0)], "path string, loc long")
    t = tree.nodes(files)
    assert {r["path"]: (r["loc"], r["complexity"]) for r in t.filter("type = 'directory'").collect()} == {"": (350, 35), "a": (350, 35), "a/b": (300, 30), "a/b/c": (0, 0)}
    assert [r["path"] for r in tree.flattened(t).collect()] == ["", "a", "a/y.ts", "a/b", "a/b/x.ts", "a/b/c", "a/b/c/z.ts"]
    assert tree.find_by_path(t, "/a/c/").first()["path"] == "a/b/c"
    assert tree.find_by_path(t, "").count() == 0
    assert tree.common_root(files).first()[0] == "a"
    assert [(r["path"], r["loc"], r["complexity"]) for r in tree.nodes(files.limit(0)).collect()] == [("", 0, 0)]


def test_numbered_tree_and_whole_documents(spark):
    r = random.Random(3)
    files = spark.createDataFrame(sorted({("/".join(r.choice(["a", "b", "a b", "c.ts"]) for _ in range(r.randint(0, 4))) + f"/{k}.ts").lstrip("/") for k in range(300)}), "string").select(F.col("value").alias("path"), F.lit(1).cast("long").alias("loc"))
    t = tree.nodes(files)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    got = {x["path"]: x["at"] for x in tree.numbered(t).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [got[x["path"]] for x in tree.flattened(t).collect()] == list(range(1, t.count() + 1))
    assert [tuple(x) for x in tree.numbered(tree.nodes(files.limit(0))).select("path", "at").collect()] == [("", 1)] and tree.numbered(t.limit(0)).count() == 0
    sf = "/root/testdata/sf0.001"
    whole = queries.QUERIES["flattened_documents"](spark, sf).collect()
    paths = {x["path"] for x in queries.document_files(spark, sf).collect()}
    assert {x["path"] for x in whole if x["type"] == "file"} == paths and sorted(x["at"] for x in whole) == list(range(1, len(whole) + 1))
    assert queries.QUERIES["documents_root"](spark, sf).first()[0] == ""


def test_diff_and_gates(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, loc long")
    new = spark.createDataFrame([("b", 2), ("c", 9), ("d", 4)], "path string, loc long")
    d = diff.report_diff(old, new)
    assert {(r["path"], r["status"]) for r in d.collect()} == {("a", "deleted"), ("c", "modified"), ("d", "added")}
    assert tuple(diff.diff_summary(d).first()) == (1, 1, 1, 9, "c", 6)
    assert metrics.threshold_violations(new, ["loc=5"]).count() == 1
    with pytest.raises(ValueError):
        metrics.threshold_violations(new, ["loc=5=6"])


def test_reach(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y")], "src string, dst string")
    entry = spark.createDataFrame([("A",)], "node string")
    assert {r[0] for r in graph.reach(edges, entry).collect()} == {"A", "B", "C"}
    with pytest.raises(graph.NoEntryPoints):
        graph.reach(edges, entry.limit(0))


@pytest.mark.parametrize("one_task", [0, 1000])
def test_reach_on_random_graphs(spark, one_task):
    r = random.Random(3)
    pairs = [(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}") for _ in range(70)] + [("n1", None), (None, "n2")]
    want, todo = {"n0", "n5", "alone"}, ["n0", "n5"]
    while todo:
        at = todo.pop()
        for a, b in pairs:
            if a == at and b is not None and b not in want:
                want.add(b)
                todo.append(b)
    starts = spark.createDataFrame([("n0",), ("n5",), ("n5",), ("alone",)], "path string")
    edges = spark.createDataFrame(pairs, "src_path string, dst_path string")
    got = [x[0] for x in graph.reachable_files(starts, edges, one_task).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.reachable_files(starts, edges.limit(0), one_task).count() == 3
    assert graph.reachable_files(starts.limit(0), edges, one_task).count() == 0


def test_imports(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/foo.ts",), ("x.js",)], "path string")
    cases = [("src/m.ts", 0, "'./a'", "src/a.ts"), ("src/m.ts", 1, "'./lib'", "src/lib/index.ts"), ("src/m.ts", 2, "'./foo.service'", "src/foo.ts"), ("src/m.ts", 3, "'react'", None), ("src/m.ts", 4, "'@/x'", "x.js"), ("src/n/m.ts", 5, "'../a'", None)]
    rows = spark.createDataFrame([c[:3] for c in cases], "path string, ordinal int, source string")
    assert {r["ordinal"]: r["resolved"] for r in graph.resolve_imports(rows, files).collect()} == {c[1]: c[3] for c in cases}
    assert {r["ordinal"]: r["resolved"] for r in graph.resolve_imports(rows, files, resolve_parent=True).collect()}[5] == "src/a.ts"


def test_debounce_against_a_walk(spark):
    r = random.Random(1)
    events = [(k, datetime.fromtimestamp(1_700_000_000 + r.randint(0, 400))) for k in "abc" for _ in range(60)]
    got = sorted((x["path"], x["n_changes"]) for x in watch_state.debounced(spark.createDataFrame(events, "path string, ts timestamp"), 30_000_000).collect())
    want = []
    for k in "abc":
        start, n = None, 0
        for t in sorted(t for p, t in events if p == k):
            if start is None or (t - start).total_seconds() >= 30:
                if n:
                    want.append((k, n))
                start, n = t, 0
            n += 1
        want.append((k, n))
    assert got == sorted(want)


def test_percentages_and_tooltips(spark):
    assert [one(spark, S.format_percent(F.lit(x).cast("double"), signed=True)) for x in (10.25, -0.75, 0.0, None)] == ["+10.2%", "-0.8%", "+0.0%", None]
    assert one(spark, S.format_percent(F.lit(12.345), 4)) == "12.3450%"
    assert [one(spark, S.tooltip(F.lit(45.25), F.lit(r).cast("double"))[1]) for r in (0.125, 0.0, None)] == ["12.5%", None, None]
    assert one(spark, S.tooltip(F.lit(60), F.lit(0.5))[0]) == "60.0 (High)" and one(spark, S.tooltip(F.lit(60), F.lit(0.5), overlay=False)[1]) is None


def test_crumbs_and_rings(spark):
    t = tree.nodes(spark.createDataFrame([("a/b/x.ts", 3), ("a/y.ts", 5), ("c/z.ts", 5)], "path string, loc long"))
    assert [r["path"] for r in tree.ancestors_of(t, "/a/b/").collect()] == ["", "a", "a/b"]
    assert [r["path"] for r in tree.ancestors_of(t, "").collect()] == [""]
    assert [r["path"] for r in tree.by_size(t).collect()] == ["", "a", "c", "a/y.ts", "a/b", "a/b/x.ts", "c/z.ts"]


def test_chart_marks(spark):
    color, width = S.overlay_border(F.col("r"))
    rows = spark.createDataFrame([(0.6,), (0.0,), (None,), (float("nan"),), (0.1,)], "r double").select(color, width).collect()
    assert [tuple(r) for r in rows] == [("#ef4444", 3), ("#ffffff", 2), ("#ffffff", 2), ("#ffffff", 2), ("#eab308", 3)]
    assert one(spark, S.overlay_border(F.lit(0.6), on=False)[1]) == 2
    assert one(spark, S.chart_label(F.lit("a"), F.lit("file"), F.lit(500))) == "" and one(spark, S.chart_label(F.lit("a"), F.lit("directory"), F.lit(0))) == "a"
    none = tree.nodes(spark.createDataFrame([], "path string, loc long"))
    assert none.count() == 1 and tree.visible(none).count() == 0 and not tree.lazy_chart(none).first()["lazy"]
    some = tree.nodes(spark.createDataFrame([("a/b.rs", 10)], "path string, loc long"))
    assert {r["path"] for r in tree.visible(some).collect()} == {"", "a", "a/b.rs"}


def test_candidates_of_imports_are_not_broadcast(spark):
    """Their estimated size is that of the files that Python has read; a large table's candidates did not fit the driver."""
    rows = spark.range(9).selectExpr("concat('src/p', id, '.ts') path", "0 ordinal", "concat('./p', id - 1) source").mapInPandas(lambda batches: batches, "path string, ordinal int, source string")
    found = graph.resolve_imports(rows, rows.select("path"))
    assert {(r["path"], r["resolved"]) for r in found.collect()} == {(f"src/p{i}.ts", f"src/p{i - 1}.ts" if i else None) for i in range(9)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [candidate" in plan and "BroadcastHashJoin [candidate" not in plan
