"""The engine's operators as queries over the driver's tables, each with the SQL that says the same.

A document is a file at source/lang/doc_id.txt; a part is a symbol in a file of its type and brand; two parts on the first
two lines of an urgent order are an import. Inventory handles of the blueprint stand in each function's docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalars as S
from canopy.functions.loc import count_lines, loc
from canopy.functions.paths import WATCHED, component_order, excluded, extension, file_name, in_test_folder, is_entry_file, is_test_file, language
from canopy.operators import deadcode, diff, graph, metrics, tree, watch_state
from canopy.operators.parse import imports, parse_files
from canopy.operators.parse import symbols as parsed_symbols
from canopy.plans.work import cut
from canopy.sinks.reports import FINE_TIERS, csv_table, dead_json_table, json_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-08-02 12:00:00"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = document_files(spark, sf_dir).select("path", count_lines(F.col("content")).alias("loc"), F.octet_length("content").cast("long").alias("size_bytes"))
    return m.withColumns({"function_count": F.lit(0).cast("long"), "complexity": S.complexity(F.col("loc")).cast("long")})


METRICS = r"""
f AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS content FROM documents),
m AS (SELECT path, CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS loc, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes FROM f),
fm AS (SELECT *, least(loc // 10, 100) AS complexity FROM m)
"""


@query(f"WITH {METRICS} SELECT path, loc, size_bytes, complexity FROM fm")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 P6 P8"""
    return document_metrics(spark, sf_dir).select("path", "loc", "size_bytes", "complexity")


@query(r"""SELECT page_id, CAST(len(list_filter(string_split(regexp_replace(coalesce(html, ''), '<!--.*?-->', chr(1) || chr(1), 'gs'), chr(10)),
 lambda x: regexp_matches(x, '\S') AND regexp_matches(regexp_replace(x, '^\s+', ''), '[^\x01]'))) AS BIGINT) AS loc FROM pages""")
def html_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 P4"""
    return read(spark, sf_dir, "pages").select("page_id", loc(F.coalesce("html", F.lit("")), "html").alias("loc"))


@query(f"WITH {METRICS} SELECT count(*) AS total_files, CAST(coalesce(sum(loc), 0) AS BIGINT) AS total_loc, CAST(0 AS BIGINT) AS total_functions FROM fm")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1"""
    return metrics.summary(document_metrics(spark, sf_dir))


@query(f"WITH {METRICS} SELECT path, loc, row_number() OVER (ORDER BY loc DESC, string_split(path, '/')) AS rank FROM fm ORDER BY rank LIMIT 10")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 K4"""
    return metrics.ranked(metrics.largest_files(document_metrics(spark, sf_dir))).select("path", "loc", F.col("rank").cast("long").alias("rank"))


@query("SELECT page_id, url FROM pages WHERE regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]\\.([^./]+)$', 1) IN ('html', 'htm')")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6"""
    return read(spark, sf_dir, "pages").filter(extension(F.regexp_replace("url", r"[?#].*$", "")).isin("html", "htm")).select("page_id", "url")


@query(f"WITH {METRICS} SELECT path FROM f WHERE NOT (regexp_full_match(path, '(.*/)?de/.*') OR regexp_full_match(path, 'src1.*/.*7\\.txt'))")
def exclude_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4"""
    return document_files(spark, sf_dir).filter(~excluded(F.col("path"), ["**/de/**", "src1*/*7.txt"])).select("path")


@query(f"WITH {METRICS} SELECT path, size_bytes FROM fm WHERE size_bytes <= 4096")
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5"""
    return document_metrics(spark, sf_dir).filter("size_bytes <= 4096").select("path", "size_bytes")


TREE = f"""{METRICS},
d AS (SELECT '' AS path, loc FROM fm UNION ALL SELECT split_part(path, '/', 1), loc FROM fm UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), loc FROM fm),
dirs AS (SELECT path, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS n_files FROM d GROUP BY path),
n AS (
  SELECT path, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS parent_id, CASE WHEN path = '' THEN 'root' ELSE string_split(path, '/')[-1] END AS name,
    'directory' AS type, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, loc FROM dirs
  UNION ALL SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 3), 'file', 3, loc FROM fm),
nodes AS (SELECT *, least(loc // 10, 100) AS complexity FROM n)
"""


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(document_metrics(spark, sf_dir).select("path", "loc"))


LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


@query(f"WITH {TREE} SELECT path, loc, n_files, least(loc // 10, 100) AS complexity FROM dirs")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 A6 A12 P8"""
    d = tree.directories(document_metrics(spark, sf_dir).select("path", "loc"))
    return d.select("path", "loc", "n_files", S.complexity(F.col("loc")).cast("long").alias("complexity"))


@query(f"WITH {TREE} SELECT parent_id AS path, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 J11"""
    return tree.child_counts(document_tree(spark, sf_dir))


@query(f"WITH {TREE} SELECT path, name, type, CAST(depth AS BIGINT) AS depth, loc, CAST(complexity AS BIGINT) AS complexity FROM nodes WHERE depth <= 2")
def depth_limited_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6"""
    return tree.limited(document_tree(spark, sf_dir), 2).select("path", "name", "type", *LONG("depth", "loc", "complexity"))


@query(f"WITH {TREE} SELECT path, type, loc FROM nodes WHERE path = 'src3' OR starts_with(path, 'src3/')")
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 G4 A12 A13"""
    return tree.subtree(document_tree(spark, sf_dir), "src3").select("path", "type", "loc")


@query(f"WITH {TREE} SELECT path, type, loc FROM nodes WHERE type = 'directory' AND depth = 2 AND name = 'fr' ORDER BY string_split(path, '/') LIMIT 1")
def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap before the segment is allowed, the first in page order is taken"""
    return tree.find_by_path(document_tree(spark, sf_dir), "/fr/").select("path", "type", "loc")


@query("""WITH f AS (SELECT ['data', 'customers', 'n' || (c_nationkey % 1), c_mktsegment] AS folder FROM customer),
c AS (SELECT i, count(DISTINCT folder[i]) AS n, max(folder[i]) AS part FROM f, range(1, 5) x(i) GROUP BY i)
SELECT string_agg(part, '/' ORDER BY i) AS root FROM c WHERE i < coalesce((SELECT min(i) FROM c WHERE n > 1), 5) - CASE WHEN (SELECT max(n) FROM c) = 1 THEN 1 ELSE 0 END""")
def common_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all customers, some folders deep"""
    c = read(spark, sf_dir, "customer")
    return tree.common_root(c.select(F.concat_ws("/", F.lit("data"), F.lit("customers"), F.concat(F.lit("n"), (F.col("c_nationkey") % 1).cast("string")), "c_mktsegment", F.col("c_custkey").cast("string")).alias("path")))


@query(f"""WITH {METRICS}, p AS (SELECT split_part(path, '/', 1) AS top, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM f)
SELECT CASE WHEN count(DISTINCT top) <> 1 THEN '' WHEN count(DISTINCT folder) = 1 AND count(*) = 1 THEN max(folder) ELSE max(top) END AS root FROM p""")
def documents_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents"""
    return tree.common_root(document_files(spark, sf_dir))


COLOR = """CASE WHEN c <= 30 THEN printf('#%02x%02x%02x', CAST(floor(34 + c / 30.0 * 200 + 0.5) AS INT), CAST(floor(197 - c / 30.0 * 18 + 0.5) AS INT), CAST(floor(94 - c / 30.0 * 86 + 0.5) AS INT))
 WHEN c <= 60 THEN printf('#%02x%02x%02x', CAST(floor(234 + (c - 30) / 30.0 * 5 + 0.5) AS INT), CAST(floor(179 - (c - 30) / 30.0 * 111 + 0.5) AS INT), CAST(floor(8 + (c - 30) / 30.0 * 60 + 0.5) AS INT))
 ELSE printf('#%02x%02x%02x', CAST(floor(239 - (c - 60) / 40.0 * 19 + 0.5) AS INT), CAST(floor(68 - (c - 60) / 40.0 * 30 + 0.5) AS INT), CAST(floor(68 - (c - 60) / 40.0 * 30 + 0.5) AS INT)) END"""


@query(f"WITH {TREE}, x AS (SELECT *, complexity::DOUBLE AS c FROM nodes) SELECT name, path, type, loc AS value, CASE WHEN type = 'file' THEN {COLOR} END AS color FROM x")
def chart_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 F14 F21"""
    return tree.chart_nodes(document_tree(spark, sf_dir))


@query(f"""WITH {TREE} SELECT path, CASE WHEN type = 'directory' OR loc > 500 THEN name ELSE '' END AS label, CASE WHEN complexity = 0 THEN '#ffffff' WHEN complexity > 50 THEN '#ef4444' WHEN complexity > 20 THEN '#f97316' ELSE '#eab308' END AS border, CASE WHEN complexity = 0 THEN 2 ELSE 3 END AS border_width
FROM nodes n WHERE type = 'file' OR EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.path)""")
def chart_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio is a hundredth of the complexity"""
    color, width = S.overlay_border(F.col("complexity") / 100)
    return tree.visible(document_tree(spark, sf_dir)).select("path", S.chart_label(F.col("name"), F.col("type"), F.col("loc")).alias("label"), color.alias("border"), width.alias("border_width"))


@query(f"WITH {TREE} SELECT count(*) FILTER (type = 'file') AS n_files, count(*) FILTER (type = 'file') > 50000 AS lazy FROM nodes UNION ALL SELECT count(*), count(*) > 100 FROM nodes WHERE type = 'file'")
def lazy_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: with the fixed limit and with one that is passed"""
    t = document_tree(spark, sf_dir)
    return tree.lazy_chart(t).union(tree.lazy_chart(t, above=100))


@query(f"""WITH x AS (SELECT p_partkey, p_size * 2.0::DOUBLE AS c, p_size / 50.0 AS r FROM part)
SELECT p_partkey, {COLOR} AS color, CASE WHEN c < 30 THEN 'Low' WHEN c < 60 THEN 'Medium' WHEN c < 80 THEN 'High' ELSE 'Very High' END AS label,
 CASE WHEN r > 0.5 THEN '#ef4444' WHEN r > 0.2 THEN '#f97316' ELSE '#eab308' END AS border, CASE WHEN c > 80 THEN '#22c55e' WHEN c >= 60 THEN '#eab308' ELSE '#ef4444' END AS confidence_color FROM x""")
def labels_and_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 F8 F9 F10"""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2.0).alias("c"), (F.col("p_size") / 50.0).alias("r"))
    return p.select("p_partkey", S.complexity_color(F.col("c")).alias("color"), S.complexity_label(F.col("c")).alias("label"), S.dead_border_color(F.col("r")).alias("border"), S.confidence_color(F.col("c")).alias("confidence_color"))


@query("""WITH x AS (SELECT doc_id, n_chars, length(CAST(n_chars AS VARCHAR)) AS k FROM documents)
SELECT doc_id, format('{:,}', n_chars) AS number, CASE WHEN n_chars <= 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.2f KB', floor(n_chars / 1024.0::DOUBLE * 100 + 0.5) / 100) ELSE printf('%.2f MB', floor(n_chars / 1048576.0::DOUBLE * 100 + 0.5) / 100) END AS bytes FROM x""")
def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 F3"""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", S.format_number(F.col("n_chars")).alias("number"), S.format_bytes(F.col("n_chars")).alias("bytes"))


@query("""SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE '...' || right(url, 27) END AS at_start, CASE WHEN length(url) <= 30 THEN url ELSE left(url, 27) || '...' END AS at_end FROM pages""")
def format_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 F17"""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", S.format_path(F.col("url"), 30, "start").alias("at_start"), S.format_path(F.col("url"), 30, "end").alias("at_end"))


@query(f"""WITH x AS (SELECT o_orderkey, o_orderdate AS t, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, strftime(t, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS BIGINT) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END
 WHEN s < 86400 THEN CAST(s // 3600 AS BIGINT) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END WHEN s < 604800 THEN CAST(s // 86400 AS BIGINT) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END
 ELSE strftime(t, '%b %-d, %Y, %I:%M %p') END AS relative FROM x""")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 F5 F12"""
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.iso_timestamp(F.col("o_orderdate")).alias("iso"), S.format_relative_date(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp")).alias("relative"))


def half_report(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """A report: customers as files, their orders before 1997, or from then on, as lines. The filter reaches the scan; both reports have all orders."""
    since = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    o = read(spark, sf_dir, "orders").filter(since if new else ~since)
    return o.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("loc"))


REPORTS = """
o_old AS (SELECT CAST(o_custkey AS VARCHAR) AS path, count(*) AS loc FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
o_new AS (SELECT CAST(o_custkey AS VARCHAR) AS path, count(*) AS loc FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1),
df AS (SELECT coalesce(a.path, b.path) AS path, a.loc AS old_loc, b.loc AS new_loc, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
  FROM o_old a FULL JOIN o_new b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.loc <> b.loc)
"""


@query(f"WITH {REPORTS} SELECT * FROM df")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 D4"""
    return diff.report_diff(half_report(spark, sf_dir, False), half_report(spark, sf_dir, True))


@query(f"""WITH {REPORTS}, g AS (SELECT path, new_loc - old_loc AS d FROM df WHERE status = 'modified' AND new_loc > old_loc ORDER BY d DESC, path LIMIT 1)
SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'modified') AS modified,
 CAST(sum(coalesce(new_loc, 0) - coalesce(old_loc, 0)) AS BIGINT) AS total_delta, (SELECT path FROM g) AS largest_growth_path, (SELECT d FROM g) AS largest_growth FROM df""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 T5"""
    return diff.diff_summary(diff.report_diff(half_report(spark, sf_dir, False), half_report(spark, sf_dir, True)))


@query(f"""WITH {REPORTS}, t AS (SELECT (SELECT CAST(sum(loc) AS BIGINT) FROM o_new) AS current_loc, (SELECT CAST(sum(loc) AS BIGINT) FROM o_old) AS base_loc)
SELECT current_loc, base_loc, (current_loc - base_loc) / base_loc * 100 AS change_pct, (current_loc - base_loc) / base_loc * 100 > 10.0 AS failed FROM t""")
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23"""
    total = lambda new: half_report(spark, sf_dir, new).agg(F.sum("loc").alias("total_loc"))
    return metrics.baseline_gate(total(True), total(False))


@query(f"WITH {METRICS} SELECT path, loc FROM fm WHERE loc > 20")
def threshold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21"""
    return metrics.threshold_violations(document_metrics(spark, sf_dir), ["loc=20"]).select("path", "loc")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_type") == "SMALL", ".test.ts").otherwise(".ts"))
    kinds = F.when(F.col("p_size") < 20, "Function").when(F.col("p_size") < 30, "ArrowFunction").when(F.col("p_size") < 40, "Class").otherwise("Method")
    rows = p.select(path.alias("path"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), kinds.alias("kind"), F.col("p_partkey").alias("line_start"), (F.col("p_partkey") + F.col("p_size")).alias("line_end"), (F.col("p_retailprice") < 950).alias("is_exported"), F.col("p_partkey").alias("part"))
    return rows.withColumns({"id": F.concat_ws(":", "path", F.col("line_start").cast("string"), "name"), "is_test": in_test_folder(F.col("path"))})


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("o_orderkey")
    lines = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_partkey").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    where = symbols(spark, sf_dir).select("part", "path")
    side = lambda n, name: lines.filter(f"l_linenumber = {n}").join(where, F.col("l_partkey") == F.col("part")).select("l_orderkey", F.col("path").alias(name))
    return side(1, "src_path").join(side(2, "dst_path"), "l_orderkey").select("src_path", "dst_path").distinct()


GRAPH = r"""
sy AS (SELECT 'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '_' || p_size || CASE WHEN p_type = 'SMALL' THEN '.test.ts' ELSE '.ts' END AS path, replace(p_name, ' ', '_') AS name,
  CASE WHEN p_size < 20 THEN 'Function' WHEN p_size < 30 THEN 'ArrowFunction' WHEN p_size < 40 THEN 'Class' ELSE 'Method' END AS kind, p_partkey AS line_start, p_partkey + p_size AS line_end, p_retailprice < 950 AS is_exported, p_type = 'SMALL' AS is_test, p_partkey AS part FROM part),
s AS (SELECT *, path || ':' || line_start || ':' || name AS id FROM sy),
l AS (SELECT l_orderkey, l_linenumber, path FROM lineitem JOIN s ON l_partkey = part WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')),
fe AS (SELECT DISTINCT a.path AS src_path, b.path AS dst_path FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
en AS (SELECT id, path FROM s WHERE name = 'main' OR is_test),
te AS (SELECT * FROM fe WHERE dst_path IN (SELECT path FROM s WHERE is_exported)),
rf AS (SELECT path FROM en UNION SELECT dst_path FROM te JOIN rf ON te.src_path = rf.path),
rs AS (SELECT id FROM en UNION SELECT id FROM s WHERE is_exported AND path IN (SELECT dst_path FROM te JOIN rf ON te.src_path = rf.path)),
ts AS (SELECT DISTINCT name FROM s WHERE is_test),
nt AS (SELECT DISTINCT s.id FROM s WHERE EXISTS (SELECT 1 FROM ts WHERE contains(ts.name, s.name)) UNION SELECT id FROM s WHERE is_exported AND path IN (SELECT dst_path FROM fe JOIN s t ON fe.src_path = t.path WHERE t.is_test AND t.is_exported)),
dead AS (SELECT path, id, name AS symbol, kind, line_start, line_end, line_end - line_start + 1 AS loc, is_exported, CAST(100 - CASE WHEN is_exported THEN 30 ELSE 0 END - CASE WHEN id IN (SELECT id FROM nt) THEN 15 ELSE 0 END AS INT) AS confidence FROM s WHERE id NOT IN (SELECT id FROM rs))
"""
WITH_GRAPH = f"WITH RECURSIVE {GRAPH}"


@query(f"{WITH_GRAPH} SELECT DISTINCT a.id AS src, b.id AS dst FROM fe JOIN s a ON a.path = fe.src_path JOIN s b ON b.path = fe.dst_path AND b.is_exported")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 A7"""
    return graph.symbol_edges(symbols(spark, sf_dir), file_edges(spark, sf_dir))


@query(f"{WITH_GRAPH} SELECT id, path FROM en")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 P13 P14 J8 D3"""
    return graph.entry_points(symbols(spark, sf_dir))


@query(f"{WITH_GRAPH} SELECT id FROM rs")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 D2"""
    s = symbols(spark, sf_dir)
    return graph.reachable_symbols(s, file_edges(spark, sf_dir), graph.entry_points(s))


def dead(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dead symbols and all symbols; edges are computed once for the walk and the tests' coverage."""
    s = symbols(spark, sf_dir).drop("part")
    return deadcode.dead_symbols(s, cut(file_edges(spark, sf_dir)), F.lit(AS_OF).cast("timestamp")), s


@query(f"{WITH_GRAPH} SELECT path, id, symbol, kind, loc, confidence FROM dead")
def dead_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 J6 J7 P9 P10 P16 P17 P19 P27 D1"""
    return dead(spark, sf_dir)[0].select("path", "id", "symbol", "kind", "loc", "confidence")


@query(f"{WITH_GRAPH} SELECT path, id FROM dead WHERE confidence >= 80")
def min_confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20"""
    return deadcode.confident(dead(spark, sf_dir)[0], 80).select("path", "id")


@query(f"{WITH_GRAPH} SELECT CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM dead GROUP BY 1")
def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 K6"""
    return dead(spark, sf_dir)[0].groupBy(deadcode.tier(F.col("confidence")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH_GRAPH} SELECT path, count(*) FILTER (WHERE kind <> 'Class') AS dead_function_count, CAST(sum(loc) AS BIGINT) AS dead_code_loc, count(*) AS n_symbols FROM dead GROUP BY 1")
def dead_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 A4 A8"""
    return deadcode.by_file(dead(spark, sf_dir)[0])


@query(f"{WITH_GRAPH} SELECT path, CAST(sum(loc) AS BIGINT) AS dead_code_loc FROM dead GROUP BY 1 ORDER BY 2 DESC, string_split(path, '/') LIMIT 10")
def top_dead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 T2"""
    return deadcode.top_files(dead(spark, sf_dir)[0]).select("path", "dead_code_loc")


SUMMARY = "count(DISTINCT path) AS files_with_dead_code, count(*) FILTER (WHERE kind <> 'Class') AS dead_functions, count(*) FILTER (WHERE kind = 'Class') AS dead_classes, CAST(coalesce(sum(loc), 0) AS BIGINT) AS total_dead_loc"


@query(f"{WITH_GRAPH} SELECT count(DISTINCT path) AS total_files, {SUMMARY}, sum(loc) / (SELECT sum(line_end - line_start + 1) FROM s) AS dead_code_ratio FROM dead")
def dead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 A10"""
    return deadcode.dead_summary(*dead(spark, sf_dir))


@query(f"""{WITH_GRAPH}, w AS (SELECT count(DISTINCT path) AS n, sum(loc) AS t FROM dead) SELECT (SELECT n FROM w) AS total_files, {SUMMARY},
 sum(loc) / (SELECT t FROM w) * ((SELECT t FROM w) / (SELECT sum(line_end - line_start + 1) FROM s)) AS dead_code_ratio FROM dead WHERE confidence >= 80""")
def filtered_dead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 P22"""
    d, s = dead(spark, sf_dir)
    return deadcode.filtered_summary(cut(d), s, 80)  # read twice


@query(f"""{WITH_GRAPH}, fl AS (SELECT path, count(*) * 100 AS loc FROM s GROUP BY 1), b AS (SELECT path, count(*) FILTER (WHERE kind <> 'Class') AS c, CAST(sum(loc) AS BIGINT) AS d FROM dead GROUP BY 1)
SELECT fl.path, fl.loc, c AS dead_function_count, d AS dead_code_loc, d / fl.loc AS dead_code_ratio FROM fl LEFT JOIN b ON fl.path = b.path""")
def metrics_with_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 A2"""
    d, s = dead(spark, sf_dir)
    return deadcode.with_dead(s.groupBy("path").agg((F.count(F.lit(1)) * 100).alias("loc")), d)


@query(f"{WITH_GRAPH} SELECT id FROM nt")
def coverage_by_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 J7"""
    s = symbols(spark, sf_dir)
    return deadcode.tested_symbols(s, file_edges(spark, sf_dir), s)


@query(r"""WITH f AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '/$', '') AS path FROM pages),
i AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '/$', ''), '\.html$', '') AS base FROM pages),
c AS (SELECT page_id, base AS candidate, 0 AS pos FROM i UNION ALL SELECT page_id, regexp_replace(base, '([^/])\.[^./]*$', '\1') || '.ts', 1 FROM i UNION ALL SELECT page_id, base || '/index.ts', 5 FROM i)
SELECT i.page_id, (SELECT arg_min(candidate, pos) FROM c JOIN f ON c.candidate = f.path WHERE c.page_id = i.page_id) AS resolved FROM i""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is imported from the top by its address without an extension"""
    p = read(spark, sf_dir, "pages")
    at = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://", ""), "/$", "")
    imports = p.select(F.lit("main.ts").alias("path"), F.col("page_id").alias("ordinal"), F.concat(F.lit("'@/"), F.regexp_replace(at, r"\.html$", ""), F.lit("'")).alias("source"))
    return graph.resolve_imports(imports, p.select(at.alias("path"))).select(F.col("ordinal").alias("page_id"), "resolved")


@query("""WITH a AS (SELECT doc_id, n_chars FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, CASE WHEN source = 'src1' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE lang <> 'de')
SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS path, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars""")
def cache_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 C4"""
    d = read(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    return watch_state.stale(d.filter("lang <> 'fr'").select(path, F.col("n_chars").alias("hash")), d.filter("lang <> 'de'").select(path, F.when(F.col("source") == "src1", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("hash")))


@query("SELECT user_id, e.event_type, e.value FROM (SELECT user_id, arg_max({'event_type': event_type, 'value': value}, (ts, event_id)) AS e FROM events GROUP BY 1) WHERE e.event_type <> 'error'")
def watch_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 W4 D5 D6"""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return watch_state.latest_state(e, "user_id", ["ts", "event_id"], "event_type = 'error'").select("user_id", "event_type", "value")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
w AS (SELECT user_id, us, rn, us AS start FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.us, e.rn, CASE WHEN e.us >= w.start + 7200000000 THEN e.us ELSE w.start END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, make_timestamp(start) AS window_start, count(*) AS n_changes FROM w GROUP BY user_id, start""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours from a user's first event"""
    return watch_state.debounced(read(spark, sf_dir, "events"), 7_200_000_000, "user_id")


@query("""WITH j AS (SELECT l.quality = 0 AS dead, n_chars < 800 AS said FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT count(*) FILTER (WHERE said AND dead) AS tp, count(*) FILTER (WHERE said AND NOT dead) AS fp, count(*) FILTER (WHERE dead AND NOT said) AS fn FROM j)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END AS fp_rate, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1 END AS accuracy FROM c""")
def detector_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents taken as poor ones"""
    truth = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 0).alias("dead"))
    return deadcode.accuracy(read(spark, sf_dir, "documents").filter("n_chars < 800").select(F.col("doc_id").alias("key")), truth)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each part: a function over p_size lines, a class with a method for some, an arrow for others, an import of the part before."""
    p = read(spark, sf_dir, "part")
    key, name = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))
    exported = F.when(F.col("p_retailprice") < 950, "export ").otherwise("")
    text = F.concat(
        F.lit("import { x } from './p"), (F.col("p_partkey") - 1).cast("string"), F.lit("';\n/* function no() {} */\n"),
        exported, F.lit("function "), name, F.lit("(a: () => void) {"), F.repeat(F.lit("\n"), F.col("p_size")), F.lit("}\n"),
        F.when(F.col("p_size") % 2 == 0, F.lit("class K { go() { return `${x}` } }\n")).otherwise(F.lit("const k = (y: number): string => '{';\n")),
    )
    return p.select(F.concat(F.lit("src/p"), key, F.lit(".ts")).alias("path"), text.alias("content"))


@query("SELECT 'src/p' || p_partkey || '.ts' AS path, CAST(2 AS BIGINT) AS function_count FROM part")
def function_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 P5 S14"""
    return parse_files(sources(spark, sf_dir)).select("path", "function_count")


@query("""SELECT 'src/p' || p_partkey || '.ts' AS path, replace(p_name, ' ', '_') AS name, 'Function' AS kind, CAST(3 AS BIGINT) AS line_start, CAST(3 + p_size AS BIGINT) AS line_end, p_retailprice < 950 AS is_exported FROM part
UNION ALL SELECT 'src/p' || p_partkey || '.ts', 'k', 'ArrowFunction', 4 + p_size, 4 + p_size, false FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'src/p' || p_partkey || '.ts', unnest(['K', 'go']), unnest(['Class', 'Method']), 4 + p_size, 4 + p_size, false FROM part WHERE p_size % 2 = 0""")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 P24"""
    return parsed_symbols(parse_files(sources(spark, sf_dir))).select("path", "name", "kind", "line_start", "line_end", "is_exported")


@query("SELECT 'src/p' || p_partkey || '.ts' AS path, CASE WHEN p_partkey - 1 IN (SELECT p_partkey FROM part) THEN 'src/p' || (p_partkey - 1) || '.ts' END AS resolved FROM part")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parsed sources"""
    files = sources(spark, sf_dir)
    found = cut(imports(parse_files(files)), "imports")  # read twice, parsed once
    return graph.resolve_imports(found, files.select("path")).select("path", "resolved")


@query("SELECT 'src/p' || p_partkey || '.ts' AS path, 'typescript' AS language, CAST(4 AS BIGINT) AS loc, CAST(2 AS BIGINT) AS functions FROM part")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the CSV report"""
    rows = metrics.file_metrics(parse_files(sources(spark, sf_dir), keep=("content",)))
    return csv_table(rows).select("path", "language", "loc", "functions")


@query(f"WITH {TREE} SELECT path, type, loc, CASE WHEN type = 'directory' THEN loc * 2 END AS twice FROM nodes WHERE path = 'src3'")
def selected_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selected node and what a report says of its path"""
    t = document_tree(spark, sf_dir)
    report = t.filter("type = 'directory'").select("path", (F.col("loc") * 2).alias("twice"))
    return tree.selected(t, "src3", report).select("path", "type", "loc", "twice")


@query(f"""WITH {TREE}, k AS (SELECT path, type, depth, CASE WHEN path = '' THEN [] WHEN type = 'directory' THEN list_transform(string_split(path, '/'), lambda x: '1' || x) ELSE list_concat(list_transform(string_split(path, '/')[:-2], lambda x: '1' || x), ['0' || string_split(path, '/')[-1]]) END AS key FROM nodes)
SELECT path, type, row_number() OVER (ORDER BY key) AS at FROM k WHERE path = 'src3' OR starts_with(path, 'src3/')""")
def flattened_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subtree in page order"""
    return tree.numbered(tree.subtree(document_tree(spark, sf_dir), "src3")).select("path", "type", "at")


@query(f"""WITH {TREE}, k AS (SELECT path, type, depth, CASE WHEN path = '' THEN [] WHEN type = 'directory' THEN list_transform(string_split(path, '/'), lambda x: '1' || x) ELSE list_concat(list_transform(string_split(path, '/')[:-2], lambda x: '1' || x), ['0' || string_split(path, '/')[-1]]) END AS key FROM nodes)
SELECT path, type, row_number() OVER (ORDER BY key) AS at FROM k""")
def flattened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree in page order"""
    return tree.numbered(document_tree(spark, sf_dir)).select("path", "type", "at")


@query(f"WITH {TREE} SELECT path, name, CAST(depth AS BIGINT) AS depth FROM nodes WHERE path IN ('', 'src3', 'src3/de')")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8"""
    return tree.ancestors_of(document_tree(spark, sf_dir), "src3/de").select("path", "name", *LONG("depth"))


@query(f"WITH {TREE} SELECT parent_id, path, row_number() OVER (PARTITION BY parent_id ORDER BY loc DESC, name) AS rank FROM nodes WHERE type = 'directory' AND parent_id IS NOT NULL")
def ring_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each folder among its siblings"""
    return tree.ring_order(document_tree(spark, sf_dir).filter("type = 'directory'")).select("parent_id", "path", "rank")


@query("""SELECT p_partkey, printf('%.1f', p_size * 2.0::DOUBLE) || ' (' || CASE WHEN p_size < 15 THEN 'Low' WHEN p_size < 30 THEN 'Medium' WHEN p_size < 40 THEN 'High' ELSE 'Very High' END || ')' AS shown,
 CASE WHEN p_size > 10 THEN printf('%.1f%%', p_size / 64.0::DOUBLE * 100) END AS share, printf('%+.1f%%', p_size - 25.0::DOUBLE) AS change, printf('%.4f', p_size / 64.0::DOUBLE) AS ratio FROM part""")
def tooltips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 F18"""
    size = F.col("p_size").cast("double")
    shown, share = S.tooltip(size * 2, F.when(size > 10, size / 64))
    return read(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"), share.alias("share"), S.format_percent(size - 25, signed=True).alias("change"), F.replace(S.format_percent(size / 64, 4), F.lit("%"), F.lit("")).alias("ratio"))


@query(f"WITH {METRICS} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS at FROM f")
def files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's place by path component"""
    return tree.in_places(document_files(spark, sf_dir).select("path"), component_order(F.col("path"))).select("path", "at")


PATHS = ["src/a.test.ts", "src/a.spec.js", "src/__tests__/a.ts", "src/test/a.go", "src/tests/a.cc", "test/a.py", "tests/a.rs", "src/testing/a.hpp", "src/latest/a.h", "src/contest/a.cxx", "src/a.jsx", "lib/a.tsx", "lib/a.c", "lib/index.ts", "src/main.jsx", "src/lib.rs", "src/a.cpp", "src/xmain.ts"]


@query(f"""WITH p AS (SELECT p_partkey, ({PATHS})[p_partkey % {len(PATHS)} + 1] AS path FROM part), x AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '.')[-1] AS ext FROM p)
SELECT p_partkey, path, contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__') OR contains(path, '/test/') OR contains(path, '/tests/') OR starts_with(path, 'test/') OR starts_with(path, 'tests/') AS in_tests,
 contains(name, '.test.') OR contains(name, '.spec.') AS test_file, name IN ('main.ts', 'main.tsx', 'main.js', 'main.jsx', 'index.ts', 'index.tsx', 'index.js', 'index.jsx', 'lib.rs') AS entry_file, ext IN ('ts', 'tsx', 'js', 'jsx', 'rs', 'py') AS watched,
 CASE WHEN ext = 'ts' THEN 'typescript' WHEN ext = 'tsx' THEN 'tsx' WHEN ext IN ('js', 'jsx') THEN 'javascript' WHEN ext = 'rs' THEN 'rust' WHEN ext = 'py' THEN 'python' WHEN ext = 'go' THEN 'go' WHEN ext IN ('cpp', 'cc', 'cxx', 'hpp', 'h') THEN 'cpp' END AS language FROM x""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 P11 P12 P13 S7"""
    at = F.col("path")
    p = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS)).cast("int")).alias("path"))
    return p.select("p_partkey", "path", in_test_folder(at).alias("in_tests"), is_test_file(at).alias("test_file"), is_entry_file(at).alias("entry_file"), extension(at).isin(*WATCHED).alias("watched"), language(at).alias("language"))


@query(f"""SELECT o_orderkey || '.py' AS path, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '{AS_OF}' ELSE o_orderdate END AS last_modified, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS size_bytes FROM orders""")
def times_or_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without a time of its own has the run's"""
    o = read(spark, sf_dir, "orders")
    files = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), F.col("o_orderpriority").alias("content"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("last_modified"))
    return metrics.file_metrics(files, F.lit(AS_OF).cast("timestamp")).select("path", "last_modified", "size_bytes")


CODE = {  # a comment line, a line of code with a comment, a block over two lines, a string that looks like a comment, functions
    "rs": ("// note\nlet a = 1; // b\n/* c\nd */ let e = 2;\nlet s = \"/* no */\";\n", "fn f() {}\n", 3),
    "py": ("# note\na = 1  # b\n\n\ns = '# no'\n", "def f():\n    pass\n", 2),
    "go": ("// note\nvar a = 1 // b\n/* c\nd */ var e = 2\nvar s = \"// no\"\n", "func f() {}\n", 3),
    "cpp": ("// note\nint a = 1; // b\n/* c\nd */ int e = 2;\nconst char* s = \"// no\";\n", "int f() { return 1; }\n", 3),
    "js": ("// note\nlet a = 1; // b\n/* c\nd */ let e = 2;\nlet s = `// no`;\n", "const f = () => 1;\n", 3),
}


@query(f"""WITH p AS (SELECT p_partkey, p_size, (['rs', 'py', 'go', 'cpp', 'js'])[p_partkey % 5 + 1] AS ext FROM part)
SELECT 'p' || p_partkey || '.' || ext AS path, CAST(CASE WHEN ext = 'py' THEN 2 + 2 * (p_size % 7) ELSE 3 + p_size % 7 END AS BIGINT) AS loc, CAST(p_size % 7 AS BIGINT) AS function_count FROM p""")
def code_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, strings and functions of five languages"""
    p, kinds = read(spark, sf_dir, "part"), list(CODE)
    at = (F.col("p_partkey") % len(kinds)).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(CODE[x][k]) for x in kinds]), at)
    files = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, kinds)), at)).alias("path"), F.concat(pick(0), F.repeat(pick(1), F.col("p_size") % 7)).alias("content"))
    return metrics.file_metrics(parse_files(files, keep=("content",))).select("path", "loc", "function_count")


NAMED = ["plain", "x_handler", "Plugin_a", "LOADER_x", "a_Middleware", "hook_", "hooked", "my_hook"]


@query(f"""WITH p AS (SELECT p_partkey, p_size, ({NAMED})[p_partkey % {len(NAMED)} + 1] AS symbol, p_retailprice < 950 AS exported, p_partkey % 3 = 0 AS tested FROM part)
SELECT 'src/f' || p_size || '.ts' AS path, p_partkey AS line_start, symbol, 'Unreachable from entry points' AS reason, CAST(p_size + 1 AS BIGINT) AS loc,
 CAST(greatest(0, 100 - CASE WHEN exported THEN 30 ELSE 0 END - CASE WHEN p_size BETWEEN 1 AND 29 THEN 20 ELSE 0 END - CASE WHEN symbol IN ('x_handler', 'Plugin_a', 'LOADER_x', 'a_Middleware', 'hook_', 'my_hook') THEN 25 ELSE 0 END - CASE WHEN tested THEN 15 ELSE 0 END) AS INT) AS confidence FROM p""")
def confidence_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files changed p_size days ago, in the future for size 50 and more"""
    p = read(spark, sf_dir, "part")
    name = F.get(F.array(*map(F.lit, NAMED)), (F.col("p_partkey") % len(NAMED)).cast("int"))
    at = F.concat(F.lit("src/f"), F.col("p_size").cast("string"), F.lit(".ts"))
    found = p.select(at.alias("path"), F.col("p_partkey").cast("string").alias("id"), name.alias("name"), F.lit("Function").alias("kind"), F.col("p_partkey").alias("line_start"), (F.col("p_partkey") + F.col("p_size")).alias("line_end"), (F.col("p_retailprice") < 950).alias("is_exported"))
    as_of = F.lit(AS_OF).cast("timestamp")
    modified = p.select(at.alias("path"), "p_size").distinct().select("path", F.timestamp_seconds(F.unix_seconds(as_of) - F.when(F.col("p_size") < 50, F.col("p_size")).otherwise(-1) * 86400).alias("last_modified"))
    tested = found.filter("line_start % 3 = 0").select("id")
    return deadcode.scored(found, tested, as_of, modified).select("path", "line_start", "symbol", "reason", "loc", "confidence")


@query(f"{WITH_GRAPH} SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, line_start, line_end, symbol) AS rank FROM dead")
def symbols_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's dead symbols, the surest first"""
    return deadcode.by_confidence(dead(spark, sf_dir)[0]).select("path", "id", "rank")


@query(f"{WITH_GRAPH} SELECT path, string_agg(symbol || ':' || line_start, ',' ORDER BY line_start, line_end, symbol) AS found FROM dead GROUP BY path")
def nested_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4"""
    n = deadcode.nested_by_file(dead(spark, sf_dir)[0])
    return n.select("path", F.array_join(F.transform("dead_code", lambda d: F.concat_ws(":", d["symbol"], d["line_start"].cast("string"))), ",").alias("found"))


@query(f"""{WITH_GRAPH} SELECT path, '{{"path":"' || path || '","deadCode":[' || string_agg(printf('{{"symbol":"%s","kind":"%s","lineStart":%d,"lineEnd":%d,"loc":%d,"confidence":%d,"reason":"Unreachable from entry points"}}', symbol, kind, line_start, line_end, loc, confidence), ',' ORDER BY line_start, line_end, symbol) || ']}}' AS json FROM dead GROUP BY path""")
def dead_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the objects of the JSON report on dead code"""
    return dead_json_table(dead(spark, sf_dir)[0])


@query(f"""WITH {METRICS} SELECT path, '{{"path":"' || path || '","loc":' || loc || ',"size_bytes":' || size_bytes || ',"function_count":0}}' AS json FROM fm""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 K2: the objects of the JSON report"""
    return json_table(document_metrics(spark, sf_dir))


@query(f"""{WITH_GRAPH}, x AS (SELECT (SELECT count(DISTINCT path) FROM s) AS n_files, (SELECT count(DISTINCT path) FROM dead) AS files_with_dead_code) SELECT *, files_with_dead_code / n_files * 100 AS share, printf('%.1f%%', files_with_dead_code / n_files * 100) AS shown FROM x""")
def dead_file_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 K7"""
    return deadcode.share_of_files(*dead(spark, sf_dir)).withColumn("shown", S.format_percent(F.col("share")))


@query(f"{WITH_GRAPH} SELECT CASE WHEN confidence >= 90 THEN 'high' WHEN confidence >= 70 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM dead GROUP BY 1")
def fine_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers of the second text report"""
    return dead(spark, sf_dir)[0].groupBy(deadcode.tier(F.col("confidence"), *FINE_TIERS).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH_GRAPH} SELECT count(*) FILTER (WHERE kind <> 'Class') AS dead_functions FROM dead WHERE confidence >= 80 HAVING count(*) FILTER (WHERE kind <> 'Class') > 10")
def dead_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's row, if it breaks the rule"""
    return deadcode.summary_gate(deadcode.filtered_summary(*dead(spark, sf_dir), 80), ["dead_functions=10"]).select("dead_functions")


@query("SELECT kind, fits, long_label, short_label FROM (VALUES ('Function', 'Function', 'fn'), ('ArrowFunction', 'Arrow Function', '=>'), ('Class', 'Class', 'class'), ('Method', 'Method', 'method')) l(kind, long_label, short_label) JOIN (SELECT CASE WHEN p_size < 20 THEN 'Function' WHEN p_size < 30 THEN 'ArrowFunction' WHEN p_size < 40 THEN 'Class' ELSE 'Method' END AS kind, count(*) AS fits FROM part GROUP BY 1) USING (kind)")
def kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11"""
    k = symbols(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("fits"))
    return k.select("kind", "fits", S.kind_label(F.col("kind"), S.KIND_LONG).alias("long_label"), S.kind_label(F.col("kind")).alias("short_label"))


@query("SELECT * FROM (VALUES (0, '#22c55e', 'Low'), (15, '#84cc16', ''), (30, '#eab308', 'Medium'), (45, '#f59e0b', ''), (60, '#ef4444', 'High'), (80, '#dc2626', ''), (100, '#dc2626', 'Very High')) g(score, color, label)")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7"""
    return S.complexity_gradient(spark)


@query("SELECT user_id AS id, event_type AS name, event_id AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_of_each_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of symbols with one id the last one stays"""
    return graph.unique_symbols(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("ordinal")))


@query(f"""WITH {METRICS} SELECT count(*) AS total_files, CAST(sum(loc + CASE WHEN split_part(path, '/', 2) = 'de' THEN 1 ELSE 0 END) AS BIGINT) AS total_loc, CAST(0 AS BIGINT) AS total_functions FROM fm WHERE split_part(path, '/', 2) <> 'fr'""")
def changed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary after some files changed and some went"""
    state, lang = document_metrics(spark, sf_dir), F.element_at(F.split("path", "/"), 2)
    return metrics.summary(watch_state.upsert(state, state.filter(lang == "de").withColumn("loc", F.col("loc") + 1), state.filter(lang == "fr").select("path")))


@query("SELECT 'no entry points' AS said, count(*) FILTER (p_type <> 'SMALL') > 0 AS failed, CAST(0 AS BIGINT) AS dead_in_nothing FROM part")
def without_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols without an entry point are an error, no symbols are none"""
    s, edges, now = symbols(spark, sf_dir).drop("part"), file_edges(spark, sf_dir), F.lit(AS_OF).cast("timestamp")
    try:
        deadcode.dead_symbols(s.filter("NOT is_test"), edges, now)
        said = None
    except graph.NoEntryPoints as e:
        said = str(e)
    nothing = deadcode.dead_summary(deadcode.dead_symbols(s.limit(0), edges, now), s.limit(0))
    return nothing.select(F.lit("no entry points").alias("said"), F.lit(said == "no entry points").alias("failed"), F.col("total_dead_loc").alias("dead_in_nothing"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dir_rollup(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "file_name", "flagship"]
