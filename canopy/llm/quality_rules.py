"""Quality rules: counts within each document, and lines that too many documents of one host share.

Base rules look at a document alone. The method's verdict comes from the corpus: lines are normalised and hashed, the
distinct documents that hold a line are counted for each host, lines above the limit count as removed, and a document that
keeps too few of its words is rejected. The limit is one number, whatever the host's size; exact copies of a text are
documents like others, rows that repeat id and text are one. Hashes and counts travel, never texts; a host that holds a
third of all rows is split by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import free_names, held, once, stage, table, words

WINDOW = 8
#: A line is boilerplate in more distinct documents of its host than this.
LIMIT_DOCS = 20
#: A document is depleted if fewer words, or a smaller share of its words, are left.
LEAST_WORDS, LEAST_SHARE = 20, 0.3


def window_hashes(hashes: Column, width: int = WINDOW) -> Column:
    """A hash for each run of width (a power of two) elements: of pairs, pairs of pairs, and so on. None for shorter arrays."""
    if width == 1:
        return hashes
    step = width // 2
    ends = lambda a: (F.greatest(F.size(a) - step, F.lit(0)))
    return once(window_hashes(hashes, step), lambda a: F.zip_with(F.slice(a, F.lit(1), ends(a)), F.slice(a, F.lit(step + 1), ends(a)), lambda x, y: F.xxhash64(x, y)))


def normal(line: Column) -> Column:
    """A line as lines are compared across documents: stripped, lower-cased, with each run of digits as one 0."""
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))), r"[0-9]+", "0")


def line_hashes(text: Column) -> Column:
    """(line: hash of the normal line, n: its words) of each \\n-split line."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(words(x)).alias("n")))


def described(docs: DataFrame, host_col: str) -> DataFrame:
    """All that later steps need of a text, in a written table: doc_id, host, text_hash, the base counts, base_failed, lines (line_hashes with words). Texts are read once; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    keep = ["doc_id", "host", "text_hash"]
    d = docs.select("doc_id", F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.xxhash64("text").alias("text_hash"), text.alias("_t"), words(text).alias("_w"))
    split = F.split("_t", "\n", -1)
    with_word = F.filter(split, lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        with_word.alias("_l"),
        F.filter(line_hashes(F.col("_t")), lambda x: x["n"] > 0).alias("lines"),
        window_hashes(F.transform("_w", lambda w: F.xxhash64(w))).alias("_x"),
    )
    d = d.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), "lines", "_x", (F.size(F.array_distinct("_x")) < F.size("_x")).alias("_r"))
    # of windows that are sorted with their places, those equal to a neighbour are repeated
    paired = F.array_sort(F.transform("_x", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.col("_r")
    d = d.withColumn("_s", F.when(repeats, paired))
    again = F.filter("_s", lambda x, i: ((i > 0) & (F.get("_s", i - 1)["h"] == x["h"])) | (F.get("_s", i + 1)["h"] == x["h"]))
    d = d.withColumn("_p", F.when(repeats, F.array_sort(F.transform(again, lambda x: x["i"]))))
    # each place covers 8 words, or up to the next place
    steps = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(repeats, F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0).cast("long")
    d = d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "lines")
    return stage(d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "described")


def boilerplate(rows: DataFrame, limit_docs: int) -> tuple[DataFrame, DataFrame]:
    """(host, text_hash, line, n: words in all copies) of described rows, and (host, line) of the lines in more than limit_docs documents."""
    lines = rows.select("host", "text_hash", F.inline("lines"))
    found = stage(lines.groupBy("host", "text_hash", "line").agg(F.sum("n").alias("n")), "host-lines")
    # a line's documents are those of its texts; few texts have more than one
    copies = rows.select("host", "text_hash", "doc_id").distinct().groupBy("host", "text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    held_by = found.join(copies, ["host", "text_hash"], "left").groupBy("host", "line").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("held"))
    return found, stage(held_by.filter(F.col("held") > limit_docs).select("host", "line"), "boilerplate")


def judged(rows: DataFrame, found: DataFrame, hot: DataFrame, least_words: int, least_share: float) -> DataFrame:
    """described rows without lines, with n_removed and kept."""
    marked = found.join(hot.withColumn("hot", F.lit(True)), ["host", "line"], "left")
    # copies multiply both sums alike
    lines = marked.groupBy("host", "text_hash").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("hot"), F.col("n")).otherwise(0)).alias("removed")).filter("removed > 0")
    base = rows.drop("lines").join(lines, ["host", "text_hash"], "left").withColumn("n_removed", F.coalesce(F.expr("n_words * removed div total"), F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (left < least_words) | (left < least_share * F.col("n_words"))
    return base.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("total", "removed")


def apply_rules(docs: DataFrame, host_col: str = "source", limit_docs: int = LIMIT_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed (words in lines above the limit) and kept for each row of docs.

    A null host is the host ''; a null text is empty, has no words and fails. Equal rows get equal results. Other columns are not read. No rows give no rows.
    """
    rows = described(docs, host_col)
    return judged(rows, *boilerplate(rows, limit_docs), least_words, least_share).drop("host", "text_hash")


def clean(docs: DataFrame, host_col: str = "source", limit_docs: int = LIMIT_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs that apply_rules keeps, with all their columns, and text without the lines above the limit; texts that have none stay as they are."""
    rows = described(docs, host_col)
    found, hot = boilerplate(rows, limit_docs)
    verdict = judged(rows, found, hot, least_words, least_share).filter("kept").select("host", "text_hash", "doc_id").distinct()
    gone = stage(found.join(hot, ["host", "line"]).groupBy("host", "text_hash").agg(F.collect_set("line").alias("gone")), "gone")
    host, text_hash, lines, h, t, d = free_names(docs, "_host", "_hash", "_gone", "_h", "_t", "_d")
    keyed = docs.withColumns({host: F.coalesce(F.col(host_col), F.lit("")), text_hash: F.xxhash64("text")})
    v = verdict.select(F.col("host").alias(h), F.col("text_hash").alias(t), F.col("doc_id").alias(d))
    kept = keyed.join(v, (keyed[host] == v[h]) & (keyed[text_hash] == v[t]) & keyed["doc_id"].eqNullSafe(v[d]), "left_semi")
    may, stays = held(kept, F.xxhash64(host, text_hash), gone.select(F.xxhash64("host", "text_hash").alias("k")))
    g = gone.select(F.col("host").alias(h), F.col("text_hash").alias(t), F.col("gone").alias(lines))
    met = may.join(g, (may[host] == g[h]) & (may[text_hash] == g[t]), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: (F.size(words(x)) == 0) | ~F.array_contains(F.col(lines), F.xxhash64(normal(x)))), "\n")
    out = met.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(left))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own).unionByName(stays.select(*own))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, base_failed, kept and n_removed of every document, with sources as hosts."""
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, host, line, regexp_replace(lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g') AS norm, len(list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n FROM l),
hot AS (SELECT host, norm FROM n WHERE n > 0 GROUP BY host, norm HAVING count(DISTINCT doc_id) > 20),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n WHERE n > 0 GROUP BY doc_id),
rem AS (SELECT doc_id, sum(n) AS n_removed FROM n JOIN hot ON n.host = hot.host AND n.norm = hot.norm GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 8) x(k) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rem ON d.doc_id = rem.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed AS n_left FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_left < 20 OR n_left < CAST(0.3 AS DOUBLE) * n_words) AS kept, n_removed FROM b
"""
