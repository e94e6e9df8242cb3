"""Lines that many documents share, found in runs of range-partitioned hashes; the answer is a bitmap for each document.

Only hashes travel: a row for each long line (128 hash bits, document, position). They are range partitioned by hash and
sorted by hash, document (largest first) and position, so a line's occurrences are one run, whose first row is the line's
largest document; a pass over the sorted rows takes it and the number of documents, without another exchange. The
ranges come from an exact count of FINE equal parts of the hash space: a part with more rows than a range should
have, as a line of a third of all documents makes it, is dealt on to several ranges by document, and only such parts'
runs, a row each, meet once more to be summed. Decisions go back to documents as a run-length coded bitmap of lines; texts
move only where a document has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import free_names, held, stage, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Parts of the hash space whose rows are counted, as bits.
FINE_BITS = 16


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line with a long key: doc_id, text_hash, pos, h1, h2, first (0 if an earlier line of the row has the key)."""
    long = F.filter(F.transform(lines(F.col("text")), lambda x, i: F.struct(x.alias("line"), i.alias("pos"))), lambda x: F.length(x.line) >= min_chars)
    keyed = F.filter(F.transform(long, lambda x: F.struct(line_key(x.line).alias("key"), x.pos.alias("pos"))), lambda x: F.length(x.key) >= min_chars)
    hashed = F.array_sort(F.transform(keyed, lambda x: F.struct(F.xxhash64(x.key).alias("h1"), F.xxhash64(F.lit(1), x.key).alias("h2"), x.pos.alias("pos"))))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed.alias("x"))
    flagged = F.transform("x", lambda x, i: F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.pos.alias("pos"), F.when((i > 0) & (F.get("x", i - 1).h1 == x.h1) & (F.get("x", i - 1).h2 == x.h2), 0).otherwise(1).alias("first")))
    return rows.select("doc_id", "text_hash", F.inline(flagged))


def runs(rows: DataFrame, *cuts: str) -> DataFrame:
    """rows with keeper (largest doc_id) and n (documents) of their run of one hash within a range; top marks a run's first row."""
    run = Window.partitionBy(*cuts, "h1", "h2")
    ordered = run.orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    # the ranges are the windows' distribution, so each range is sorted once and read in order
    ranged = rows.repartitionByRange(*cuts)
    return ranged.withColumns({"top": F.row_number().over(ordered) == 1, "keeper": F.first("doc_id").over(ordered), "n": F.sum("first").over(run)})


def dropped_lines(found: DataFrame, min_docs: int, per_range: int | None = None) -> DataFrame:
    """doc_id, text_hash, pos of the lines that go, of occurrences in a written table. per_range: rows a range should have, by default an even share."""
    spark = found.sparkSession
    counts = {r["fine"]: r["count"] for r in found.groupBy("fine").count().collect()}  # FINE rows at most
    per = per_range or max(1, -(-sum(counts.values()) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = [(k, -(-n // per)) for k, n in counts.items() if n > per]
    lost = lambda rows, keeper, n: rows.filter((F.col(n) >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col(keeper))).select("doc_id", "text_hash", "pos")
    if not cuts:
        return lost(runs(found, "fine"), "keeper", "n")
    table_of = F.broadcast(spark.createDataFrame(cuts, "fine int, parts int"))  # FINE rows at most
    plain = lost(runs(found.join(table_of, "fine", "left_anti"), "fine"), "keeper", "n")
    wide = found.join(table_of, "fine").withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.col("parts")).cast("int"))
    split = stage(runs(wide, "fine", "sub"), "split-runs")
    both = Window.partitionBy("h1", "h2")
    whole = split.filter("top").select("fine", "sub", "h1", "h2", F.max("keeper").over(both).alias("last"), F.sum("n").over(both).alias("docs"))
    return plain.unionByName(lost(split.join(whole, ["fine", "sub", "h1", "h2"]), "last", "docs"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, per_range: int | None = None) -> DataFrame:
    """For each document that loses lines: doc_id, text_hash, n_dropped, runs (of dropped lines, ascending: start, n).

    A row is a document; with ids that repeat, the largest id keeps its lines in each of its rows. A null id is smaller
    than all others. A null or empty text is one empty line. Equal rows share one bitmap. Other columns are not read. No rows give no rows.
    """
    found = stage(occurrences(docs, min_chars).withColumn("fine", F.shiftrightunsigned("h1", 64 - FINE_BITS).cast("int")), "line-hashes")
    at = dropped_lines(found, min_docs, per_range).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    return at.select("doc_id", "text_hash", F.size("at").cast("long").alias("n_dropped"), F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("n"))).alias("runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with `text` reduced to its kept lines, joined by \\n, and n_lines (before), n_dropped, which replace columns of these names. Rows without a bitmap stay as and where they are."""
    bitmaps = stage(bitmaps, "bitmaps")
    docs = docs.drop("n_lines", "n_dropped")
    key = lambda row: F.xxhash64(row, F.col("doc_id"), F.col("doc_id").isNull())
    may, stays = held(docs, key(F.xxhash64("text")), bitmaps.select(key(F.col("text_hash")).alias("k")))
    own, i, text, gone, cut, every = free_names(docs, "_hash", "_id", "_text", "_gone", "_runs", "_lines")
    b = bitmaps.select(F.col("doc_id").alias(i), F.col("text_hash").alias(text), F.col("n_dropped").alias(gone), F.col("runs").alias(cut))
    hashed = may.withColumn(own, F.xxhash64("text"))
    joined = hashed.join(b, hashed["doc_id"].eqNullSafe(b[i]) & (F.col(own) == F.col(text)), "left").withColumn(every, lines(F.col("text")))
    ends = F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r.start + r.n))
    starts = F.concat(F.transform(cut, lambda r: r.start), F.array(F.size(every)))
    kept = F.array_join(F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(F.col(every), e + 1, s - e))), "\n")
    zero = F.lit(0).cast("long")
    out = joined.withColumns({"n_lines": F.size(every).cast("long"), "n_dropped": F.coalesce(gone, zero), "text": F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)}).drop(own, i, text, gone, cut, every)
    return out.unionByName(stays.withColumns({"n_lines": F.size(lines(F.col("text"))).cast("long"), "n_dropped": zero}))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, s[i] AS line,
         translate(regexp_replace(s[i], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), c AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.key = c.key GROUP BY doc_id
"""
