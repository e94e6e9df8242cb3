"""Secrets in every version of every document, by an incremental ledger of content-addressed blobs.

Each version's text is a blob, named by its SHA-256. The ledger holds what was found for each (blob, rule version)
pair, in a folder for each rule version. A run reads which blobs the ledger has, scans one copy of each unseen blob, appends
what it found, and joins findings back to all paths. What a run appends is never replaced: a row of the ledger follows from
blob and rules alone, so a run that is repeated, or that follows one which failed half way, adds only what is missing.

Texts are scanned where they lie. Only those that may be copies of others or in the ledger already, by a bounded filter of
keys, are dealt by (blob, path) to learn which copy is scanned; of these only the ones that are scanned travel. The join
back carries narrow rows, and those without findings carry none.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import held, once, stage, table, work_path

RULE_VERSION = "base-1"
# fixed values: the kinds in their order, pattern, group whose length counts, least length
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs under 32 never count, and a run has one match, so the short ones need not be listed
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER_SCHEMA = f"blob string, spans {SPANS}"
#: Matches whose places are summed at a time.
RUN = 256


def find_spans(text: Column, rules: list[tuple[str, str, int, int]] = RULES) -> Column:
    """Ascending array of (start, kind's place, end) in code points: leftmost non-overlapping matches of each kind, then those long enough.

    A pattern's matches alternate with the pieces that splitting by it leaves, which gives each match its place. Lengths are summed
    in runs of RUN matches and the runs' totals apart, so a text with very many matches costs little more for each.
    """
    found, none = [], F.array().cast(SPANS)
    for kind, (_, pattern, group, least) in enumerate(rules):
        p = F.lit(pattern)
        pieces, matches, counted = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
        steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.arrays_zip(matches.alias("m"), counted.alias("c")), lambda a, x: F.struct(F.length(a).alias("gap"), F.length(x.m).alias("n"), F.length(x.c).alias("c")))

        def placed(steps: Column, kind: int = kind, least: int = least) -> Column:
            """(at: total length, spans: relative to the start) of one run."""
            return F.aggregate(
                steps,
                F.struct(F.lit(0).alias("at"), none.alias("spans")),
                lambda acc, x: F.struct(
                    (acc["at"] + x["gap"] + x["n"]).alias("at"),
                    F.when(x["c"] >= least, F.array_append(acc["spans"], F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("end")))).otherwise(acc["spans"]).alias("spans"),
                ),
            )

        # each array is computed once: a lambda's argument stands for its value
        def shifted(steps: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: placed(F.slice(steps, i * RUN + 1, RUN)))
            return once(runs, moved)

        def moved(runs: Column) -> Column:
            starts = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["at"]))
            return F.flatten(F.zip_with(runs, F.slice(starts, 1, F.size(runs)), lambda r, at: F.transform(r["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))))

        found.append(F.when(text.rlike(pattern), once(steps, shifted)).otherwise(none))
    return F.array_sort(F.concat(*found))


def read_ledger(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """blob, spans of what is known for a rule version; empty where nothing is yet. Two runs at once may both have added a blob, with equal spans."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/rules={rule_version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def unseen_texts(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """blob, text: one row for each blob of blobs(blob, path, text) that is not known, a copy of the least path (null before all)."""
    spark = blobs.sparkSession
    counts = stage(blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct(F.col("path").isNotNull(), "path")).alias("path")), "blobs")
    seen = known.select("blob", F.lit(True).alias("seen")).distinct()
    # blobs whose rows can't all be scanned as they come: known ones, and those with copies
    special = stage(counts.join(seen, "blob", "left").filter("n > 1 or seen"), "special")
    if special.isEmpty():
        return blobs.select("blob", "text")
    may, plain = held(blobs, F.xxhash64("blob"), special.select(F.xxhash64("blob").alias("k")))
    # of those, the copies to be scanned: unseen blobs that the filter caught, whether special or not
    key = lambda: F.xxhash64("blob", "path", F.col("path").isNull())
    caught, _ = held(counts, F.xxhash64("blob"), special.select(F.xxhash64("blob").alias("k")))
    chosen = stage(caught.join(seen, "blob", "left_anti").select("blob", "path"), "chosen")
    if chosen.isEmpty():
        return plain.select("blob", "text")
    near, _ = held(may, key(), chosen.select(key().alias("k")))
    same = (near["blob"] == chosen["blob"]) & near["path"].eqNullSafe(chosen["path"])
    copies = near.join(chosen, same, "left_semi").select("blob", "text").dropDuplicates(["blob"])
    return plain.select("blob", "text").unionByName(copies)


def scan_history(versions: DataFrame, ledger_path: str, path_col: str = "path", text_col: str = "text", rules: list[tuple[str, str, int, int]] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, blob, spans (null: none) for each row of versions; the ledger at ledger_path gets what was unseen, in a new folder.

    A null text is an empty blob. Null and repeated paths are rows like others. A run on rows that the ledger knows, again or after a
    failure, scans and adds nothing and returns the same. Other columns are not read. No rows give no rows.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    fresh = unseen_texts(blobs, read_ledger(spark, ledger_path, rule_version)).select("blob", find_spans(F.col("text"), rules).alias("spans"))
    fresh.write.parquet(f"{ledger_path}/rules={rule_version}/run={uuid.uuid4().hex}")
    found = read_ledger(spark, ledger_path, rule_version).filter(F.size("spans") > 0).dropDuplicates(["blob"])
    ids = blobs.select("path", "blob")
    return ids.join(found, "blob", "left").select("path", "blob", "spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and all spans of every document, by a ledger of this run's own."""
    found = scan_history(table(spark, sf_dir, "documents"), work_path(spark, "ledger"), path_col="doc_id")
    names = F.array(*[F.lit(r[0]) for r in RULES])
    spans = F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    out = found.select(F.col("path").alias("doc_id"), *[F.when(F.col("spans").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{r[0]}") for k, r in enumerate(RULES)], spans.alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, 1 AS kind, 'assign' AS name, 8 AS least, string_split_regex(t, '{_ASSIGN}') AS p, regexp_extract_all(t, '{_ASSIGN}') AS m, regexp_extract_all(t, '{_ASSIGN}', 2) AS c FROM d
  UNION ALL SELECT doc_id, 2, 'access', 16, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 3, 'hex', 32, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
),
u AS (SELECT doc_id, kind, name, least, i, length(p[i]) AS gap, length(m[i]) AS n, length(c[i]) AS counted FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
e AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
s AS (SELECT doc_id, kind, name, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e WHERE counted >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 1) AS a, count(*) FILTER (kind = 2) AS b, count(*) FILTER (kind = 3) AS h, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
