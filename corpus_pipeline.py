"""Documents to training shards: quality, near duplicates, contamination, mixture, shuffle.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import free_name, free_names, held, stage, table
from canopy.llm.decontamination import find_leaks
from canopy.llm.jaccard_join import link
from canopy.llm.mixing import fit_topics, mix, vectors, with_topic
from canopy.llm.quality_classifier import fit, score
from canopy.llm.sharding import shard

#: The share of tokens that the mixture draws; a cell's documents are drawn by its probability.
MIX_BUDGET = 0.8


def own(docs: DataFrame) -> list[Column]:
    """docs' columns, whatever they are called."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of one half or more). Null and empty texts score as documents without words; no rows give no rows."""
    name = free_name(docs, "quality_score")
    model = fit(docs, table(spark, sf_dir, "labels"))
    # the texts go to Python and back, instead of being dealt anew to meet their scores
    kept = score(docs, model, keep=docs.columns, name=name).filter(F.col(name) >= 0.5)
    return kept.select(*own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (linked, however far) one row, with the least id, a null one last, and then the least text hash; all others."""
    grouped = link(docs).filter("n_links > 0").groupBy("doc_id", "text_key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    touched = stage(grouped.filter("not first or n > 1"), "touched")
    same = lambda rows, keys: rows["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(rows["text"]) == keys["text_key"])
    may, stays = held(docs, F.xxhash64("text"), touched.select("text_key"))
    out = stays.unionByName(may.join(touched, same(may, touched), "left_anti"))
    equal = touched.filter("first")
    if equal.isEmpty():
        return out
    # one of the rows with one id and text
    rows, _ = held(docs, F.xxhash64("text"), equal.select("text_key"))
    return out.unionByName(rows.join(equal, same(rows, equal), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Only the text decides, so its hash, never null, stands for the document.

    Null and empty texts hold no item and stay; repeated rows stay or go together; no rows give no rows.
    """
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = stage(find_leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("text_key")).distinct(), "leaks")
    return docs.join(leaks, F.xxhash64(docs["text"]) == leaks["text_key"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture draws, over source, language and topic: docs' own column topic, if there is one, and else a fitted one.

    Null and empty texts are drawn by the probability of their cell, repeated rows together; columns of any name stay as they are; no rows give no rows.
    The draw needs no texts: only texts that may be among the dropped ones move.
    """
    same = ["doc_id", "source", "lang"] + (["topic"] if "topic" in docs.columns else [])
    text_key, = free_names(docs, "text_key")
    rows = stage(vectors(docs.withColumn(text_key, F.xxhash64("text")), [*same, text_key]), "vectors")
    narrow = rows.drop("vector") if "topic" in same else with_topic(rows, fit_topics(rows))
    left = stage(mix(narrow, budget_share=MIX_BUDGET).filter("not selected").select(*same, text_key).distinct(), "left")
    key = lambda text: F.xxhash64(text, *[x for c in same for x in (F.col(c), F.col(c).isNull())])
    may, stays = held(docs, key(F.xxhash64("text")), left.select(key(F.col(text_key)).alias("k")))
    on = F.xxhash64(may["text"]) == left[text_key]
    for c in same:
        on = on & may[c].eqNullSafe(left[c])
    return stays.unionByName(may.join(left, on, "left_anti")).select(*own(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shard and slot, which replace columns of these names."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: SQL cannot say what the classifier, the candidate search and the draws decide; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
