"""Ids beyond 2^53 stay exact beside null ones in one batch."""

from pyspark.sql import functions as F

from canopy.llm import decontamination as D
from canopy.llm import html_extraction as H
from canopy.llm import jaccard_join as J
from canopy.llm import quality_classifier as Q

IDS = [(1 << 60) + 1, None, -(1 << 62) - 3, (1 << 53) + 1]
TEXT = "question: " + " ".join(f"word{i}" for i in range(40)) + " answer: " + " ".join(f"reply{i}" for i in range(20))


def same(found):
    return sorted(found, key=repr) == sorted(IDS, key=repr)


def docs_of(spark):
    return spark.createDataFrame([(i, TEXT) for i in IDS], "doc_id long, text string").coalesce(1)


def test_scores(spark):
    model = Q.train(["good words of prose here. " * 3, "BAD!! BAD!! $$$ ###"] * 20, [1, 0] * 20)
    assert same(r["doc_id"] for r in Q.score(docs_of(spark), model).collect())


def test_pages(spark):
    pages = docs_of(spark).select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("html"))
    out = H.extract(pages).collect()
    assert same(r["page_id"] for r in out) and all(r["text"] == "" and r["n_chars"] == 0 for r in out)


def test_leaks(spark):
    bench = spark.createDataFrame([(5, TEXT)], "item_id long, text string")
    assert same(r["doc_id"] for r in D.find_leaks(docs_of(spark), bench).collect())


def test_links(spark):
    out = J.link(docs_of(spark)).collect()
    assert same(r["doc_id"] for r in out)
    assert all(r["class_id"] == -(1 << 62) - 3 and r["n_links"] == 3 for r in out) and sum(r["first"] for r in out) == 1
