"""Held-out accuracy and calibration on the driver's tables; what training takes; clashing columns."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from canopy.llm import quality_classifier as Q

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in Q.op1_quality_classifier(spark, SF).collect()}


def test_held_out_rows_are_scored_right(spark, scored):
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    out = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 100 and all(scored[i]["held_out"] for i, _ in out)
    assert sum(scored[i]["predicted"] == y for i, y in out) / len(out) > 0.97
    loss = [-math.log(max(1e-6, scored[i]["score"] if y else 1 - scored[i]["score"])) for i, y in out]
    assert sum(loss) / len(loss) < 0.1
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lies = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.fit(docs, x, max_labelled=120) for x in (labels, lies))
    assert a.words == b.words and a.temperature == b.temperature and (a.layers[0] == b.layers[0]).all()


def test_what_training_takes(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"word{i} and more") for i in ids] + [(ids[0], "another text of one id"), (ids[1], None), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 2 + [(None, 1), (ids[2], None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real, Q.train = Q.train, lambda texts, y, **k: seen.append((texts, k)) or real(texts, y, **k)
    try:
        for d in (docs, docs.repartition(5)):
            Q.fit(d, labels, max_labelled=50, max_words=7)
        Q.fit(docs, labels, max_chars=100)
    finally:
        Q.train = real
    (a, k), (b, _), (c, _) = seen
    assert a == b and len(a) == len(set(a)) == 50 and k["max_words"] == 7 and 0 < sum(map(len, c)) <= 100


def test_pooling_in_pieces_and_clashing_columns(spark, docs):
    model = Q.train(["good words of prose here. " * 3, "BAD!! BAD!! $$$ ###"] * 20, [1, 0] * 20)
    v = model.vocabulary()
    long = "good words, BAD!! " * 40_000
    assert abs(Q.pool(long, v, model.vectors, model.weight)[:-1] - Q.pool("good words, BAD!! " * 400, v, model.vectors, model.weight)[:-1]).max() < 1e-3
    odd = docs.withColumns({"_text": F.lit("mine"), "score": F.lit("theirs")})
    out = Q.score(odd, model, keep=odd.columns, name="s").collect()
    assert len(out) == odd.count() and all(r["_text"] == "mine" and r["score"] == "theirs" and 0 <= r["s"] <= 1 for r in out)
