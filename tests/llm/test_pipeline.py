"""Each stage alone on nulls, repeated rows, empty tables and clashing columns, against brute force."""

import random
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from canopy.llm import decontamination as D
from canopy.llm import quality_classifier as Q
from tests.llm.test_mixing import brute, drawn

NAMES = ("_text", "_source", "_lang", "_topic", "tokens", "weight", "probability", "selected", "score", "quality_score", "text_key", "slot", "leak", "topic")


@pytest.fixture(scope="module")
def odd(spark, rows):
    r = random.Random(41)
    extra = [(2000 + i, " ".join(r.choice(["some", "words", "of", "plain", "prose"]) for _ in range(r.randint(1, 90))), r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), 1, "clash", 7, 9) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, label int, shard int"
    df = spark.createDataFrame([*rows, *extra], schema).repartition(3)
    for c in NAMES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return P.stage(df.withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "law").when(F.col("doc_id") % 3 == 1, "art")), "odd")


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    odd.select("doc_id", (F.length("text") > 200).cast("int").alias("quality")).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, odd.filter("doc_id = 2000").first()["text"] + " and then an answer"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_columns_and_empty_tables(spark, odd, folder, name):
    f = dict(P.STAGES)[name]
    out = f(spark, odd, folder)
    if name == "sharding":
        assert sorted(out.columns) == sorted(odd.columns) and bag(out.drop("shard", "slot")) == bag(odd.drop("shard", "slot"))
    else:
        assert out.columns == odd.columns and not bag(out) - bag(odd)
    assert f(spark, odd.limit(0), folder).count() == 0


def test_quality_keeps_what_its_model_scores_half_or_more(spark, odd, folder):
    model = Q.fit(odd, spark.read.parquet(f"{folder}/labels.parquet"))
    v = model.vocabulary()
    text = odd.columns.index("text")
    want = Counter({r: n for r, n in bag(odd).items() if Q.forward(model, Q.pool(r[text], v, model.vectors, model.weight)[None])[0] >= 0.5})
    assert bag(P.quality(spark, odd, folder)) == want and 0 < sum(want.values()) < odd.count()


def test_decontamination_drops_texts_that_hold_an_item(spark, odd, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r[0] is not None and r[1]]
    index = D.build(items)
    text = odd.columns.index("text")
    want = Counter({r: n for r, n in bag(odd).items() if not D.search(index, D.normal(r[text]), D.THRESHOLD, D.OVERLAP)})
    assert bag(P.decontamination(spark, odd, folder)) == want


def test_mixture_draws_by_its_cells(spark, odd, folder):
    rows = [r.asDict() for r in odd.collect()]
    told = [(r["doc_id"], r["source"], r["lang"], r["topic"], len((r["text"] or "").encode().split())) for r in rows]
    goals = []
    for d in (1, 2, 3):
        seen = {}
        for t in told:
            seen[t[d]] = seen.get(t[d], 0) + t[4]
        root = {k: n**0.5 for k, n in seen.items()}
        goals.append({k: x / sum(root.values()) for k, x in root.items()})
    _, p = brute(told, goals, P.MIX_BUDGET)
    want = Counter(t[0] for t in told if drawn(11, t, p[t[1:4]]))
    assert Counter(r["doc_id"] for r in P.mixture(spark, odd, folder).collect()) == want and 0 < sum(want.values()) < len(told)
    # without a topic of its own the documents' topics are fitted
    assert not bag(P.mixture(spark, odd.drop("topic"), folder)) - bag(odd.drop("topic"))
