"""Targets, the draw against brute force, topics, clashing columns."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canopy.llm import mixing as M

SCHEMA = "doc_id long, source string, lang string, topic string, tokens long"


@pytest.fixture(scope="module")
def told():
    r = random.Random(17)
    return [(r.choice([i, i, None]), r.choice(["a", "b", "c", None]), r.choice(["x", "y"]), r.choice(["0", "1", "2"]), r.choice([0, r.randint(1, 400)])) for i in range(900)]


def drawn(seed, row, p):
    """xxhash64 of the values in turn, nulls left out, as an unsigned number's upper 53 bits."""
    h = xxhash.xxh64(seed.to_bytes(4, "little"), seed=42).intdigest()
    for v in (row[0], row[1], row[2], row[4]):
        if v is not None:
            h = xxhash.xxh64(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), seed=h).intdigest()
    return (h >> 11) / (1 << 53) < p


def brute(rows, goals, budget, rounds=2000):
    """Raked cell weights and probabilities by plain dictionaries."""
    cells = {}
    for _, *key, n in rows:
        cells[tuple(key)] = cells.get(tuple(key), 0) + n
    total = sum(cells.values())
    fitted = {k: v / total for k, v in cells.items()}
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            sums = {}
            for k, v in fitted.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            fitted = {k: v * goal.get(k[d], 0) / sums[k[d]] if sums[k[d]] else 0.0 for k, v in fitted.items()}
    weight = {k: fitted[k] * total / cells[k] if cells[k] else 0.0 for k in cells}
    low, high = 0.0, 1e9
    for _ in range(300):
        f = (low + high) / 2
        low, high = (f, high) if sum(cells[k] * min(1, f * weight[k]) for k in cells) < budget * total else (low, f)
    return weight, {k: min(1.0, high * w) for k, w in weight.items()}


@pytest.mark.parametrize("max_cells", [100, 3])
def test_targets_and_draw_against_brute_force(spark, told, max_cells):
    docs = spark.createDataFrame(told, SCHEMA).repartition(3)
    targets = {"source": {"a": 0.5, None: 0.1, "absent": 0.2}, "lang": {"x": 0.3, "y": 0.7}}
    out = M.mix(docs, targets, budget_share=0.4, seed=5, max_cells=max_cells).collect()
    seen = [{}, {}, {}]
    for _, *key, n in told:
        for d in range(3):
            seen[d][key[d]] = seen[d].get(key[d], 0) + n
    root = {v: seen[0][v] ** 0.5 for v in "bc"}
    topics = {v: n**0.5 for v, n in seen[2].items()}
    goals = [{"a": 0.5, None: 0.1} | {v: 0.4 * x / sum(root.values()) for v, x in root.items()}, {"x": 0.3, "y": 0.7}, {v: x / sum(topics.values()) for v, x in topics.items()}]
    weight, p = brute(told, goals, 0.4)
    assert len(out) == len(told)
    for r in out:
        key = (r["source"], r["lang"], r["topic"])
        assert abs(r["weight"] - weight[key]) < 1e-6 * max(1, weight[key]) and abs(r["probability"] - p[key]) < 1e-6
        assert r["selected"] == drawn(5, (r["doc_id"], *key, r["tokens"]), r["probability"])
    assert 0 < sum(r["selected"] for r in out) < len(out)


def test_targets_that_cannot_be(spark, told):
    docs = spark.createDataFrame(told, SCHEMA)
    for bad in ({"author": {"a": 1.0}}, {"lang": {"x": -0.1}}, {"lang": {"x": 0.7, "y": 0.7}}):
        with pytest.raises(ValueError):
            M.mix(docs, bad)
    only = M.mix(docs, {"lang": {"x": 1.0}}).filter("lang = 'y'").agg(F.max("probability")).first()[0]
    assert only == 0


def test_topics_are_the_nearest_centroids_of_all_documents(spark):
    r = random.Random(9)
    vocab = ["alpha bravo charlie delta", "sugar butter flour vanilla", "galaxy planet comet nebula", "violin cello trumpet drums"]
    rows = [(i, " ".join(r.choice(vocab[i % 4].split()) for _ in range(40))) for i in range(200)] + [(900, None), (901, ""), (902, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x for x in M.describe(docs, k=4).collect()}
    again = {x["doc_id"]: x["topic"] for x in M.describe(docs.repartition(7), k=4).collect()}
    assert {k: v["topic"] for k, v in out.items()} == again
    by = [{out[i]["topic"] for i in range(k, 200, 4)} for k in range(4)]
    assert all(len(x) == 1 for x in by) and len(set.union(*by)) == 4
    assert all(out[i]["topic"] == 0 for i in (900, 901, 902)) and out[902]["tokens"] == 3 and out[900]["tokens"] == out[901]["tokens"] == 0
    # brute force of the assignment
    table = M.stage(M.vectors(docs, ["doc_id"]), "t")
    c = M.fit_topics(table, k=4)
    for x in table.collect():
        v = np.frombuffer(x["vector"], dtype="<i2").astype(int)
        scores = [int(sum(int(a) * int(b) for a, b in zip(v, row, strict=True))) for row in c]
        assert out[x["doc_id"]]["topic"] == scores.index(max(scores))


def test_tokens_are_the_contracts_words_and_columns_stay(spark, docs, rows, none):
    out = M.describe(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "topic", "tokens"])
    assert sorted((repr(x["doc_id"]), x["tokens"]) for x in out.collect()) == sorted((repr(x[0]), len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))) for x in rows)
    odd = out.withColumns({c: F.lit(f"own {c}") for c in ("_source", "_lang", "_topic", "_text", "weight")})
    mixed = M.mix(odd, names=("w", "p", "take"))
    assert sorted(mixed.columns) == sorted([*odd.columns, "w", "p", "take"])
    got = mixed.collect()
    assert len(got) == len(rows) and all(x[c] == f"own {c}" for x in got for c in ("_source", "_lang", "_topic", "_text", "weight"))
    assert M.mix(odd).columns.count("weight") == 1
    assert M.mix(M.describe(none)).count() == 0
    assert M.vectors(spark.createDataFrame([(1, "nb sp one two\x1cthree")], "doc_id long, text string"), []).first()["tokens"] == 2


def test_long_texts_are_read_in_pieces():
    r = random.Random(1)
    long = "".join(r.choice(["word", "größer", "x" * 40, " ", "\n", "\t ", "\xa0"]) for _ in range(700_000))
    want = re.findall(rb"[^\x20\x09-\x0D]+", long.encode())
    assert len(long) > 3 * M.PIECE and [w for piece in M.read_words(long.encode()) for w in piece] == want and M.measure(long.encode(), M.Places())[0] == len(want)
    assert list(M.read_words(b"")) == []


def test_large_ids_beside_null_ones_stay_exact(spark):
    ids = [(1 << 60) + 1, None, -(1 << 62) - 3, (1 << 53) + 1]
    docs = spark.createDataFrame([(i, "some longer words here", "s", "en") for i in ids], "doc_id long, text string, source string, lang string").coalesce(1)
    assert sorted((r["doc_id"] for r in M.describe(docs).collect()), key=repr) == sorted(ids, key=repr)
