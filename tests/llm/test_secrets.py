"""The ledger across runs, and spans against Python's re."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from canopy.llm import secrets

PATTERNS = [(re.compile(p, re.A), g, n) for _, p, g, n in secrets.RULES]


def spans(text):
    out = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= n]
    return sorted(out)


def got(rows, path="path"):
    return sorted((repr(r[path]), tuple((s["start"], s["kind"], s["end"]) for s in r["spans"] or ())) for r in rows)


@pytest.fixture(scope="module")
def versions(rows):
    r = random.Random(14)
    bits = ["password = hunter22x", "AKIA" + "Z9" * 8, "0f" * 20, "token:short", "Secret=token:abcdefghij", "é😀 API_KEY='Aa0/+_.=-9'", "plain words", "\n", "AKIA", "deadbeef"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(60)]
    return [(x[0], x[1]) for x in rows] + [(1000 + i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[3]), (1000, texts[0]), (2000, texts[0])]


def test_findings_and_ledger_over_runs(spark, versions, none, tmp_path):
    df = spark.createDataFrame(versions, "doc_id long, text string").repartition(3)
    want = sorted((repr(i), tuple(spans(t))) for i, t in versions)
    at = f"file://{tmp_path}/ledger"
    assert got(secrets.scan_history(df, at, path_col="doc_id").collect()) == want and any(w[1] for w in want)
    known = sorted(r["blob"] for r in secrets.read_ledger(spark, at).collect())
    assert known == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, t in versions})
    # the same run again adds nothing and finds the same
    assert got(secrets.scan_history(df, at, path_col="doc_id").collect()) == want
    assert sorted(r["blob"] for r in secrets.read_ledger(spark, at).collect()) == known
    # new versions beside known ones
    more = spark.createDataFrame([*versions, (5000, "passwd: zzzzzzzzz"), (5001, "passwd: zzzzzzzzz"), (5002, "clean")], "doc_id long, text string")
    out = dict(got(secrets.scan_history(more, at, path_col="doc_id").collect()))
    assert out["5000"] == out["5001"] == ((0, 0, 17),) and out["5002"] == ()
    assert secrets.read_ledger(spark, at).count() == len(known) + 2
    # other rules have a ledger of their own
    other = secrets.scan_history(df, at, path_col="doc_id", rules=secrets.RULES[:1], rule_version="assign-only").collect()
    assert got(other) == sorted((repr(i), tuple(s for s in spans(t) if s[1] == 0)) for i, t in versions)
    assert secrets.scan_history(none, f"{at}2", path_col="doc_id").count() == 0


def test_a_run_that_failed_half_way_loses_nothing(spark, versions, tmp_path):
    df = spark.createDataFrame(versions, "doc_id long, text string")
    at = f"file://{tmp_path}/ledger"
    secrets.scan_history(df.limit(30), at, path_col="doc_id")
    # what a job leaves that ends before its commit marker
    for f in (tmp_path / "ledger").rglob("_SUCCESS"):
        f.unlink()
    assert got(secrets.scan_history(df, at, path_col="doc_id").collect()) == sorted((repr(i), tuple(spans(t))) for i, t in versions)


def test_spans_that_consume_each_other_and_many(spark):
    many = "".join(f"token={i:08d}x é " for i in range(2000))
    for text in ("secret=token:abcdefghij", "token=abc password='x y' api_key: Zz0/+_.=-9", "é😀 TOKEN=12345678", "passwd:=abcdefgh", many):
        found = spark.createDataFrame([(text,)], "t string").select(secrets.find_spans(F.col("t"))).first()[0]
        assert [(s["start"], s["kind"], s["end"]) for s in found] == spans(text)


def test_query_counts_and_digest(spark, versions, tmp_path):
    spark.createDataFrame(versions, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted((repr(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secrets.op5_secrets(spark, str(tmp_path)).collect())
    want = []
    for i, t in versions:
        found = spans(t)
        said = ",".join(f"{secrets.RULES[k][0]}:{a}:{b}" for a, k, b in found)
        n = [sum(k == x for _, k, _ in found) for x in range(3)]
        want.append((repr(i), *n, hashlib.sha256(said.encode()).hexdigest(), said))
    assert out == sorted(want)
