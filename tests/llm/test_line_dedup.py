"""Line dedup against brute force: ranges that are split, clashing columns, texts that stay in place."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopy.llm import line_dedup


def key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_docs=5):
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(float("-inf") if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= min_docs}
    out = Counter()
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if gone.get(key(x), i) == i or (i is None and gone.get(key(x)) == float("-inf"))]
        out[(i, "\n".join(kept), len(every), len(every) - len(kept))] += 1
    return out


@pytest.fixture(scope="module")
def shared_rows():
    r = random.Random(2)
    lines = [f"{k} " + "".join(r.choice("abcdefgh ") for _ in range(60)) + "x" for k in range(12)]
    rows = []
    for i in range(160):
        text = [r.choice([lines[0], f"  {lines[0].upper()}\t", *lines, "short", ""]) for _ in range(r.randint(0, 9))]
        rows.append((r.choice([i, i, i, None]), "\n".join(text)))
    return [*rows, (7, None), (7, None), rows[3], rows[3], (9999, "\n".join([lines[0]] * 40))]


@pytest.mark.parametrize("per_range", [None, 40, 3])
def test_split_ranges_answer_alike(spark, shared_rows, per_range):
    docs = spark.createDataFrame(shared_rows, "doc_id long, text string").repartition(4)
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, per_range=per_range)).collect()
    want = brute(shared_rows)
    assert Counter((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in found) == want and any(k[3] for k in want)


def test_columns_of_all_names_stay(spark, shared_rows):
    names = ("_id", "_hash", "_text", "_gone", "_lines", "_runs", "_at", "_k", "fine", "h1", "n", "n_lines")
    docs = spark.createDataFrame(shared_rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert sorted(out.columns) == sorted({*docs.columns, "n_dropped"})
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in names if c != "n_lines")
    assert Counter((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in rows) == brute(shared_rows)
