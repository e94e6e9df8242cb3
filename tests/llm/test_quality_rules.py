"""Counts and verdicts against brute force, hosts of one line, cleaned texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopy.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(x):
    return re.sub(r"[0-9]+", "0", x.strip(" \t\n\x0b\x0c\r").lower())


def brute(rows, limit):
    held = {}
    for i, t, h in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                held.setdefault((h or "", norm(x)), set()).add((i, t))
    hot = {k for k, v in held.items() if len(v) > limit}
    out = []
    for i, t, h in rows:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        removed = sum(len(WORD.findall(x)) for x in lines if (h or "", norm(x)) in hot)
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        kept = not failed and not (len(w) - removed < Q.LEAST_WORDS or len(w) - removed < Q.LEAST_SHARE * len(w))
        cleaned = "\n".join(x for x in (t or "").split("\n") if not WORD.search(x) or (h or "", norm(x)) not in hot)
        out.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover), failed, kept, removed, cleaned if t is not None else None))
    return out


@pytest.fixture(scope="module")
def told():
    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choice("abcdeé#1<") for _ in range(r.randint(1, 7))) for _ in range(n))
    boiler, page = say(40), "Page {} of the same host"
    rows = []
    for i in range(240):  # two thirds on one host
        h = r.choice(["hot", "hot", "cold", None])
        lines = [say(r.randint(1, 50)) for _ in range(r.randint(0, 4))] + r.choice([[], [boiler], [f"  {boiler.upper()}\t"], [page.format(i)], [boiler, boiler]])
        r.shuffle(lines)
        rows.append((r.choice([i, i, None]), "\n".join(lines) + r.choice(["", "\n", " again and again and" * 9]), h))
    return [*rows, rows[5], rows[5], (900, None, "hot"), (901, "", "hot"), (902, "word " * 20_000, None)] + [(2000 + i, f"{boiler}\n{say(3)}", "small") for i in range(8)] + [(3000 + i, rows[7][1], "hot") for i in range(15)]


def test_against_brute_force(spark, told):
    docs = spark.createDataFrame(told, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("host", "text_hash", "_hash", "_gone", "kept", "lines")}).repartition(3)
    want = brute(told, 10)
    out = Q.apply_rules(docs, limit_docs=10)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")
    assert Counter(tuple(r[c] for c in names) for r in out.collect()) == Counter(x[:9] for x in want) and any(x[8] for x in want)
    cleaned = Q.clean(docs, limit_docs=10)
    assert cleaned.columns == docs.columns and {r["_gone"] for r in cleaned.collect()} == {"own"}
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == Counter((x[0], x[9]) for x in want if x[7])
    assert Q.clean(docs.limit(0)).count() == 0
