"""Rows that each operator must take: nulls, empty and very long texts, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, label int, shard int"


def say(r, n):
    return " ".join("".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    line = "a line that many documents share, long enough to count " + "x" * 9
    base = say(r, 120)
    texts = [None, "", "  \n\t ", "one", line, "long " * 30_000 + "end", base, base, base + " tail", base.replace("a", "o", 1), "password = hunter22x AKIA" + "A" * 16 + " " + "0f" * 20]
    texts += [f"{say(r, 40)}\n{line}\n{say(r, 30)}" for _ in range(12)] + [say(r, r.randint(1, 200)) for _ in range(40)]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(t or ""), "clash", 7, 9) for i, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
