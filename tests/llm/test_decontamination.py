"""The document search against scoring every item in every passage."""

import math
import random

from canopy.llm import decontamination as D


def say(r, n):
    return [r.choice(WORDS) for _ in range(n)]


WORDS = [f"w{k}" for k in range(900)]


def brute(items, text):
    """(item, score, overlaps, first word) for every item, by BM25 over all passages of its class of lengths."""
    bags = {i: D.normal(t) for i, t in items if D.normal(t)}
    df = {}
    for w in bags.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    mean = sum(map(len, bags.values())) / len(bags)
    w, out = D.normal(text), []
    for (i, t), n in ((x, len(bags[x[0]])) for x in items if x[0] in bags):
        step = max(len(b) for b in bags.values() if D.length_class(len(b)) == D.length_class(n))
        mass = {x: math.log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * bags[i].count(x) * 2.2 / (bags[i].count(x) + 1.2 * (0.25 + 0.75 * n / mean)) for x in set(bags[i])}
        best = None
        for lo in range(0, len(w), step):
            part = w[lo : lo + 2 * step]
            score = sum(v for x, v in mass.items() if x in set(part)) / sum(mass.values())
            if score < D.THRESHOLD:
                continue
            shares = []
            for p in D.question_and_answer(t):
                if len(p) < 5:
                    shares.append(float(any(part[k : k + len(p)] == p for k in range(len(part) - len(p) + 1))))
                else:
                    have, want = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (part, p))
                    shares.append(len(want & have) / len(want))
            if min(shares) >= 0.5 and (best is None or score > best[1] + 1e-9):
                best = (i, score, *shares, lo)
        if best:
            out.append(best)
    return out


def test_search_against_all_passages():
    r = random.Random(4)
    items = [(k, " ".join(say(r, r.randint(1, 60))) + ". " + " ".join(say(r, r.randint(1, 9))) + ".") for k in range(70)]
    items += [(100, " ".join(say(r, 700)) + ". " + " ".join(say(r, 300)) + "."), (101, "w1"), (102, ""), (103, "w2 w3 w4 w5 w6 w7 w8 w9")]
    indexes, found = D.build_classes(items), 0
    for trial in range(90):
        words = say(r, r.randint(0, 900))
        for _ in range(r.randint(0, 3)):
            whole = D.normal(r.choice(items)[1])
            a, b = sorted((r.randint(0, len(whole)), r.randint(0, len(whole)))) if trial % 3 else (0, len(whole))
            words = words[: len(words) // 2] + whole[a:b] + words[len(words) // 2 :]
        got = sorted(x for index in indexes for x in D.search(index, words, D.THRESHOLD, D.OVERLAP))
        want = sorted(brute(items, " ".join(words)))
        assert [(x[0], *map(lambda v: round(v, 6), x[1:4])) for x in got] == [(x[0], *map(lambda v: round(v, 6), x[1:4])) for x in want]
        found += len(got)
    assert found > 60


def test_question_without_its_answer_is_no_leak(spark):
    r = random.Random(8)
    q, a, short = " ".join(say(r, 40)), " ".join(say(r, 9)), "w7 w8"
    bench = spark.createDataFrame([(1, f"{q}. {a}."), (2, f"{' '.join(say(r, 30))} {q[:80]}. {short}."), (2, "")], "item_id long, text string")
    second = D.normal(bench.filter("item_id = 2 and length(text) > 0").first()["text"])
    texts = [(1, q), (2, f"{q} {a}"), (3, f"{a} {' '.join(say(r, 300))}"), (4, " ".join(second[:-2])), (5, " ".join(second)), (5, " ".join(second)), (None, f"{q} {a}"), (6, None), (7, "")]
    out = [(x["doc_id"], x["item_id"]) for x in D.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()]
    assert sorted(out, key=repr) == sorted([(2, 1), (5, 2), (5, 2), (None, 1)], key=repr)


def test_texts_longer_than_a_segment():
    r = random.Random(3)
    item = (1, " ".join(f"only{k}" for k in range(30)) + ". at the end.")
    index = D.build([item, (2, "w1 w2 w3 w4 w5 w6 w7. w8 w9.")])
    for at in (0, D.SEGMENT - 20, D.SEGMENT, 2 * D.SEGMENT + 5):
        words = say(r, at) + D.normal(item[1]) + say(r, 50)
        assert 1 in {x[0] for x in D.search(index, words, D.THRESHOLD, D.OVERLAP)}
