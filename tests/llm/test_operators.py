"""Edge cases and brute-force comparisons: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from canopy.llm import decontamination as D
from canopy.llm import html_extraction as H
from canopy.llm import jaccard_join as J
from canopy.llm import line_dedup, mixing, quality_classifier, quality_rules, sharding
from canopy.llm.common import held
from canopy.llm.components import components

def say(r, n):
    return " ".join("".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 7))) for _ in range(n))


def test_shard(docs, none, rows):
    out = sharding.shard(docs, n_shards=7).collect()
    per = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(7))
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in per.items())
    assert {(r["doc_id"], r["text"], r["_id"]) for r in out} == {(r[0], r[1], r[5]) for r in rows}
    assert sharding.shard(none).count() == 0
    names = [c for c in docs.columns if c != "shard"]
    assert Counter(map(str, (tuple(r[c] for c in names) for r in out))) == Counter(str(x[:-1]) for x in rows)
    odd = docs.sparkSession.createDataFrame([("x", None, 1), (None, "x", 1), ("x", None, 1)] + [("hot", "hot", 2)] * 70_000, "_h string, _l string, _high int")
    got = sharding.shard(odd, n_shards=3).groupBy("_h", "_l", "_high").count().collect()
    assert {tuple(r) for r in got} == {("x", None, 1, 2), (None, "x", 1, 1), ("hot", "hot", 2, 70_000)}
    m = sharding.communication_matrix([30, 50, 20], [25, 25, 50], 1)
    assert m.sum(0).tolist() == [25, 25, 50] and m.sum(1).tolist() == [30, 50, 20]
    import numpy as np
    import pytest

    for n_shards, total, bound in ((200, 10**9, 8_000_000), (4096, 10**9, 8_000_000), (31_250, 10**6, 8_000_000), (7, 60, 2000), (40, 10**12, 8_000_000)):
        cells, blocks = sharding.matrix_size(total, n_shards, 256, 512, bound)
        assert cells * blocks <= bound and cells % n_shards == 0 and blocks & (blocks - 1) == 0 and blocks >= 256
    with pytest.raises(ValueError):
        sharding.shard(docs, n_shards=40_000)
    assert max(Counter(r["shard"] for r in sharding.shard(docs, n_shards=7, max_matrix=2000).collect()).values()) <= -(-len(rows) // 7)
    big = [sharding.hypergeometric(np.random.default_rng(s), 2_000_000_000, 2_000_000_000, 1000) for s in range(200)]
    assert 490 < np.mean(big) < 510 and 12 < np.std(big) < 20


def test_line_dedup(docs, none, rows):
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            held.setdefault(k, []).append(-1 if r[0] is None else r[0])
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = Counter((r[0], "\n".join(x for x in (r[1] or "").split("\n") if gone.get(key(x), r[0]) == r[0])) for r in rows)
    assert gone and Counter((r["doc_id"], r["text"] or "") for r in out) == want
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0


def test_quality_rules(docs, none, rows):
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (out[i]["n_words"], out[i]["n_repeat_words"], out[i]["word_chars"]) == (len(w), len(cover), sum(map(len, w)))
        assert out[i]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (out[i]["kept"] and out[i]["base_failed"])
    assert quality_rules.apply_rules(none).count() == 0


def test_quality_rules_reject_depleted(spark):
    r = random.Random(8)
    boiler = say(r, 60)
    rows = [(i, f"{boiler}\n{say(r, 5)}", "h") for i in range(30)] + [(i, say(r, 80), "h") for i in range(100, 130)]
    out = {x["doc_id"]: x["kept"] for x in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[i] for i in range(30)) and all(out[i] for i in range(100, 130))


def test_quality_rules_limit_does_not_rise_with_the_host(spark):
    r = random.Random(12)
    boiler, copied = say(r, 60), f"{say(r, 60)}\n{say(r, 5)}"
    rows = [(i, f"{boiler}\n{say(r, 5)}", "h") for i in range(30)] + [(i, say(r, 40), "h") for i in range(100, 3100)]
    rows += [(i, copied, "h") for i in range(5000, 5025)] + [(6000, say(r, 60), "h")] * 30
    out = {x["doc_id"]: x["kept"] for x in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[i] for i in (*range(30), *range(5000, 5025))) and all(out[i] for i in (*range(100, 3100), 6000))


def test_html():
    weights, edges = H.fit()
    import numpy as np

    right = total = 0
    for page in H.labelled_pages(120, seed=991):
        nodes = H.parse(page)
        want = [H.MARK in "".join(n.parts) for n in nodes]
        for n in nodes:
            n.parts = [p.replace(H.MARK, "") for p in n.parts]
        got = H.marginals(nodes, (H.features(nodes) @ np.array(weights)).tolist(), edges)
        for n, w, g in zip(nodes, want, got, strict=True):
            total, right = total + n.leaf, right + (n.leaf and w == (g >= 0))
    assert right / total > 0.93
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U.</h1><p>First  para\ngraph of the text.<p>Second one, <b>bold</b>.</article><footer>&copy; site</footer>"
    assert H.main_text(page, np.array(weights), edges) == "T & U.\nFirst para graph of the text.\nSecond one, bold."
    for broken in ("<", "<p", "<!--", "<script>x", "</p></p>", '<a href="x', "&am", "<b><p></b>x"):
        H.main_text(broken, np.array(weights), edges)


def test_marginals_against_enumeration():
    from itertools import product
    from math import exp

    r = random.Random(2)
    nodes = H.parse("<div class=content><p>a</p><ul><li>b<li>c</ul></div>")
    own = [r.uniform(-2, 2) for _ in nodes]
    edges = tuple(tuple(r.uniform(-1, 1) for _ in range(4)) for _ in range(3))
    mass = [[0.0, 0.0] for _ in nodes]
    for y in product((0, 1), repeat=len(nodes)):
        p = exp(sum(o for o, k in zip(own, y, strict=True) if k) + sum(edges[H.edge_type(nodes, i)][2 * y[nodes[i].up] + y[i]] for i in range(1, len(nodes))))
        for i, k in enumerate(y):
            mass[i][k] += p
    for (a, b), got in zip(mass, H.marginals(nodes, own, edges), strict=True):
        assert abs(b / (a + b) - 1 / (1 + exp(-got))) < 1e-9


def test_classifier(spark, docs, none):
    r = random.Random(6)
    rows = [(i, say(r, 60) if i % 2 else " ".join(w.upper() + "!!" for w in say(r, 60).split()), i % 2) for i in range(300)]
    train = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(None, 1), (5000, None)], "doc_id long, quality int")
    model = quality_classifier.fit(train, labels, max_labelled=200)
    got = {x["doc_id"]: x["score"] for x in quality_classifier.score(train, model).collect()}
    test = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum((got[x[0]] >= 0.5) == bool(x[2]) for x in test) / len(test) > 0.95
    every = quality_classifier.score(docs, model, keep=docs.columns, name="s").collect()
    assert len(every) == docs.count() and all(0 <= x["s"] <= 1 for x in every)
    assert quality_classifier.score(none, model).count() == 0 and quality_classifier.fit(none, labels).temperature == 1


def test_leaks(spark, docs, none):
    r = random.Random(9)
    items = [(k, say(r, r.randint(16, 50)) + ". " + say(r, 6) + ".") for k in range(60)]
    texts = [(k, say(r, 200) + " " + items[k][1] + " " + say(r, 150)) for k in range(20)] + [(100 + k, say(r, 400)) for k in range(20)] + [(900, None), (901, "")]
    bench = spark.createDataFrame([*items, (None, "x"), (77, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(20)}
    sliced = {(x["doc_id"], x["item_id"]) for x in D.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench, slice_items=17).collect()}
    assert sliced == got
    assert D.find_leaks(none, bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0
    index = D.build(items)
    for _ in range(30):
        terms = sorted(r.sample(range(len(index.terms)), 40))
        full = Counter()
        for t in terms:
            full.update(dict(zip(index.postings[t][0], index.postings[t][1], strict=True)))
        want = {k: round(v, 9) for k, v in full.items() if v >= 0.1}
        assert {k: round(v, 9) for b in range(0, len(items), index.per_coarse) for k, v in D.wand(index, terms, b, min(b + index.per_coarse, len(items)), 0.1)} == want


def test_leaks_of_long_items(spark):
    r = random.Random(19)
    long = {k: [say(r, n - n // 3).split(), say(r, n // 3).split()] for k, n in ((1, 600), (2, 2300), (3, 5000))}
    items = [(k, f"{' '.join(q)}. {' '.join(a)}.") for k, (q, a) in long.items()] + [(9, say(r, 30))]
    words = {k: q + a for k, (q, a) in long.items()}
    texts = [(k, f"{say(r, 700)} {t} {say(r, 900)}") for k, t in items]
    # seven tenths of an item, in a text that is longer and one that is not
    texts += [(20, f"{say(r, 1300)} {' '.join(words[3][1000:4500])} {say(r, 9000)}"), (21, " ".join(words[2][600:2200]))]
    texts += [(30, say(r, 12_000))]
    got = {(x["doc_id"], x["item_id"]) for x in D.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (9, 9), (20, 3), (21, 2)}


def test_leak_scores_do_not_depend_on_slices(spark):
    r = random.Random(23)
    items = [(k, say(r, r.randint(16, 60)) + ". " + say(r, 6) + ".") for k in range(50)] + [(60, say(r, 700)), (61, say(r, 900)), (62, ""), (63, "...")]
    texts = [(k, f"{say(r, 200)} {' '.join(t.split()[2:])} {say(r, 150)}") for k, t in items if len(t) > 9]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, sliced = ({(x["doc_id"], x["item_id"]): tuple(x)[2:] for x in D.find_leaks(docs, bench, slice_items=n).collect()} for n in (100, 9))
    assert set(whole) == set(sliced) and {k for k, _ in texts} == {k for k, _ in whole}
    assert all(abs(whole[k][0] - sliced[k][0]) < 1e-6 and whole[k][1:] == sliced[k][1:] for k in whole)


def brute(rows):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(r[1]) for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = root[i], root[j]
                root = [min(x, y) if z in (x, y) else z for z in root]
    least = {g: min((rows[i][0] for i in range(len(rows)) if root[i] == g and rows[i][0] is not None), default=None) for g in set(root)}
    return Counter((rows[i][0], least[root[i]], links[i]) for i in range(len(rows)))


def test_jaccard_join(spark, docs, none, rows):
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in J.link(docs).collect()) == brute(rows)
    assert J.link(none).count() == 0
    r = random.Random(3)
    base = say(r, 100).split()
    near = [(i, " ".join(base[:k] + [f"w{i}"] + base[k + 1 :])) for i, k in ((i, r.randrange(100)) for i in range(90))] + [(500, say(r, 50))]
    got = J.link(spark.createDataFrame(near, "doc_id long, text string"), pair_bucket=8, block=16).collect()
    assert Counter((x["doc_id"], x["class_id"], x["n_links"]) for x in got) == brute(near)


def test_pruning_stays_within_its_tolerance():
    from math import comb

    alive, lost = {0: 1.0}, 0.0  # equal values of a pair at the threshold: probability
    for need in J.least_matches(J.THRESHOLD, J.TOLERANCE):
        after = Counter()
        for m, p in alive.items():
            for k in range(J.STEP + 1):
                after[m + k] += p * comb(J.STEP, k) * J.THRESHOLD**k * (1 - J.THRESHOLD) ** (J.STEP - k)
        lost += sum(p for m, p in after.items() if m < need)
        alive = {m: p for m, p in after.items() if m >= need}
    assert 0 < lost <= J.TOLERANCE


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_components_meet_an_edge_once(spark):
    """Stars, cliques and chains settle in one round, however long: their edges are not joined again and again."""
    edges = [(0, i) for i in range(1, 50)] + [(100 + i, 100 + j) for i in range(12) for j in range(12)] + [(200 + i, 201 + i) for i in range(40)]
    got = components(spark.createDataFrame(edges, "a long, b long"), rounds=1).collect()
    assert {x["node"]: x["label"] for x in got} == {i: 0 for i in range(50)} | {100 + i: 100 for i in range(12)} | {200 + i: 200 for i in range(41)}
    # the greatest node in the middle: its neighbours meet in the second round
    got = components(spark.createDataFrame([(i, 99) for i in range(50)], "a long, b long"), rounds=2).collect()
    assert len(got) == 51 and {x["label"] for x in got} == {0}


def test_mixing(docs, none, rows):
    out = mixing.mix(mixing.describe(docs), budget_share=0.6).collect()
    assert len(out) == len(rows) and all(0 <= x["probability"] <= 1 for x in out)
    total = sum(x["tokens"] for x in out)
    assert abs(sum(x["tokens"] * x["probability"] for x in out) / total - 0.6) < 1e-6
    assert mixing.mix(mixing.describe(none)).count() == 0


def test_mixing_marginals_and_large_tables(spark):
    r = random.Random(7)
    rows = [(f"s{r.randrange(4)}", r.choice(["a", "b"]), str(r.randrange(3)), r.randint(1, 500)) for _ in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    p, small = mixing.cell_probabilities(cells, 0.5, 0.5)
    q = {tuple(x[:3]): x for x in p.collect()}
    c = {tuple(x[:3]): x["tokens"] for x in cells.collect()}
    for k in range(3):
        seen, fitted = Counter(), Counter()
        for key, n in c.items():
            seen[key[k]] += n
            fitted[key[k]] += n * q[key]["weight"]
        goal = mixing.goals(seen, 0.5)
        assert small and all(abs(fitted[v] / sum(c.values()) - goal[v]) < 1e-6 for v in goal)


def test_mixing_large_tables_are_fitted_like_small_ones(spark):
    # sources of mostly one language: 20 rounds are not enough
    rows = [(f"s{k}", x, "0", 1000 * (k + 1) if (k < 2) == (x == "a") else 250 + k) for k in range(4) for x in "ab"]
    cells = spark.createDataFrame([*rows, ("s9", "a", "0", 0)], "source string, lang string, topic string, tokens long")
    small, is_small = mixing.cell_probabilities(cells, 0.5, 0.5)
    large, is_large = mixing.cell_probabilities(cells, 0.5, 0.5, max_cells=4)
    want = {tuple(x[:3]): x[3:] for x in small.collect()}
    got = {tuple(x[:3]): x[3:] for x in large.collect()}
    assert is_small and not is_large and set(got) == set(want)
    assert all(abs(a - b) < 1e-6 * max(1, b) for k in want for a, b in zip(got[k], want[k], strict=True))
    empty, _ = mixing.cell_probabilities(cells.filter("tokens = 0"), 0.5, 0.5, max_cells=0)
    assert [tuple(x) for x in empty.collect()] == [("s9", "a", "0", 1.0, 1.0)]


def test_held_keeps_every_partner(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.col("id").alias("_at"), F.lit("w").alias("_word"))
    keys = rows.filter("_at % 10 = 3").select("k")
    may, no = held(rows, F.col("k"), keys)
    assert may.columns == rows.columns == no.columns
    a, b = ({r[1] for r in x.collect()} for x in (may, no))
    assert not a & b and a | b == set(range(20_000)) and {i for i in a | b if i % 10 == 3} <= a and len(a) < 4000
    may, no = held(rows, F.col("k"), keys.limit(0))
    assert may.count() == 0 and no.count() == 20_000


def test_pipeline_near_duplicates_against_brute_force(spark, docs, rows, none):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids = [r[0] for r in rows]
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), set()).add(ids[i])
    want = {min((x for x in g if x is not None), default=None) for g in groups.values()}
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0


def test_pipeline_drops_rows_of_groups_only(spark, tmp_path):
    r = random.Random(31)
    a, b, c, d, e, item = (say(r, 80) for _ in range(6))
    rows = [(1, a), (1, a), (1, a + " end"), (2, a), (None, b), (None, b), (None, b + " end"), (None, c), (None, c + " end"), (3, d), (3, e), (None, ""), (None, "")]
    kept = Counter(tuple(x) for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    group = {t: g for g in (a, b, c) for t in (g, g + " end")}
    assert Counter((i, group.get(t, t)) for i, t in kept.elements()) == Counter([(1, a), (None, b), (None, c), (3, d), (3, e), (None, ""), (None, "")])
    assert not kept - Counter(rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = f"{say(r, 100)} {item} {say(r, 100)}"
    rows = [(None, bad), (None, c), (None, None), (3, bad), (3, d), (3, d), (4, e)]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert Counter(tuple(x) for x in kept.collect()) == Counter(x for x in rows if x[1] != bad)


def test_pipeline_run(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    per = Counter(r["shard"] for r in out)
    assert out and len({r["doc_id"] for r in out}) == len(out) and all(docs[r["doc_id"]] == r["text"] for r in out)
    assert max(per.values()) - (min(per.values()) if len(per) == 40 else 0) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in per.items())
