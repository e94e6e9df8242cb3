"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

An item's posting weights are its BM25 term weights over its self-score, so a passage's score for an item is the share of
the item's BM25 mass that the passage covers, and one threshold fits all items. Passages are windows of twice the longest
item, one longest item apart, so each possible copy lies whole in one of them. Items of more than 512 words do not widen the
passages of shorter ones: they have indexes of their own, one for each doubling of the length. A first bound by coarse blocks of items, as
one matrix operation for all passages of a text, leaves few (passage, block) pairs; in those, WAND with fine block maxima
retrieves every item at or above the threshold. Of a retrieved item the question and the answer are verified, each by the share of its
5-grams that the passage holds and with a threshold of its own; one of fewer than five words must stand there whole.

The indexes are what is sent to the executors; they are built from slices of at most `slice_items` items, whose size is thus
bounded, and documents are read once for each slice. Document frequencies, the mean length and the passages' widths are those
of the whole benchmark, so scores do not depend on the slices. Documents are rows of one pass; nothing is shuffled.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import stage, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = ANSWER_OVERLAP = 0.5
GRAM = 5
SLICE_ITEMS = 20_000
FINE, COARSE = 4, 64
#: Items of up to so many words share an index; those of up to twice as many the next, and so on.
SHORT = 512
SEGMENT = 200_000


def normal(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words: its last sentence is the answer, what stands before is the question; of a single sentence the last third."""
    cut = re.split(r"(?<=[.!?])\s+", text.strip())
    if len(cut) > 1 and normal(cut[-1]) and normal(" ".join(cut[:-1])):
        return normal(" ".join(cut[:-1])), normal(cut[-1])
    w = normal(text)
    return w[: len(w) - len(w) // 3], w[len(w) - len(w) // 3 :]


def grams(w: list[str]) -> set[tuple[str, ...]]:
    """Its 5-grams; none, if it is shorter."""
    return {tuple(w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)}


class Passage:
    """A window's words; its 5-grams and its words in a row are made when they are first asked for."""

    def __init__(self, words: list[str]):
        self.words, self.grams, self.row = words, None, ""

    def share(self, part: list[str], wanted: set[tuple[str, ...]]) -> float:
        """The share of a part's 5-grams that stand here; of a shorter part 1 or 0. An empty part is everywhere."""
        if wanted:
            self.grams = grams(self.words) if self.grams is None else self.grams
            return len(wanted & self.grams) / len(wanted)
        self.row = self.row or f" {' '.join(self.words)} "
        return float(not part or f" {' '.join(part)} " in self.row)


@dataclass
class Index:
    ids: list[int]
    terms: dict[str, int]
    #: For each term: items ascending, their weights, and the largest weight in each fine block that has one.
    postings: list[tuple[list[int], list[float], dict[int, float]]]
    coarse: np.ndarray  # term (the last: any other word) by coarse block: largest weight
    per_coarse: int
    #: Of each item the words and 5-grams of question and answer.
    parts: list[tuple[list[str], set, list[str], set]] = field(default_factory=list)
    longest: int = 1


def length_class(n: int) -> int:
    """0 up to SHORT words, then one more for each doubling."""
    return (max(1, -(-n // SHORT)) - 1).bit_length()


@dataclass
class Stats:
    """Of the whole benchmark: items with words, their mean length, the longest of each class of lengths, items that hold a word."""

    n: int
    mean: float
    longest: dict[int, int]
    df: dict[str, int]


def count(items: list[tuple[int, str]]) -> Stats:
    df: dict[str, int] = {}
    longest: dict[int, int] = {}
    n = total = 0
    for w in (normal(t) for _, t in items):
        if w:
            n, total, k = n + 1, total + len(w), length_class(len(w))
            longest[k] = max(longest.get(k, 0), len(w))
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    return Stats(n, total / max(1, n), longest, df)


def count_all(items: DataFrame) -> tuple[Stats, DataFrame]:
    """count by Spark, without df; word and df instead as a table, as all words may be many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[str | None, int | None, int]] = []
            for w in map(normal, b["text"]):
                if w:
                    rows += [(None, length_class(len(w)), len(w)), *((x, None, 1) for x in set(w))]
            yield pd.DataFrame(rows, columns=["word", "kind", "n"]).astype({"kind": "Int64", "n": "int64"})

    found = stage(items.mapInPandas(run, "word string, kind long, n long"), "item-words")
    kinds = found.filter("word is null").groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("total"), F.max("n").alias("longest")).collect()
    n = sum(r["items"] for r in kinds)
    df = stage(found.filter("word is not null").groupBy("word").agg(F.sum("n").alias("df")), "item-df")
    return Stats(n, sum(r["total"] for r in kinds) / max(1, n), {r["kind"]: r["longest"] for r in kinds}, {}), df


def build(items: list[tuple[int, str]], stats: Stats | None = None) -> Index:
    """An index of (id, text), whose passages fit the longest of its items' class of lengths; items without words are left out. stats: of these items, if not given."""
    stats = stats or count(items)
    items = sorted((i, t) for i, t in items if normal(t))
    bags = []
    for _, t in items:
        bag: dict[str, int] = {}
        for w in normal(t):
            bag[w] = bag.get(w, 0) + 1
        bags.append(bag)
    sizes = [sum(b.values()) for b in bags]
    terms = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    lists: list[list[tuple[int, float]]] = [[] for _ in terms]
    for k, (bag, n) in enumerate(zip(bags, sizes, strict=True)):
        raw = {w: np.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / stats.mean)) for w, tf in bag.items()}
        whole = sum(raw.values())
        for w, x in raw.items():
            lists[terms[w]].append((k, float(x / whole)))
    per = max(FINE, -(-len(items) // COARSE))
    coarse = np.zeros((len(terms) + 1, max(1, -(-len(items) // per))), dtype=np.float32)
    postings = []
    for t, posting in enumerate(lists):
        blocks: dict[int, float] = {}
        for k, x in posting:
            coarse[t, k // per] = max(coarse[t, k // per], x)
            blocks[k // FINE] = max(blocks.get(k // FINE, 0.0), x)
        postings.append(([k for k, _ in posting], [x for _, x in posting], blocks))
    qa = [question_and_answer(t) for _, t in items]
    return Index([i for i, _ in items], terms, postings, coarse, per, [(q, grams(q), a, grams(a)) for q, a in qa], max((stats.longest[length_class(n)] for n in sizes), default=1))


def build_classes(items: list[tuple[int, str]], stats: Stats | None = None) -> list[Index]:
    """An index for each class of lengths that items have. stats: of these items, if not given."""
    stats = stats or count(items)
    by: dict[int, list[tuple[int, str]]] = {}
    for i, t in items:
        by.setdefault(length_class(len(normal(t))), []).append((i, t))
    return [build(by[k], stats) for k in sorted(by)]


def wand(index: Index, terms: list[int], first: int, last: int, threshold: float) -> list[tuple[int, float]]:
    """Items from first to last - 1 whose weights over the terms sum to the threshold or more: WAND with block maxima."""
    cursors = []  # [item, place in posting, items, weights, blocks, largest]
    for t in terms:
        items, weights, blocks = index.postings[t]
        at = bisect_left(items, first)
        if at < len(items) and items[at] < last:
            cursors.append([items[at], at, items, weights, blocks, float(index.coarse[t, first // index.per_coarse])])
    found = []

    def to(c: list, item: int) -> None:
        c[1] = bisect_left(c[2], item, c[1])
        c[0] = c[2][c[1]] if c[1] < len(c[2]) else last

    while cursors:
        cursors.sort(key=itemgetter(0))
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            if c[0] >= last:
                break
            bound += c[5]
            if bound >= threshold - 1e-9:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        block = item // FINE
        upto = [c for c in cursors if c[0] <= item]
        if sum(c[4].get(block, 0.0) for c in upto) < threshold - 1e-9:
            # no item of this block before the next cursor's can reach it
            after = min((block + 1) * FINE, min((c[0] for c in cursors if c[0] > item), default=last), last)
            for c in upto:
                to(c, max(after, item + 1))
        elif cursors[0][0] == item:
            score = sum(c[3][c[1]] for c in upto)
            if score >= threshold - 1e-9:
                found.append((item, score))
            for c in upto:
                to(c, item + 1)
        else:
            for c in upto:
                if c[0] < item:
                    to(c, item)
        cursors = [c for c in cursors if c[0] < last]
    return found


def search(index: Index, w: list[str], threshold: float, overlap: float, answer_overlap: float = ANSWER_OVERLAP) -> list[tuple[int, float, float, float, int]]:
    """Of a whole text's words, for each verified item: id, best score, overlaps of question and answer, first word of the passage."""
    if not w or not index.ids:
        return []
    best: dict[int, tuple[float, float, float, int]] = {}
    step, other, n_blocks = index.longest, len(index.terms), index.coarse.shape[1]
    get = index.terms.get
    stride = max(1, SEGMENT // step) * step  # long texts in segments, which overlap by one piece
    for start in range(0, len(w), stride):
        part = w[start : start + stride + step]
        ids = np.fromiter((get(x, other) for x in part), dtype=np.int64, count=len(part))
        piece = np.arange(len(part)) // step
        # each term once in each piece; a passage is two neighbouring pieces
        distinct = np.unique(piece * (other + 1) + ids)
        bounds = np.zeros((int(piece[-1]) + 2, n_blocks), dtype=np.float32)
        known = distinct[distinct % (other + 1) != other]
        if len(known):
            owner, term = known // (other + 1), known % (other + 1)
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            bounds[owner[edges]] = np.add.reduceat(index.coarse[term], edges, axis=0)
        passes = bounds[:-1] + bounds[1:]
        for p, block in zip(*np.nonzero(passes >= threshold - 1e-4), strict=True):
            lo, hi = int(p) * step, (int(p) + 2) * step
            terms = np.unique(ids[lo:hi])
            terms = terms[terms != other]
            here = index.coarse[terms, block]
            if here.sum() < threshold - 1e-4:
                continue
            terms = terms[here > 0]
            passage = None
            for item, score in wand(index, terms.tolist(), int(block) * index.per_coarse, min((int(block) + 1) * index.per_coarse, len(index.ids)), threshold):
                passage = passage or Passage(part[lo:hi])
                q, q_grams, a, a_grams = index.parts[item]
                shares = passage.share(q, q_grams), passage.share(a, a_grams)
                if shares[0] >= overlap and shares[1] >= answer_overlap and (item not in best or score > best[item][0]):
                    best[item] = (score, *shares, start + lo)
    return [(index.ids[k], *v) for k, v in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word for each document and benchmark item whose question and answer it contains.

    Null and empty texts contain and are nothing; items with a null id are left out, items with equal ids are each looked
    for, equal documents each get their rows. Other columns are not read. No items or no documents give no rows.
    """
    from functools import reduce

    kind = docs.schema["doc_id"].dataType.simpleString()
    # a range of ids at a time, so that an index has a bounded number of items whatever the benchmark's size
    wanted = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_slices = max(1, -(-wanted.count() // slice_items))
    whole, df = count_all(wanted) if n_slices > 1 else (None, None)
    out = []
    for s in range(n_slices):
        part = [tuple(r) for r in wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_slices)) == s).collect()]
        stats = whole
        if whole:  # of the words of this slice only
            own = docs.sparkSession.createDataFrame([(w,) for w in sorted({w for _, t in part for w in normal(t)})], "word string")
            stats = replace(whole, df={r["word"]: r["df"] for r in df.join(own, "word").collect()})
        indexes = build_classes(part, stats)

        def run(batches: Iterator[pa.RecordBatch], indexes: list[Index] = indexes) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            for b in batches:
                rows = [(k, x) for k, t in enumerate(b.column(1)) for w in [normal(t.as_py())] for index in indexes for x in search(index, w, threshold, overlap, answer_overlap)]
                # ids stay as Arrow has them: pandas would round large ones beside nulls
                ids = b.column(0).take(pa.array([k for k, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for _, x in rows], kind) for i, kind in enumerate(kinds))], names)

        out.append(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long"))
    return reduce(DataFrame.unionAll, out)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds, with score, overlaps and place."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
