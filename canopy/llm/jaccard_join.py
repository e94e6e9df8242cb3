"""N-gram Jaccard self-join: MinHash candidates, Bayesian pruning, exact verification.

Documents with the same set of word 5-grams are one class, found by a 128-bit fingerprint, and only classes go on. A
class has 192 MinHash values; bands of 6 give buckets (a pair at similarity 0.8 misses all 32 bands with probability
6e-5). In a bucket of up to 32 classes all pairs are candidates; a larger one only links each class to the first, and
what it holds is compared later, in blocks. Candidates are pruned by comparing MinHash values in steps: a pair goes as
soon as the posterior probability (uniform prior) of reaching the threshold falls below a step's part of the tolerance
(all steps together drop a pair at similarity 0.8 with probability 9.9e-5). What remains falls into clusters; a
cluster's pairs, pruned again on all values, are verified on the exact sets, a pair of blocks at a time, so that a huge
group of near copies is many tasks, and links leave a task as sums and a spanning forest, never as pairs.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import held, stage, table
from canopy.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
K = BANDS * ROWS
PREFIX, STEP = 64, 32
TOLERANCE = 1e-4
PAIR_BUCKET = 32
BLOCK, BLOCK_GRAMS = 256, 1 << 19

_rng = np.random.default_rng(77)
XOR, MULTIPLY = _rng.integers(0, 1 << 32, (K, 1), dtype=np.uint32), _rng.integers(0, 1 << 31, (K, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLACES = _rng.integers(0, 1 << 62, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = _rng.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word to 64-bit hash; forgets all when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word 5-grams; of all words at once, if there are fewer than 5; none without words."""
    w = text.lower().split() if text else []
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    if len(w) < GRAM:
        return mixed((h * PLACES[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    out = h[: len(h) - GRAM + 1] * PLACES[0]
    for k in range(1, GRAM):
        out = out + h[k : len(h) - GRAM + 1 + k] * PLACES[k]
    return np.unique(mixed(out))


def minhash(g: np.ndarray) -> np.ndarray:
    x, out = g.astype(np.uint32), np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 1024):
        y = x[None, k : k + 1024] ^ XOR
        y *= MULTIPLY
        np.minimum(out, y.min(axis=1), out=out)
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for b in batches:
        prints, sizes, sigs, buckets = [], [], [], []
        for text in b.column(2):
            g = grams(text.as_py(), words)
            m = minhash(g) if len(g) else None
            prints.append(None if m is None else hashlib.blake2b(g.tobytes(), digest_size=16).digest())
            sizes.append(len(g))
            sigs.append(None if m is None else (m & np.uint32(0xFFFF)).astype("<u2").tobytes())
            buckets.append(None if m is None else mixed((m.reshape(BANDS, ROWS).astype(np.uint64) * FOLD).sum(axis=1) + band).view(np.int64))
        # ids stay as Arrow has them: pandas would round large ones beside nulls
        made = [pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "text_key", "print", "n", "sig", "buckets"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 STEP, ... values: the fewest equal ones with which the similarity is still at least the threshold with probability tolerance, divided over the steps.

    With a uniform prior the posterior after m of n equal is Beta(m + 1, n - m + 1), and P(at least t) is the chance of at most m successes in n + 1 draws.
    """
    out = []
    steps = range(STEP, K + 1, STEP)
    for n in steps:
        mass, m = 0.0, -1
        while mass < tolerance / len(steps):
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def pruned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[i], b[j]) of signatures those that no step drops."""
    same = np.zeros(len(i), dtype=np.int32)
    for step, need in enumerate(least):
        lo = step * STEP
        if lo >= a.shape[1]:
            break
        for k in range(0, len(i), 1 << 16):
            same[k : k + (1 << 16)] += (a[i[k : k + (1 << 16)], lo : lo + STEP] == b[j[k : k + (1 << 16)], lo : lo + STEP]).sum(axis=1, dtype=np.int32)
        keep = same >= need
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[i] and sets[j]: pair by pair, or for many pairs as products of 0/1 matrices over 16384 grams at a time."""
    if len(i) <= 2000:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    used = np.unique(np.concatenate([i, j]))
    at = np.zeros(len(sets), dtype=np.int64)
    at[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, gram, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    often = times[gram] > 1
    owner, gram = owner[often], gram[often]
    _, gram = np.unique(gram, return_inverse=True)
    total, width = np.zeros((len(used), len(used)), dtype=np.float32), 16384
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for lo in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        s, e = np.searchsorted(gram, [lo, lo + width])
        m = np.zeros((len(used), width), dtype=np.float32)
        m[owner[s:e], gram[s:e] - lo] = 1
        total += m @ m.T
    return np.rint(total[at[i], at[j]]).astype(np.int64)


def evaluate(group: pd.DataFrame, threshold: float, least: list[int], words: Words) -> list[tuple[int, int, int | None]]:
    """Of one cluster's block or pair of blocks: (class, documents it links to, None), and (class, 0, other) for a spanning forest of the links."""
    group = group.drop_duplicates("cid").sort_values("cid")
    ids, sizes, n, block = (group[c].to_numpy() for c in ("cid", "size", "n", "block"))
    sig = np.frombuffer(b"".join(group["sig"]), dtype="<u2").reshape(len(group), K)
    cross = group["lo"].iloc[0] != group["hi"].iloc[0]
    i, j = np.triu_indices(len(ids), 1)
    if cross:
        other = block[i] != block[j]
        i, j = i[other], j[other]
    part = Fraction(str(threshold))
    close = np.minimum(n[i], n[j]) * part.denominator >= np.maximum(n[i], n[j]) * part.numerator
    i, j = pruned(sig, sig, i[close], j[close], least)
    if not len(i):
        return []
    sets = [np.empty(0, dtype=np.uint64)] * len(ids)
    texts = group["text"].to_numpy()
    for u in np.unique(np.concatenate([i, j])):
        sets[u] = grams(texts[u], words)
    both = shared(sets, i, j)
    linked = both * (part.denominator + part.numerator) >= part.numerator * (n[i] + n[j])
    i, j = i[linked], j[linked]
    links = np.bincount(i, weights=sizes[j], minlength=len(ids)) + np.bincount(j, weights=sizes[i], minlength=len(ids))
    root = np.arange(len(ids))
    while True:  # least labels along links
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    out: list[tuple[int, int, int | None]] = [(int(ids[u]), int(links[u]), None) for u in np.flatnonzero(links)]
    return out + [(int(ids[u]), 0, int(ids[root[u]])) for u in np.flatnonzero(root != np.arange(len(ids)))]


def link(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, pair_bucket: int = PAIR_BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), class_id (least doc_id of the component), n_links (documents at or above the threshold), first for each row of docs.

    first: whether the row has the least id (null is the largest) and then the least text_key of its component; equal rows all have it.

    Words are what white space separates, lower-cased. Texts without words (null, empty, blank) link to nothing and are their own class,
    as is any row without links. Rows that repeat an id or have none are documents like others; a class takes its least id that is
    not null, if it has one. Other columns are not read.
    """
    least = least_matches(threshold, tolerance)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketches = stage(rows.mapInArrow(sketch, f"doc_id {kind}, text_key long, print binary, n int, sig binary, buckets array<long>"), "sketches")
    classes = sketches.filter("n > 0").groupBy("print").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("head"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = classes.select("cid", F.explode("buckets").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    placed = stage(banded.join(full, "bucket"), "buckets")
    small, large = placed.filter(F.col("held") <= pair_bucket), placed.filter(F.col("held") > pair_bucket)
    pairs = small.select("bucket", F.col("cid").alias("a")).join(small.select("bucket", F.col("cid").alias("b")), "bucket").filter("a < b").select("a", "b").distinct()
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.substring("sig", 1, 2 * PREFIX).alias(f"sig_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b[x]), dtype="<u2").reshape(len(b), PREFIX) for x in ("sig_a", "sig_b"))
            every = np.arange(len(b))
            yield b.iloc[pruned(a, c, every, every, least)[0]][["a", "b"]]

    near = sized.mapInPandas(prune, "a long, b long")
    leaders = stage(large.groupBy("bucket").agg(F.min("cid").alias("b")), "leaders")  # a table on both sides lets a join split a hot bucket
    stars = large.join(leaders, "bucket").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    clusters = components(near.union(stars))

    # tables on both sides of the join by cluster let it split a hot one
    members = stage(clusters.join(classes.select(F.col("cid").alias("node"), "size", "n", "sig", "head"), "node"), "clustered")
    extent = members.groupBy("label").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("grams"))
    extent = stage(extent.select("label", F.ceil(F.greatest(F.col("classes") / block, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")), "extent")
    members = members.join(extent, "label").select(F.col("node").alias("cid"), "label", "size", "n", "sig", F.col("head.doc_id").alias("_id"), F.col("head.text_key").alias("_key"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = stage(members, "members")
    bundles = max(1, -(-members.count() // block))
    rows, _ = held(rows, F.col("text_key"), members.select("_key"))  # most texts are in no cluster and stay where they are
    texts = members.join(rows, (members["_key"] == rows["text_key"]) & members["_id"].eqNullSafe(rows["doc_id"])).select("cid", "label", "size", "n", "sig", "text", "blocks", "block")
    # clusters of one block go in bundles, each block of a larger one meets every other
    meet = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cid", "label", "size", "n", "sig", "text", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(bundles))).otherwise(F.xxhash64("label")).alias("bundle"),
    )

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        words, out = Words(), []
        for _, one in group.groupby("label"):
            out += evaluate(one, threshold, least, words)
        return pd.DataFrame(out, columns=["cid", "links", "other"]).astype({"cid": "int64", "links": "int64", "other": "Int64"})

    found = stage(meet.groupBy("bundle", "lo", "hi").applyInPandas(verify, "cid long, links long, other long"), "links")
    joined = components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    ids = classes.select(F.col("cid").alias("node"), "least", "head")
    first = joined.join(ids, "node").groupBy("label").agg(F.min("least").alias("class_id"), F.min("head").alias("top"))
    links = found.groupBy(F.col("cid").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.select(F.col("cid").alias("node"), "print", "size", "least", "head").join(joined, "node", "left").join(first, "label", "left").join(links, "node", "left").filter("size > 1 or links is not null")
    known = known.select("print", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("top", "head").alias("top"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketches.select("doc_id", "text_key", "print").join(known, "print", "left")
    first = F.col("n_links").isNull() | (F.col("top.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("top.text_key") == F.col("text_key")))
    return out.select("doc_id", "text_key", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
