"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are summed in cells of source, language and topic. Raking scales the cells in turn until each marginal meets its
target; the ratio of fitted to observed tokens is the cell's weight. One factor, the same for all, turns weights into
probabilities (at most 1) whose expected tokens meet the budget, and a document is drawn if a hash of it falls below its
cell's probability. Only the table of cells leaves the executors, and only while it has at most max_cells rows; beyond
that the same steps run as DataFrame operations on the table of cells.

A document's topic is the nearest of TOPICS centroids of its long words' vector, unless the caller has a topic column of its own. The
centroids are fitted on all documents: vectors and centroids are whole numbers, so sums do not depend on their order and every run,
or recomputed task, gives the same topics. What the driver holds of them is TOPICS times DIM numbers.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import free_name, free_names, stage, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

TOPICS, LONG_WORD = 8, 5
#: A vector's length; its Euclidean norm, as whole numbers; rounds of centroid fitting, at most; vectors that centroids may start from.
DIM, SCALE, FIT_ROUNDS, STARTS = 64, 1000, 5, 512
DIMS = ("source", "lang", "topic")
MAX_CELLS = 100_000
#: Raking ends after a round whose factors are all this close to 1, or after so many rounds.
ROUNDS, CLOSE = 200, 1e-9
#: Factors that one pass over a large table of cells tries.
TRIES = 64
NULL = "\x00null"
#: Bytes of a text that are split at a time.
PIECE, SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
Targets = dict[str, dict[str | None, float]]


class Places(dict):
    """A word's place in a vector, times two, plus one if it counts down; -1 for short words. Forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        low = word.decode("utf-8", "replace").lower()
        self[word] = at = zlib.crc32(low.encode()) % (2 * DIM) if len(low) >= LONG_WORD else -1
        return at


def read_words(data: bytes | pa.Buffer) -> Iterator[list[bytes]]:
    """A text's words `[^\\x20\\x09-\\x0D]+`, of its UTF-8 bytes (split at just these characters), a piece of the text at a time, so that memory stays bounded."""
    data, at = memoryview(data), 0
    while at < len(data):
        gap = SPACE.search(data, at + PIECE) if len(data) - at > PIECE else None
        end = gap.start() if gap else len(data)
        yield bytes(data[at:end]).split()
        at = end


def measure(data: bytes | pa.Buffer, places: Places) -> tuple[int, np.ndarray]:
    """Words, and the vector of signed counts of hashed long words (LONG_WORD characters or more), square-rooted, of norm SCALE; zeros without such words."""
    tokens, n = 0, np.zeros(2 * DIM, dtype=np.int64)
    for words in read_words(data):
        tokens += len(words)
        at = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
        n += np.bincount(at[at >= 0], minlength=2 * DIM)
    raw = (n[0::2] - n[1::2]).astype(float)
    raw = np.sign(raw) * np.sqrt(np.abs(raw))
    norm = np.sqrt((raw * raw).sum())
    return tokens, np.rint(raw * (SCALE / norm)).astype("<i2") if norm else np.zeros(DIM, dtype="<i2")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each vector's topic: the largest dot product, ties to the smaller topic. Products of whole numbers, exact in any order."""
    return (vectors.astype(float) @ centroids.T.astype(float)).argmax(axis=1)


def described(docs: DataFrame, keep: list[str], tokens: str, extra: str, centroids: np.ndarray | None) -> DataFrame:
    """The columns keep of docs with tokens (words `[^\\x20\\x09-\\x0D]+` of the text, none for null), and as extra the vector, or with centroids the topic."""
    text = free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for b in batches:
            counts, found = np.zeros(len(b), dtype=np.int64), np.zeros((len(b), DIM), dtype="<i2")
            for i, t in enumerate(b.column(len(keep))):  # one text's words at a time, read where Arrow holds them
                if t.is_valid:
                    counts[i], found[i] = measure(t.as_buffer(), places)
            more = pa.array([v.tobytes() for v in found], pa.binary()) if centroids is None else pa.array(nearest(found, centroids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts), more], [*keep, tokens, extra])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))
    kind = T.BinaryType() if centroids is None else T.IntegerType()
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(tokens, T.LongType()), T.StructField(extra, kind)]))


def vectors(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, tokens and vector of each row of docs."""
    return described(docs, keep, "tokens", "vector", None)


def numbers(column: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i2").reshape(len(column), DIM).astype(np.int64)


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """k of the STARTS different vectors with the least hashes, those of DIM / 4 places or more first: each the least like those before it, the first the least like all."""
    found = rows.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(STARTS).collect()
    every = numbers(pd.Series([r["vector"] for r in found])) if found else np.zeros((0, DIM), dtype=np.int64)
    rich = np.count_nonzero(every, axis=1)
    pool = every[rich >= DIM // 4] if (rich >= DIM // 4).any() else every[rich > 0]
    chosen = np.zeros((k, DIM), dtype=np.int64)
    like = pool @ pool.sum(axis=0)
    for i in range(min(k, len(pool))):
        chosen[i] = pool[like.argmin()]
        like = (pool @ chosen[: i + 1].T).max(axis=1)
    return chosen


def unit(sums: np.ndarray) -> np.ndarray:
    """Sums as whole numbers of norm SCALE; zeros stay."""
    norms = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    return np.rint(sums / np.maximum(norms, 1e-9) * SCALE).astype(np.int64)


def summed(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The sum of each centroid's vectors."""
    k = len(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, DIM), dtype=np.int64)
        for b in batches:
            v = numbers(b["vector"])
            np.add.at(total, nearest(v, centroids), v)
        at, d = np.nonzero(total)
        yield pd.DataFrame({"topic": at, "d": d, "s": total[at, d]})

    out = np.zeros((k, DIM), dtype=np.int64)
    for r in rows.select("vector").mapInPandas(run, "topic long, d long, s long").groupBy("topic", "d").agg(F.sum("s").alias("s")).collect():  # k times DIM rows
        out[r["topic"], r["d"]] = r["s"]
    return out


def fit_topics(rows: DataFrame, k: int = TOPICS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """k centroids of rows' column vector, in a written table: each round moves them to the middle of their rows; one with none stays."""
    centroids = first_centroids(rows, k)
    for _ in range(rounds):
        sums = summed(rows, centroids)
        after = np.where(np.any(sums != 0, axis=1, keepdims=True), unit(sums), centroids)
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def with_topic(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with topic (a number) instead of vector."""
    others = [f for f in rows.schema if f.name != "vector"]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = nearest(numbers(b.column(len(names)).to_pylist()), centroids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(topic)], [*names, "topic"])

    return rows.select(*[F.col(f"`{n}`") for n in names], "vector").mapInArrow(run, T.StructType([*others, T.StructField("topic", T.IntegerType())]))


def describe_both(docs: DataFrame, keep: list[str], topic: str = "topic", tokens: str = "tokens", k: int = TOPICS) -> tuple[DataFrame, DataFrame]:
    """describe, and the same rows' columns keep, topic and tokens without texts."""
    rows = stage(vectors(docs, keep), "vectors")
    centroids = fit_topics(rows, k)
    narrow = with_topic(rows, centroids).select(*keep, F.col("topic").alias(topic), F.col("tokens").alias(tokens))
    return described(docs, [c for c in docs.columns if c.lower() not in (topic.lower(), tokens.lower())], tokens, topic, centroids), narrow


def describe(docs: DataFrame, topic: str = "topic", tokens: str = "tokens", k: int = TOPICS) -> DataFrame:
    """docs with topic (fitted on docs; 0 for texts without long words) and tokens (words; none for null and empty texts), which replace columns of these names."""
    return describe_both(docs, [], topic, tokens, k)[0]


def goals(totals: dict, power: float, named: dict | None = None) -> dict:
    """Each value's target share, summing to 1: what named gives it, others share the rest by their tokens to a power. Values without tokens get none."""
    seen = {k: float(v) for k, v in totals.items() if v > 0}
    said = {k: float(v) for k, v in (named or {}).items() if k in seen}
    rest = {k: v**power for k, v in seen.items() if k not in said}
    left = max(0.0, 1.0 - sum(said.values()))
    out = said | {k: left * v / sum(rest.values()) for k, v in rest.items()}
    whole = sum(out.values())
    return {k: v / whole for k, v in out.items()} if whole else out


def checked(targets: Targets | None, dims: tuple[str, ...]) -> Targets:
    """Targets with values as strings; ValueError for unknown dimensions, negative shares and shares of more than 1 in all."""
    out = {}
    for d, shares in (targets or {}).items():
        if d not in dims or any(not v >= 0 for v in shares.values()) or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {d} must be shares of a known dimension, 0 or more and at most 1 in all")
        out[d] = {NULL if k is None else str(k): float(v) for k, v in shares.items()}
    return out


def rake(cells: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights of cells (fitted share over observed share) by iterative proportional fitting. members: each cell's place in each dimension."""
    fitted = cells / cells.sum()
    for _ in range(rounds):
        off = 0.0
        for at, goal in zip(members, targets, strict=True):
            sums = np.bincount(at, weights=fitted, minlength=len(goal))
            factor = np.divide(goal, sums, out=np.ones_like(goal), where=sums > 0)
            off = max(off, float(np.abs(factor[sums > 0] - 1).max(initial=0)))
            fitted = fitted * factor[at]
        if off < close:
            break
    return np.divide(fitted * cells.sum(), cells, out=np.zeros_like(fitted), where=cells > 0)


def calibrate(cells: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, f * weight) with one f, whose expected tokens are the budget (all, if the budget exceeds them)."""
    if budget >= cells[weights > 0].sum():
        return (weights > 0).astype(float)
    order = np.argsort(-weights, kind="stable")
    c, w = cells[order], weights[order]
    below = np.concatenate([[0.0], np.cumsum(c)])  # tokens of cells that are taken whole
    rest = np.concatenate([np.cumsum((c * w)[::-1])[::-1], [0.0]])
    for k in range(len(c)):
        f = (budget - below[k]) / rest[k] if rest[k] > 0 else 0.0
        if f * w[k] <= 1:
            return np.minimum(1.0, f * weights)
    return np.minimum(1.0, weights / max(w[w > 0].min(), 1e-300))


def rake_frame(cells: DataFrame, power: float, budget_share: float, targets: Targets | None = None, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """rake and calibrate for a table of cells of any size, with rake's end; one aggregate a round says how far off it was. One pass tries TRIES factors for the budget, so few passes do."""
    dims, spark = cells.columns[:3], cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.select(*dims, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"))
    out = stage(cells.select(*dims, "tokens", (F.col("tokens") / F.lit(float(total))).alias("fitted")), "cells")
    cells = out.drop("fitted")
    wanted = {}
    for d in dims:
        said = spark.createDataFrame(list(checked(targets, dims).get(d, {}).items()), f"`{d}` string, said double")
        g = stage(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("seen")).filter("seen > 0").join(said, d, "left").withColumn("own", F.when(F.col("said").isNull(), F.pow("seen", F.lit(power)))), "goal")
        s, o = g.agg(F.sum("said"), F.sum("own")).first()
        s, o = s or 0.0, o or 0.0
        left = max(0.0, 1.0 - s) if o else 0.0
        wanted[d] = g.select(d, ((F.coalesce("said", F.lit(0.0)) + F.coalesce("own", F.lit(0.0)) * (left / o if o else 0.0)) / ((s + left) or 1.0)).alias("goal"))
    for _ in range(rounds):
        out = out.withColumn("off", F.lit(0.0))
        for d in dims:
            factors = out.groupBy(d).agg(F.sum("fitted").alias("got")).join(wanted[d], d, "left").select(d, F.when(F.col("got") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("got")).otherwise(1.0).alias("factor"))
            out = out.join(factors, d).select(*dims, "tokens", (F.col("fitted") * F.col("factor")).alias("fitted"), F.greatest("off", F.when(F.col("fitted") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)).alias("off"))
        out = stage(out, "raked")
        if out.agg(F.max("off")).first()[0] < close:
            break
    out = out.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") * float(total) / F.col("tokens")).otherwise(0.0))
    least, most = out.filter("weight > 0").agg(F.min("weight"), F.max("weight")).first()
    # at low no cell is taken whole, at high all are
    low, high, budget = (1 / most) * min(1.0, budget_share) * 0.5, 1 / least, budget_share * total
    while high / low > 1 + 1e-12:
        tried = np.geomspace(low, high, TRIES).tolist()
        got = out.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), f * F.col("weight"))) for f in tried]).first()
        enough = [i for i, x in enumerate(got) if x >= budget]
        if not enough or enough[0] == 0:
            high = tried[0] if enough else tried[-1]
            break
        narrower = (tried[enough[0] - 1], tried[enough[0]])
        if narrower == (low, high):
            break
        low, high = narrower
    return out.withColumn("probability", F.least(F.lit(1.0), high * F.col("weight"))).select(*dims, "weight", "probability")


def cell_probabilities(cells: DataFrame, power: float, budget_share: float, max_cells: int = MAX_CELLS, targets: Targets | None = None) -> tuple[DataFrame, bool]:
    """The three dimensions of cells, weight, probability for each cell, and whether it is small enough to broadcast."""
    spark, dims = cells.sparkSession, tuple(cells.columns[:3])
    said = checked(targets, dims)
    schema = T.StructType([*(T.StructField(d, T.StringType()) for d in dims), T.StructField("weight", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    rows = cells.limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        return rake_frame(cells, power, budget_share, targets), False
    rows.sort(key=lambda r: tuple(r[:3]))
    tokens = np.array([float(r["tokens"]) for r in rows])
    if not tokens.sum():
        return spark.createDataFrame([(*r[:3], 1.0, 1.0) for r in rows], schema), True
    members, wanted = [], []
    for k, d in enumerate(dims):
        place = {v: i for i, v in enumerate(sorted({r[k] for r in rows}))}
        at = np.array([place[r[k]] for r in rows])
        goal = goals(dict(zip(place, np.bincount(at, weights=tokens, minlength=len(place)), strict=True)), power, said.get(d))
        members.append(at)
        wanted.append(np.array([goal.get(v, 0.0) for v in place]))
    weights = rake(tokens, members, wanted)
    p = calibrate(tokens, weights, budget_share * tokens.sum())
    return spark.createDataFrame([(*r[:3], float(w), float(x)) for r, w, x in zip(rows, weights, p, strict=True)], schema), True


def mix(docs: DataFrame, targets: Targets | None = None, power: float = 0.5, budget_share: float = 0.5, seed: int = 11, max_cells: int = MAX_CELLS, dims: tuple[str, str, str] = DIMS, tokens: str = "tokens", names: tuple[str, str, str] = ("weight", "probability", "selected"), narrow: DataFrame | None = None) -> DataFrame:
    """docs with weight, probability and selected (names; columns of docs that are called so are replaced). docs must have tokens and a topic (see describe).

    targets: for a dimension, the share of tokens that each of its values should have (None: the null value); values that it does not name
    share the rest by their own tokens to `power`, as do all values of a dimension without targets. budget_share of all tokens is expected to be
    drawn. Null source, language or topic is a value of its own; documents without words are drawn by their cell's probability like
    others. Rows equal in id, source, language and tokens are drawn or left together. No rows give no rows. narrow: the same rows'
    dims and tokens, where the caller has them without texts.
    """
    checked(targets, dims)
    docs = docs.drop(*names)
    keys = dict(zip(free_names(docs, "_source", "_lang", "_topic"), dims, strict=True))
    keyed, counted = (x.withColumns({k: F.coalesce(F.col(d).cast("string"), F.lit(NULL)) for k, d in keys.items()}) for x in (docs, docs if narrow is None else narrow))
    cells = counted.groupBy(*keys).agg(F.sum(tokens).alias("tokens")).select(*[F.col(k).alias(d) for k, d in keys.items()], "tokens")
    p, small = cell_probabilities(cells, power, budget_share, max_cells, targets)
    p = p.select(*[F.col(d).alias(k) for k, d in keys.items()], F.col("weight").alias(names[0]), F.col("probability").alias(names[1]))
    drawn = keyed.join(F.broadcast(p) if small else p, list(keys))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", dims[0], dims[1], tokens), 11) / F.lit(float(1 << 53))
    return drawn.withColumn(names[2], uniform < F.col(names[1])).drop(*keys)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and selected of every document; half of all tokens is expected to be drawn."""
    rows = stage(vectors(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"]), "vectors")
    docs = stage(with_topic(rows, fit_topics(rows)), "described")
    return mix(docs).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected")
