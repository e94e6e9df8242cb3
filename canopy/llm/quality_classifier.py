"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network with calibrated probabilities.

Each token has a fixed sparse random index vector, drawn from a hash of it; a word's vector is its own index vector plus
those of its neighbours over the training texts. A document is the weighted mean of its words' vectors. A small numpy network
(one hidden layer, one output) is trained on it, and a temperature fitted on held-back training rows makes its
probabilities calibrated. Training is on the driver over a bounded sample of labelled rows; scoring reads whole texts,
row by row, and shuffles nothing.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import free_name, stage, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: What training takes, at most: labelled rows, words that get a vector of their own (others count by their form), characters of all rows.
MAX_LABELLED, MAX_WORDS, MAX_CHARS = 3000, 20_000, 1 << 26
DIM, NONZERO, REACH, HIDDEN = 64, 6, 2, 24
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words beyond the vocabulary count by their form; a repeated neighbour counts as a word of its own.
FORMS = ("<caps>", "<title>", "<lower>", "<digits>", "<mixed>", "<marks>", "<repeat>")


def form(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 5
    return 0 if token.isupper() and len(token) > 1 else 3 if token.isdigit() else 2 if token.islower() else 1 if token[:1].isupper() and token[1:].islower() else 4


class Vocabulary(dict):
    """Token to number; others by their form. What it learns of others is forgotten when it grows too large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            for t in [t for t, i in self.items() if i < len(FORMS)]:
                del self[t]
        self[token] = form(token)
        return self[token]


@dataclass
class Model:
    words: list[str]
    vectors: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(zip(self.words, range(len(FORMS), len(FORMS) + len(self.words)), strict=True))


def index_vectors(tokens: list[str]) -> np.ndarray:
    out = np.zeros((len(tokens), DIM), dtype=np.float32)
    for i, t in enumerate(tokens):
        r = np.random.default_rng([zlib.crc32(t.encode()), len(t)])
        out[i, r.choice(DIM, NONZERO, replace=False)] = r.choice((-1.0, 1.0), NONZERO)
    return out


def pool(text: str | None, vocabulary: Vocabulary, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean of the words' vectors, and the logarithm of their number; zeros for a text without words. In pieces, so that memory stays bounded."""
    out, mass, n = np.zeros(DIM + 2), 1e-9, 0
    tokens = (m.group() for m in TOKEN.finditer(text)) if len(text or "") > 1 << 18 else iter(TOKEN.findall(text or ""))
    while part := list(islice(tokens, 50_000)):
        ids = np.fromiter(map(vocabulary.__getitem__, part), dtype=np.int64, count=len(part))
        w = weight[ids]
        out[:DIM] += w @ vectors[ids]
        again = sum(map(eq, part, part[1:])) * weight[6]
        out[:DIM] += again * vectors[6]
        out[DIM] += again
        mass += w.sum() + again
        n += len(part)
    out /= mass
    out[DIM + 1] = np.log1p(n)
    return out


def forward(model: Model, x: np.ndarray) -> np.ndarray:
    a, b, c, d = model.layers
    z = np.tanh((x - model.mean) / model.spread @ a + b) @ c + d
    return 1 / (1 + np.exp(-np.clip(z / model.temperature, -50, 50)))


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = 60, max_words: int = MAX_WORDS) -> Model:
    """A model from labelled texts; without both labels every score is the share of ones."""
    rows = [TOKEN.findall(t or "") for t in texts]
    counts = Counter(t for r in rows for t in r)
    words = sorted((t for t, n in counts.items() if n >= 3), key=lambda t: (-counts[t], t))[:max_words]
    vocabulary = Vocabulary(zip(words, range(len(FORMS), len(FORMS) + len(words)), strict=True))
    index = index_vectors([*FORMS, *words])
    vectors, seen = index * 2, np.ones(len(index))
    for r in rows:
        ids = np.fromiter(map(vocabulary.__getitem__, r), dtype=np.int64, count=len(r))
        np.add.at(seen, ids, 1)
        for d in range(1, REACH + 1):
            for k in range(0, max(0, len(ids) - d), 50_000):
                left, right = ids[k : k + 50_000], ids[k + d : k + d + 50_000]
                np.add.at(vectors, left[: len(right)], index[right])
                np.add.at(vectors, right, index[left[: len(right)]])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    weight = 1e-3 / (1e-3 + seen / seen.sum())
    weight[: len(FORMS)] = 1
    x, y = np.array([pool(t, vocabulary, vectors, weight) for t in texts]).reshape(len(texts), DIM + 2), np.array(labels, dtype=float)
    rng = np.random.default_rng(seed)
    model = Model(words, vectors.astype(np.float32), weight, np.zeros(DIM + 2), np.ones(DIM + 2), (np.zeros((DIM + 2, 1)), np.zeros(1), np.zeros(1), 0.0), 1.0)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        model.layers = (*model.layers[:3], float(np.log(share / (1 - share))))
        return model
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    model.mean, model.spread = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - model.mean) / model.spread
    p = [rng.normal(0, 1 / np.sqrt(DIM), (DIM + 2, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            h = np.tanh(z[batch] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[batch]) / len(batch)
            back = np.outer(e, p[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((z[batch].T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], e.sum())):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model.layers = (p[0], p[1], p[2], float(p[3]))
    if len(held):
        raw = np.tanh(z[held] @ p[0] + p[1]) @ p[2] + p[3]
        loss = lambda k: float(np.mean(np.logaddexp(0, -raw * (2 * y[held] - 1) / k)))
        model.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Model:
    """Trains on at most max_labelled labelled rows that are not held out, of max_chars characters in all, the same ones each time.

    Rows with a null id, label or text are left out; of rows that share an id the one with the least text hash is taken. No rows give a
    model whose scores are one half.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull())  # max_labelled rows at most
    one = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    found = stage(one, "labelled")
    sizes = sorted(tuple(r) for r in found.select(F.xxhash64("doc_id"), "doc_id", "quality", F.length("text")).collect())
    used, left = [], max_chars
    for _, i, y, n in sizes:
        if n <= left:
            used, left = [*used, (i, y)], left - n
    taken = found if len(used) == len(sizes) else found.join(F.broadcast(docs.sparkSession.createDataFrame(used, found.select("doc_id", "quality").schema)), ["doc_id", "quality"])
    rows = sorted(((r["doc_id"], int(r["quality"]), r["text"]) for r in taken.collect()), key=lambda r: (r[0], r[1]))
    return train([r[2] for r in rows], [r[1] for r in rows], max_words=max_words)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns keep of docs (default: doc_id) with a score of the whole text. Null and empty texts score as a document without words; equal texts score alike. No rows give no rows."""
    from pyspark.sql import types as T

    keep = ["doc_id"] if keep is None else keep
    text = free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.vocabulary()
        for b in batches:
            # one text at a time becomes a string; what is kept stays as Arrow has it
            x = np.array([pool(t.as_py(), vocabulary, model.vectors, model.weight) for t in b.column(len(keep))]).reshape(len(b), DIM + 2)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(forward(model, x))], [*keep, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
