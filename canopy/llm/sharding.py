"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt by a hash into blocks. For every block the matrix says how many of its rows go to each cell (a cell is a
piece of a shard); drawn row by row from the multivariate hypergeometric law over what the cells still lack, it has the
distribution that a uniform permutation of all rows would have, and its columns sum to the exact cell sizes. Rows are
permuted in their block by a random key, cut by the block's row of the matrix, exchanged by cell, and permuted again there.
All that moves only fingerprints of the rows; the rows themselves travel once, to meet their shard and slot.

The driver holds block counts and the matrix only, at most `max_matrix` numbers whatever the input's size; the matrix is
what is broadcast. It holds up to max_matrix / 256 shards, more need a larger one. No row is counted twice and nothing is gathered by shard: the largest group is a block or a cell.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import free_name, stage, table

FINE, LEAST_BLOCKS = 16384, 256
#: Equal rows are numbered in runs of so many.
COPIES = 1 << 16
CHUNK = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Draws of n from good and bad without replacement: how many are good. Beyond numpy's limit of 1e9 by rejection from a table mountain hat."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total, low, high = good + bad, max(0, n - bad), min(good, n)
    log = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))
    mode = min(high, max(low, (good + 1) * (n + 1) // (total + 2)))
    spread = math.sqrt(max(1.0, n * (good / total) * (bad / total) * (total - n) / (total - 1)))
    top, wide = log(mode), 2.6 * spread + 1
    while True:  # ratio of uniforms: v/u lies within the hat's width
        u, v = rng.random(), rng.uniform(-wide, wide)
        k = math.floor(mode + 0.5 + v / u) if u else -1
        if low <= k <= high and 2 * math.log(u) <= log(k) - top:
            return k


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform permutation of all rows would give them."""
    rng, lacks, small = np.random.default_rng(seed), np.array(columns, dtype=np.int64), sum(columns) < 1_000_000_000
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, n in enumerate(rows):
        if small:
            out[i] = rng.multivariate_hypergeometric(lacks, n, method="marginals")
        else:
            left, rest = n, int(lacks.sum())
            for j, c in enumerate(lacks.tolist()):
                rest -= c
                out[i, j] = hypergeometric(rng, c, rest, left) if left and c else 0
                left -= int(out[i, j])
        lacks -= out[i]
    return out


def matrix_size(total: int, n_shards: int, rows_per_block: int, rows_per_cell: int, max_matrix: int) -> tuple[int, int]:
    """(cells, blocks), whose product is max_matrix at most: pieces of a shard as long as LEAST_BLOCKS blocks fit, then as many blocks as do."""
    parts = max(1, min(256, max(16, -(-total // (n_shards * rows_per_cell))), max_matrix // (LEAST_BLOCKS * n_shards)))
    return n_shards * parts, min(FINE, 1 << max(8, (total // rows_per_block).bit_length()), 1 << ((max_matrix // (n_shards * parts)).bit_length() - 1))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 20, rows_per_block: int = 256, rows_per_cell: int = 512, max_matrix: int = 8_000_000) -> DataFrame:
    """docs with `shard` (0 to n_shards - 1; counts at most one apart) and `slot` (gapless from 0 in each shard), shuffled uniformly.

    Columns of docs named shard or slot are replaced. Null ids and texts are values like others; rows that are equal in
    all columns are interchangeable, each gets its own shard and slot; no rows give no rows. Everything follows from the
    rows' values, so a lost task recomputes to the same. Rows are told apart by 128 bits of hash over all columns.
    """
    if n_shards < 1 or n_shards * LEAST_BLOCKS > max_matrix:
        raise ValueError(f"{n_shards} shards need a max_matrix of {n_shards * LEAST_BLOCKS} at least")
    docs = docs.drop("shard", "slot")
    spark = docs.sparkSession
    high, low, h, l, one = (free_name(docs, f"_{x}") for x in ("high", "low", "h", "l", "one"))
    # hashes skip nulls, so which columns are null is hashed as well
    every = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    marked = docs.withColumns({high: F.xxhash64(F.lit(seed), *every), low: F.xxhash64(F.lit(seed + 1), *every)})
    fine, copy, rank, cell, key = "_fine", "_copy", "_rank", "_cell", "_key"
    # equal rows are counted before the shuffle, then dealt one by one
    distinct = marked.groupBy(F.col(high).alias("_high"), F.col(low).alias("_low")).agg(F.count("*").alias("_n"))
    dealt = stage(distinct, "rows").withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(COPIES).cast("long"))))
    dealt = dealt.select("_high", "_low", (F.col("_n") > 1).alias("_many"), F.explode(F.sequence("_from", F.least("_n", F.col("_from") + COPIES - 1))).alias(copy))
    dealt = dealt.withColumn(fine, F.pmod(F.xxhash64(F.lit(seed + 2), "_high", "_low", copy), F.lit(FINE)).cast("int"))
    counts, many = [0] * FINE, False
    for r in dealt.groupBy(fine).agg(F.count("*"), F.max("_many")).collect():  # FINE rows at most
        counts[r[0]], many = r[1], many or r[2]
    total = sum(counts)
    if not total:
        return docs.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    n_cells, n_blocks = matrix_size(total, n_shards, rows_per_block, rows_per_cell, max_matrix)
    parts = n_cells // n_shards
    per = FINE // n_blocks
    rows = [sum(counts[i * per : (i + 1) * per]) for i in range(n_blocks)]
    size = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(rows, [size[s] // parts + (q < size[s] % parts) for s in range(n_shards) for q in range(parts)], seed)

    starts = np.cumsum(matrix, axis=1) - matrix
    cuts = spark.createDataFrame(
        [(b, [x[k : k + CHUNK] for k in range(0, n_cells, CHUNK)]) for b, x in enumerate(starts.tolist())],
        T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.ArrayType(T.LongType())))]),
    ).withColumn("_firsts", F.transform("_cuts", lambda x: x[0]))
    block, order = F.floor(F.col(fine) / per).cast("int"), [key, "_high", "_low", copy]
    local = dealt.withColumn(fine, block).withColumn(key, F.xxhash64(F.lit(seed + 3), "_low", "_high", copy))
    local = local.withColumn(rank, F.row_number().over(Window.partitionBy(fine).orderBy(*order)).cast("long") - 1)
    # the last cell that starts at or before the rank; empty cells share their start with the next one
    chunk = F.size(F.filter("_firsts", lambda c: c <= F.col(rank))) - 1
    sent = local.join(F.broadcast(cuts), F.col(fine) == F.col("_block")).withColumn(cell, chunk)
    sent = sent.withColumn(cell, F.col(cell) * CHUNK + F.size(F.filter(F.col("_cuts")[F.col(cell)], lambda c: c <= F.col(rank))) - 1).drop("_block", "_cuts", "_firsts")
    again = F.row_number().over(Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed + 4), F.col(key)), *order)).cast("long") - 1
    s, q = F.floor(F.col(cell) / parts).cast("int"), F.col(cell) % parts
    held = F.lit(total // n_shards) + (s < F.lit(total % n_shards)).cast("long")
    before = q * F.floor(held / parts) + F.least(q, held % parts)
    placed = sent.withColumn(rank, again).select(F.col("_high").alias(h), F.col("_low").alias(l), (~F.col("_many")).alias(one), s.alias("shard"), (before + F.col(rank)).cast("long").alias("slot"))

    def met(rows: DataFrame, places: DataFrame) -> DataFrame:
        return rows.join(places, (rows[high] == places[h]) & (rows[low] == places[l])).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")

    out = met(marked, placed.filter(one).hint("shuffle_hash"))
    if many:  # one of each kind of equal rows meets the places of all its copies; a hot kind is split by adaptive execution
        again_seen = dealt.filter("_many").select(F.col("_high").alias(high), F.col("_low").alias(low)).distinct()
        kinds = stage(marked.join(again_seen, [high, low], "left_semi").dropDuplicates([high, low]), "kinds")
        out = out.unionByName(met(kinds, placed.filter(~F.col(one))))
    return out


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document in 40 shards, under the law that counts are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard(narrow).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
