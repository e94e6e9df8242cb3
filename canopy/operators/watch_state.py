"""Change feeds as batch relations: debounce, latest state, cache staleness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(changes: DataFrame, window_us: int, key: str = "path") -> DataFrame:
    """key, window_start, n_changes: a window opens at a key's first event and closes window_us later, whatever comes in between; the next event opens the next.

    Each window depends on the one before, so a key's events are walked in order, as runs of sorted rows: the walk streams
    over a partition in batches and holds one open window, however many events a key has.
    """
    kind = changes.schema[key].dataType.simpleString()
    rows = changes.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("key").sortWithinPartitions("key", "us")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, start, n = None, None, 0
        for b in batches:
            out = []
            for k, us in zip(b["key"], b["us"], strict=True):
                if start is None or k != name or us >= start + window_us:
                    if n:
                        out.append((name, start, n))
                    name, start, n = k, us, 0
                n += 1
            yield pd.DataFrame(out, columns=["key", "us", "n"])
        if n:
            yield pd.DataFrame([(name, start, n)], columns=["key", "us", "n"])

    found = rows.mapInPandas(walk, f"key {kind}, us long, n long")
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias("window_start"), F.col("n").alias("n_changes"))


def latest_state(changes: DataFrame, key: str, order: list[str], deleted: str) -> DataFrame:
    """Each key's last row, without the keys whose last row is a deletion. deleted is a SQL condition."""
    others = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("s")).select(key, "s.*")
    return last.filter(f"NOT ({deleted})")


def upsert(state: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """state without the rows of gone or changed, and with those of changed."""
    return state.join(changed.select(key).union(gone.select(key)).distinct(), key, "left_anti").unionByName(changed)


def stale(current: DataFrame, cached: DataFrame) -> DataFrame:
    """path, status (new, removed, changed) of files whose hash differs from the cached one; no rows: the cache is valid."""
    both = current.select("path", F.col("hash").alias("now"), F.lit(True).alias("is")).join(cached.select("path", F.col("hash").alias("then"), F.lit(True).alias("was")), "path", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    return both.select("path", status.alias("status")).filter("status is not null")
