"""The engine's entry points on a source tree: metrics, dead code, their cache."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import deadcode, metrics, watch_state
from canopy.operators.graph import resolve_imports, unique_symbols
from canopy.operators.parse import imports, parse_files, symbols
from canopy.plans.work import cut
from canopy.sources.files import list_files, read_contents

DEAD_EXCLUDES = ("node_modules/**", "dist/**", "build/**", ".git/**")
DEFAULT_CACHE = os.path.join(".canopy", "cache")
CACHE_VERSION = 1
Progress = Callable[[float, str], None]


def quiet(share: float, what: str) -> None:
    """The progress callback that does nothing."""


def measured(files: DataFrame) -> DataFrame:
    """Metrics of files(path, content, last_modified), with parsed function counts; files of unknown languages are left out."""
    return metrics.file_metrics(parse_files(files, keep=("content", "last_modified")))


@dataclass
class Analysis:
    metrics: DataFrame
    summary: DataFrame


def analyze(spark: SparkSession, root: str, exclude: list[str] | None = None, dead: bool = False, progress: Progress = quiet) -> Analysis:
    """File metrics of a tree, read once and written to the shared folder, and their summary; with `dead`, the columns on dead code too."""
    progress(0.1, "listing")
    listing = list_files(spark, root, exclude)
    progress(0.2, "reading")
    found = cut(measured(read_contents(listing)))
    progress(0.9, "summary")
    if dead:
        found = cut(deadcode.with_dead(found, dead_code(spark, root, exclude).dead))
    progress(1.0, "analysis_complete")
    return Analysis(found, metrics.summary(found))


@dataclass
class DeadCode:
    dead: DataFrame
    symbols: DataFrame
    summary: DataFrame


def dead_from_parsed(parsed: DataFrame, as_of: object | None = None, modified: DataFrame | None = None) -> DeadCode:
    """Dead symbols of parse_files's rows, which must be a written table."""
    found = unique_symbols(symbols(parsed))
    resolved = resolve_imports(imports(parsed), parsed.select("path")).filter("resolved is not null")
    edges = cut(resolved.select(F.col("path").alias("src_path"), F.col("resolved").alias("dst_path")).distinct())
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    dead = cut(deadcode.dead_symbols(found, edges, now, modified))
    return DeadCode(dead, found, deadcode.dead_summary(dead, found))


def dead_code(spark: SparkSession, root: str, exclude: list[str] | None = None, cache_dir: str | None = None, as_of: object | None = None, modified: DataFrame | None = None) -> DeadCode:
    """Symbols of a tree's scripts that no entry point reaches. A file that can't be read is an error here.

    With cache_dir, only files whose time differs from the cached one are parsed. `modified` replaces the files' own times.
    """
    listing = list_files(spark, root, list(DEAD_EXCLUDES) if exclude is None else exclude).filter(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx)$"))
    parsed = parse_tree(listing, cache_dir) if cache_dir else cut(parse_files(read_contents(listing, on_error="fail")))
    return dead_from_parsed(parsed, as_of, listing.select("path", "last_modified") if modified is None else modified)


def _hash(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.unix_seconds("last_modified").alias("hash"))


def cached(spark: SparkSession, cache_dir: str) -> DataFrame | None:
    """The newest whole cached table; None without one. Broken ones and those of other versions are removed. The folder is one that driver and executors share."""
    if not os.path.isdir(cache_dir):
        return None
    for name in sorted((n for n in os.listdir(cache_dir) if n.startswith("parsed-")), reverse=True):
        path = os.path.join(cache_dir, name)
        try:
            if not os.path.exists(os.path.join(path, "_SUCCESS")):
                raise ValueError("not whole")
            rows = spark.read.parquet(f"file://{os.path.abspath(path)}")
            if rows.filter(F.col("version") != CACHE_VERSION).limit(1).count():
                raise ValueError("another version")
            return rows.drop("version")
        except Exception:  # whatever a broken file raises: it is rebuilt
            shutil.rmtree(path, ignore_errors=True)
    return None


def save(parsed: DataFrame, cache_dir: str) -> DataFrame:
    """parsed(.., hash), written as the newest table of the cache; older ones go."""
    old = [n for n in (os.listdir(cache_dir) if os.path.isdir(cache_dir) else []) if n.startswith("parsed-")]
    at = max((int(n.split("-")[1]) for n in old), default=0) + 1
    path = os.path.join(os.path.abspath(cache_dir), f"parsed-{at:08d}-{uuid.uuid4().hex}")
    parsed.withColumn("version", F.lit(CACHE_VERSION)).write.parquet(f"file://{path}")
    for n in old:
        shutil.rmtree(os.path.join(cache_dir, n), ignore_errors=True)
    return parsed.sparkSession.read.parquet(f"file://{path}").drop("version")


def parse_tree(listing: DataFrame, cache_dir: str) -> DataFrame:
    """parse_files of a listing through the cache: every listed file is hashed, stale ones are parsed anew, and gone ones dropped."""
    spark = listing.sparkSession
    before = cached(spark, cache_dir)
    if before is None:
        rows = parse_files(read_contents(listing, on_error="fail"), keep=("last_modified",))
        return save(rows.withColumn("hash", F.unix_seconds("last_modified")).drop("last_modified"), cache_dir)
    stale = cut(watch_state.stale(_hash(listing), before.select("path", "hash")))
    if stale.isEmpty():
        return before
    anew = listing.join(stale.filter("status <> 'removed'"), "path", "left_semi")
    rows = parse_files(read_contents(anew.select(*listing.columns), on_error="fail"), keep=("last_modified",))
    rows = rows.withColumn("hash", F.unix_seconds("last_modified")).drop("last_modified")
    return save(watch_state.upsert(before, cut(rows), stale.filter("status = 'removed'")), cache_dir)


__all__ = ["analyze", "dead_code", "dead_from_parsed", "parse_tree"]
