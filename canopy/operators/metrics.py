"""Per-file metrics, summaries, top-k and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.loc import loc_by_language
from canopy.functions.paths import component_order, language
from canopy.functions.scalars import complexity

BASELINE_LIMIT = 10.0


def file_metrics(files: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """path, language, loc, size_bytes, function_count, complexity, last_modified of files(path, content[, function_count][, last_modified]). Files of no known language stay with a null language."""
    count = F.col("function_count") if "function_count" in files.columns else F.lit(0)
    changed = F.col("last_modified") if "last_modified" in files.columns else F.lit(None).cast("timestamp")
    lang = language(F.col("path"))
    rows = files.select("path", lang.alias("language"), loc_by_language(F.col("content"), lang).alias("loc"), F.octet_length("content").cast("long").alias("size_bytes"), count.cast("long").alias("function_count"), (F.coalesce(changed, run_ts) if run_ts is not None else changed).alias("last_modified"))
    return rows.withColumn("complexity", complexity(F.col("loc")))


def summary(metrics: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return metrics.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("loc"), zero).alias("total_loc"), F.coalesce(F.sum("function_count"), zero).alias("total_functions"))


def largest_files(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n files of most lines, ties by path component. One sort of n rows a task, then of n."""
    return metrics.orderBy(F.desc("loc"), component_order(F.col("path"))).limit(n)


def ranked(rows: DataFrame) -> DataFrame:
    """rank from 1 for a report's few rows, which largest_files and its like have bounded."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("loc"), component_order(F.col("path")))))


def threshold_violations(metrics: DataFrame, rules: list[str]) -> DataFrame:
    """Files beyond any rule key=value; keys are loc and dead_code_ratio (missing: 0)."""
    out = F.lit(False)
    for rule in rules:
        parts = rule.split("=")
        if len(parts) != 2:
            raise ValueError(f"threshold must be key=value: {rule}")
        key, value = parts
        if key == "loc":
            out = out | (F.col("loc") > int(value))
        elif key == "dead_code_ratio":
            out = out | (F.coalesce(F.col("dead_code_ratio"), F.lit(0.0)) > float(value))
        else:
            raise ValueError(f"unknown threshold: {key}")
    return metrics.filter(out)


def baseline_gate(current: DataFrame, base: DataFrame, limit: float = BASELINE_LIMIT) -> DataFrame:
    """One row: base_loc, current_loc, change_pct (0 if the base has none), failed. Both inputs are one-row summaries."""
    pair = current.select(F.col("total_loc").alias("current_loc")).crossJoin(base.select(F.col("total_loc").alias("base_loc")))  # one row each
    pct = F.when(F.col("base_loc") == 0, 0.0).otherwise((F.col("current_loc") - F.col("base_loc")) / F.col("base_loc") * 100)
    return pair.withColumn("change_pct", pct).withColumn("failed", F.col("change_pct") > limit)
