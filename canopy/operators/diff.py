"""Comparison of two reports by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_loc, new_loc, status (added, deleted, modified) of paths whose loc differs or that are on one side only."""
    both = old.select("path", F.col("loc").alias("old_loc"), F.lit(True).alias("was")).join(new.select("path", F.col("loc").alias("new_loc"), F.lit(True).alias("now")), "path", "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~F.col("old_loc").eqNullSafe(F.col("new_loc")), "modified")
    return both.select("path", "old_loc", "new_loc", status.alias("status")).filter("status is not null")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: counts by status, total_delta, and the modified file that grew most (ties: the smallest path; none if none grew)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    delta = F.coalesce("new_loc", F.lit(0)) - F.coalesce("old_loc", F.lit(0))
    grown = F.when((F.col("status") == "modified") & (delta > 0), F.struct((-delta).alias("less"), F.col("path")))
    out = diff.agg(count("added"), count("deleted"), count("modified"), F.coalesce(F.sum(delta), F.lit(0)).alias("total_delta"), F.min(grown).alias("g"))
    return out.select("added", "deleted", "modified", "total_delta", F.col("g.path").alias("largest_growth_path"), (-F.col("g.less")).alias("largest_growth"))
