"""Unreachable symbols: detection, confidence, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.paths import component_order
from canopy.operators.graph import NoEntryPoints, entry_points, exports, reachable_symbols, unique_symbols

# fixed values
DYNAMIC_WORDS = ("handler", "plugin", "loader", "middleware", "hook")
RECENT_SECONDS = 30 * 24 * 3600
REASON = "Unreachable from entry points"
FUNCTION_KINDS = ("Function", "ArrowFunction", "Method")


def symbol_loc() -> Column:
    return F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)) + 1


def dynamic_name(name: Column) -> Column:
    words = "|".join(DYNAMIC_WORDS)
    return F.lower(name).rlike(f"_(?:{words})$|^(?:{words})_")


def recently_modified(changed: Column, as_of: Column) -> Column:
    age = as_of.cast("double") - changed.cast("double")
    return F.coalesce((age >= 0) & (age < RECENT_SECONDS), F.lit(False))


def confidence(exported: Column, recent: Column, dynamic: Column, tested: Column) -> Column:
    lost = sum((F.when(c, n).otherwise(0) for c, n in ((exported, 30), (recent, 20), (dynamic, 25), (tested, 15))), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost)).cast("int")


def tested_symbols(symbols: DataFrame, file_edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids of candidates whose name is part of a test symbol's name, or that an exported symbol of a test file has an edge to.

    Test names are cut into their parts of the lengths that names have, so that a name meets its parts by equality.
    """
    names = candidates.select("name").distinct()
    lengths = F.array(*[F.lit(r[0]) for r in symbols.select(F.length("name")).distinct().collect() if r[0] is not None]).cast("array<int>")  # as many as names differ in length
    tests = symbols.filter("is_test AND name IS NOT NULL").select("name").distinct().select("name", F.explode(lengths).alias("n")).filter(F.col("n") <= F.length("name"))
    parts = tests.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda at: F.substring("name", at, F.col("n")))).alias("name")).distinct()
    by_name = names.join(parts, "name", "left_semi")
    sources = symbols.filter("is_test AND is_exported").select("path").distinct()
    led = file_edges.join(sources, file_edges["src_path"] == sources["path"], "left_semi").select(F.col("dst_path").alias("path")).distinct()
    return candidates.join(by_name, "name", "left_semi").select("id").union(exports(symbols).join(led, "path", "left_semi").select("id")).distinct()


def dead_symbols(symbols: DataFrame, file_edges: DataFrame, as_of: Column, modified: DataFrame | None = None) -> DataFrame:
    """path, id, symbol, kind, line_start, line_end, loc, confidence, reason of symbols that no entry point reaches. modified(path, last_modified) tells recent files."""
    symbols = unique_symbols(symbols)
    entries = entry_points(symbols)
    if entries.isEmpty():
        if symbols.isEmpty():
            return scored(symbols, symbols.select("id"), as_of, modified)
        raise NoEntryPoints("no entry points")
    dead = symbols.join(reachable_symbols(symbols, file_edges, entries), "id", "left_anti")
    return scored(dead, tested_symbols(symbols, file_edges, dead), as_of, modified)


def scored(dead: DataFrame, tested: DataFrame, as_of: Column, modified: DataFrame | None) -> DataFrame:
    rows = dead.join(tested.select("id", F.lit(True).alias("tested")), "id", "left")
    rows = rows.join(modified.select("path", "last_modified"), "path", "left") if modified is not None else rows.withColumn("last_modified", F.lit(None).cast("timestamp"))
    score = confidence(F.col("is_exported"), recently_modified(F.col("last_modified"), as_of), dynamic_name(F.col("name")), F.coalesce("tested", F.lit(False)))
    return rows.select("path", "id", F.col("name").alias("symbol"), "kind", "line_start", "line_end", symbol_loc().alias("loc"), score.alias("confidence"), F.lit(REASON).alias("reason"))


def by_file(dead: DataFrame) -> DataFrame:
    """path, dead_function_count, dead_code_loc, n_symbols."""
    return dead.groupBy("path").agg(F.count_if(F.col("kind").isin(*FUNCTION_KINDS)).alias("dead_function_count"), F.sum("loc").alias("dead_code_loc"), F.count(F.lit(1)).alias("n_symbols"))


def top_files(dead: DataFrame, n: int = 10) -> DataFrame:
    """The n files of most dead lines, ties by path component."""
    return by_file(dead).orderBy(F.desc("dead_code_loc"), component_order(F.col("path"))).limit(n)


def confident(dead: DataFrame, least: int) -> DataFrame:
    """Symbols at or above a confidence from 0 to 100."""
    if not 0 <= least <= 100:
        raise ValueError("confidence must be from 0 to 100")
    return dead.filter(F.col("confidence") >= least)


def by_confidence(dead: DataFrame) -> DataFrame:
    """Each file's dead symbols with rank, the surest first, ties by line and name. A file is one window."""
    return dead.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("confidence"), "line_start", "line_end", "symbol")).cast("long"))


def share_of_files(dead: DataFrame, files: DataFrame) -> DataFrame:
    """One row: n_files, files_with_dead_code, share (in percent; 0 without files)."""
    n = files.agg(F.count_distinct("path").alias("n_files")).crossJoin(dead.agg(F.count_distinct("path").alias("files_with_dead_code")))  # one row each
    return n.withColumn("share", F.when(F.col("n_files") > 0, F.col("files_with_dead_code") / F.col("n_files") * 100).otherwise(0.0))


def nested_by_file(dead: DataFrame) -> DataFrame:
    """path and its dead symbols as an array, by line."""
    return dead.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_start", "line_end", "symbol", "kind", "loc", "confidence", "reason"))).alias("dead_code"))


def dead_summary(dead: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row. total_files counts files with dead code; nested symbols count in both sums."""
    whole = symbols.agg(F.coalesce(F.sum(symbol_loc()), F.lit(0)).alias("all_loc"))
    part = dead.agg(
        F.count_distinct("path").alias("files_with_dead_code"),
        F.count_if(F.col("kind").isin(*FUNCTION_KINDS)).alias("dead_functions"),
        F.count_if(F.col("kind") == "Class").alias("dead_classes"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_dead_loc"),
    )
    ratio = F.when(F.col("all_loc") > 0, F.col("total_dead_loc") / F.col("all_loc")).otherwise(0.0)
    return part.crossJoin(whole).select(F.col("files_with_dead_code").alias("total_files"), "files_with_dead_code", "dead_functions", "dead_classes", "total_dead_loc", ratio.alias("dead_code_ratio"))  # one row each


def filtered_summary(dead: DataFrame, symbols: DataFrame, min_confidence: int) -> DataFrame:
    """The summary of symbols at or above a confidence; total_files stays, the ratio shrinks with the lines."""
    if not 0 <= min_confidence <= 100:
        raise ValueError("confidence must be from 0 to 100")
    whole = dead_summary(dead, symbols).select("total_files", F.col("total_dead_loc").alias("was"), F.col("dead_code_ratio").alias("ratio"))
    kept = dead_summary(dead.filter(F.col("confidence") >= min_confidence), symbols).drop("total_files", "dead_code_ratio")
    ratio = F.when(F.col("was") > 0, F.col("total_dead_loc") / F.col("was") * F.col("ratio")).otherwise(0.0)
    return kept.crossJoin(whole).select("total_files", "files_with_dead_code", "dead_functions", "dead_classes", "total_dead_loc", ratio.alias("dead_code_ratio"))  # one row each


def tier(score: Column, high: int = 80, medium: int = 60) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def with_dead(metrics: DataFrame, dead: DataFrame) -> DataFrame:
    """Metrics with dead_function_count, dead_code_loc and dead_code_ratio, null for files without dead code."""
    per = by_file(dead).drop("n_symbols")
    return metrics.join(per, "path", "left").withColumn("dead_code_ratio", F.when(F.col("dead_code_loc").isNotNull(), F.when(F.col("loc") > 0, F.col("dead_code_loc") / F.col("loc")).otherwise(0.0)))


def summary_gate(summary: DataFrame, rules: list[str]) -> DataFrame:
    """The summary's row if it goes beyond any rule key=value; keys are dead_code_ratio and dead_functions."""
    out = F.lit(False)
    for rule in rules:
        key, _, value = rule.partition("=")
        if key not in ("dead_code_ratio", "dead_functions") or not value or "=" in value:
            raise ValueError(f"unknown threshold: {rule}")
        out = out | (F.col(key) > (float(value) if key == "dead_code_ratio" else int(value)))
    return summary.filter(out)


def accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, fp_rate, accuracy for found(key) against truth(key, dead)."""
    both = truth.select("key", "dead").join(found.select("key", F.lit(True).alias("said")), "key", "left")
    said, dead = F.coalesce("said", F.lit(False)), F.col("dead")
    c = both.agg(F.count_if(said & dead).alias("tp"), F.count_if(said & ~dead).alias("fp"), F.count_if(~said & dead).alias("fn"))
    return c.select("tp", "fp", "fn", F.when(F.col("tp") + F.col("fp") > 0, F.col("fp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("fp_rate"), F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(1.0).alias("accuracy"))
