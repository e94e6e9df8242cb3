"""Saved reports, the configuration file and commit histories as inputs."""

from __future__ import annotations

import os
import subprocess
import tomllib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, language string, loc long, size_bytes long, function_count long, last_modified string, dead_function_count long, dead_code_loc long, dead_code_ratio double"
REPORT = f"summary struct<total_files:long,total_loc:long,total_functions:long,largest_files:array<string>>, files array<struct<{FILE.replace(' ', ':').replace(',:', ',')}>>, timestamp string"
CONFIG_NAME = ".canopy.toml"
CONFIG_TEMPLATE = """# What `python -m canopy` takes when an option is not given. Take the # off a line to set it.

[analysis]
# globs below the root that are passed over
# exclude = ["vendor/**", "**/*.min.js"]

[output]
# one of: text, json, csv
# format = "json"

[cache]
# whether parsed files are kept between runs
# enabled = false
"""
MAX_COMMITS = 100


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The files of a saved JSON report, one row each; ValueError if it is none."""
    whole = spark.read.schema(f"{REPORT}, broken string").option("columnNameOfCorruptRecord", "broken").json(path, multiLine=True).cache()
    try:
        if whole.filter("broken is not null or summary is null").limit(1).count():
            raise ValueError(f"not a report: {path}")
    finally:
        whole.unpersist()
    return whole.select(F.explode("files").alias("f")).select("f.*")


def read_config(folder: str) -> dict:
    """The configuration of a folder; empty without one. A broken one raises ValueError."""
    try:
        with open(os.path.join(folder, CONFIG_NAME), "rb") as f:
            return tomllib.load(f)
    except FileNotFoundError:
        return {}


def init_config(folder: str) -> str:
    """Writes the template; FileExistsError if there is a configuration."""
    path = os.path.join(folder, CONFIG_NAME)
    with open(path, "x", encoding="utf-8") as f:
        f.write(CONFIG_TEMPLATE)
    return path


def commits(spark: SparkSession, repo: str, limit: int | None = None) -> DataFrame:
    """sha, author, timestamp (seconds), message of a repository's history, newest first."""
    args = ["git", "-C", repo, "log", "--format=%H%x1f%an%x1f%ct%x1f%B%x1e"] + ([f"--max-count={limit}"] if limit is not None else [])
    done = subprocess.run(args, capture_output=True, text=True, check=True)
    rows = [r.strip("\n").split("\x1f", 3) for r in done.stdout.split("\x1e") if r.strip("\n")]
    return spark.createDataFrame([(a, b, int(c), d.rstrip("\n")) for a, b, c, d in rows], "sha string, author string, timestamp long, message string")


def committed_times(spark: SparkSession, repo: str) -> DataFrame:
    """path, last_modified of files in the newest commit: its time, since the newest of the last commits whose tree holds a file is looked for."""
    head = subprocess.run(["git", "-C", repo, "log", f"--max-count={MAX_COMMITS}", "--format=%H %ct"], capture_output=True, text=True, check=True).stdout.split("\n")
    seen: dict[str, datetime] = {}
    for line in filter(None, head):
        sha, at = line.split(" ")
        tree = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-z", "--name-only", sha], capture_output=True, text=True, check=True).stdout
        for name in filter(None, tree.split("\0")):
            seen.setdefault(os.path.join(repo, name), datetime.fromtimestamp(int(at), UTC))
    return spark.createDataFrame(list(seen.items()), "path string, last_modified timestamp")
