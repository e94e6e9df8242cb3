"""Cutting lineage in iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder that is then set, if driver and tasks are one process (tests); an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='canopy-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, whatever store Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove(spark: SparkSession, path: str) -> None:
    at, fs = store(spark, path)
    fs.delete(at, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. One application's paths lie together and are removed when its driver ends."""
    home = f"{shared_dir(spark)}/canopy-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        at, fs = store(spark, home)

        def sweep() -> None:
            try:
                fs.delete(at, True)
            except Exception:  # the JVM is gone: what is left waits for the folder's owner
                return

        atexit.register(sweep)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder as Parquet and read back: a lost executor loses nothing. A plan is computed once for it, which a checkpoint of an uncached plan is not."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
