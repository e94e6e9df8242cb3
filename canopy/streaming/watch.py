"""Live watching: a poller appends change records to a feed, a stream folds the feed into the table of metrics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.functions.paths import WATCHED
from canopy.operators import metrics, watch_state
from canopy.plans.analysis import analyze, measured
from canopy.plans.work import remove, store, work_path
from canopy.sinks.reports import json_report
from canopy.sources.files import LISTED, checked_root, list_files, read_contents

CHANGE = "ts timestamp, path string, exists boolean, size_bytes long, last_modified timestamp"
# fixed values, in milliseconds: how long changes are gathered, how often the tree is looked at
DEBOUNCE_MS, POLL_MS = 100, 500
Report = Callable[[DataFrame, DataFrame], None]


class Poller:
    """Compares a tree with what it was at the last poll; records of changes go to a folder of JSON files in any store, each file at once."""

    def __init__(self, spark: SparkSession, root: str, feed: str) -> None:
        self.spark, self.root, self.feed, self.n = spark, checked_root(root), feed, 0
        at, fs = store(spark, feed)
        fs.mkdirs(at)
        self.seen = self._state()

    def _state(self) -> dict[str, tuple[datetime, int]]:
        return {r["path"]: (r["last_modified"], r["size_bytes"]) for r in list_files(self.spark, self.root, extensions=WATCHED).toLocalIterator()}

    def poll(self) -> int:
        """The number of changed paths."""
        now = self._state()
        changed = [(p, True) for p in now if now[p] != self.seen.get(p)] + [(p, False) for p in self.seen if p not in now]
        self.seen = now
        if changed:
            stamp, lines = datetime.now(UTC).isoformat(), []
            for path, exists in sorted(changed):
                record = {"ts": stamp, "path": path, "exists": exists}
                if exists:
                    record |= {"size_bytes": now[path][1], "last_modified": now[path][0].isoformat()}
                lines.append(json.dumps(record) + "\n")
            part, fs = store(self.spark, f"{self.feed}/_{self.n:08d}.part")  # names that start with _ are not read
            out = fs.create(part, True)
            out.write(bytearray("".join(lines).encode()))
            out.close()
            fs.rename(part, store(self.spark, f"{self.feed}/changes-{time.time_ns()}-{self.n:08d}.json")[0])
            self.n += 1
        return len(changed)


def apply_changes(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, changed rows) after the last change of each path: files that are there are measured anew, gone ones leave, and those that can't be read keep their row."""
    last = watch_state.latest_state(changes, "path", ["ts"], "false")
    there = last.filter("exists").select(F.col("path"), F.col("path").alias("rel_path"), "size_bytes", "last_modified")
    fresh = measured(read_contents(there.select(*[c.split(" ")[0] for c in LISTED.split(", ")])))
    gone = last.filter("NOT exists").join(state, "path", "left_semi")
    return watch_state.upsert(state, fresh, gone), fresh.select("path", F.lit("updated").alias("change")).union(gone.select("path", F.lit("removed").alias("change")))


def states(spark: SparkSession, work: str) -> list[int]:
    """The numbers of the whole states under a folder, in order."""
    at, fs = store(spark, work)
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "state-*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().removeprefix("state-")) for s in done)


def start(spark: SparkSession, initial: DataFrame, feed: str, work: str, report: Report, once: bool = False) -> StreamingQuery:
    """Folds the feed into `initial`. Each batch with a change writes the next state under `work` and calls report(changes, state).

    A batch takes what came in within DEBOUNCE_MS; with once, what is there. States carry their batch's number, and a batch that
    is run again after a failure starts from the state before it, so nothing is folded twice.
    """
    schema = initial.schema
    first = f"{work}/state--1"
    initial.write.mode("ignore").parquet(first)
    def fold(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            before = [s for s in states(spark, work) if s < n]
            state = spark.read.schema(schema).parquet(f"{work}/state-{before[-1]}")
            after, changes = apply_changes(state, batch)
            written = f"{work}/changes-{n}"
            changes.write.mode("overwrite").parquet(written)
            found = spark.read.schema(changes.schema).parquet(written)
            if found.isEmpty():
                return
            after.select(*schema.names).write.mode("overwrite").parquet(f"{work}/state-{n}")
            report(found, spark.read.schema(schema).parquet(f"{work}/state-{n}"))
            for old in before[:-1]:
                remove(spark, f"{work}/state-{old}")
        finally:
            batch.unpersist()

    writer = spark.readStream.schema(CHANGE).json(feed).writeStream.foreachBatch(fold).option("checkpointLocation", f"{work}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds")).start()


def current_state(spark: SparkSession, work: str, schema: object) -> DataFrame:
    """The newest state under a folder of `start`."""
    return spark.read.schema(schema).parquet(f"{work}/state-{states(spark, work)[-1]}")


def watch_tree(spark: SparkSession, root: str, as_json: bool = False, rounds: int | None = None) -> int:
    """Prints a line for each change, or one line of JSON for each batch, until interrupted (or for some polls, in tests)."""

    def report(changes: DataFrame, state: DataFrame) -> None:
        if as_json:
            print("".join(json_report(state, metrics.summary(state), pretty=False)), end="", flush=True)
            return
        for r in changes.orderBy("path").toLocalIterator():
            print(f"{r['change']}: {r['path']}", flush=True)
        s = metrics.summary(state).first()
        print(f"{s['total_files']} files, {s['total_loc']} LOC, {s['total_functions']} functions", flush=True)

    work = work_path(spark, "watch")
    feed = f"{work}/feed"
    poller = Poller(spark, root, feed)
    initial = analyze(spark, root).metrics
    report(spark.createDataFrame([], "path string, change string"), initial)
    query = start(spark, initial, feed, work, report)
    try:
        while query.isActive and (rounds is None or rounds > 0):
            time.sleep(POLL_MS / 1000)
            poller.poll()
            rounds = None if rounds is None else rounds - 1
        if rounds is not None:
            query.processAllAvailable()
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()
    return 0
