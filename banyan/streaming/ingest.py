"""Incremental ingest: dedupe, quotas, flushes and logs as streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as X
from ..sources.sinks import add_snapshot, committed, compact_snapshot
from ..sources.storage import exists, folders, fresh, is_folder

Batches = Iterator[pd.DataFrame]


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """path: a folder of files, or a file, which its folder's stream picks by name."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = path.rstrip("/")
    if is_folder(spark, path):
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", name)).parquet(folder)


def deduped(stream: DataFrame, key: str, event_time: str | None = None, horizon: str = "1 day") -> DataFrame:
    """The first row of each key; with event_time, keys are forgotten after the horizon."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, write_batch, checkpoint: str) -> None:
    """Hands all that is there to write_batch(frame, number) in micro-batches, then stops."""
    stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: The state store that keyed state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Quota(StatefulProcessor):
    """Of each key the first n rows that ever come, in the order of columns within a batch. Its state is one number a key, which lives for ttl_ms after its last change, or for ever."""

    def __init__(self, n: int, order: list[str], ttl_ms: int | None = None):
        self.n, self.order, self.ttl_ms = n, order, ttl_ms

    def init(self, handle) -> None:
        self.used = handle.getValueState("used", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Batches:  # noqa: ARG002, N803
        used = self.used.get()[0] if self.used.exists() else 0
        room = self.n - used
        best = None
        for frame in rows:
            # no more than the quota and a frame are held, however many rows a key has
            best = first_rows(frame if best is None else pd.concat([best, frame]), self.order, room) if room > 0 else None
        if best is not None and len(best):
            self.used.update((used + len(best),))
            yield best

    def close(self) -> None:
        pass


def first_rows(frame: pd.DataFrame, order: list[str], n: int) -> pd.DataFrame:
    return frame.sort_values(order, kind="stable").head(n)


def within_quota(stream: DataFrame, key: str, order: list[str], n: int, ttl_ms: int | None = None) -> DataFrame:
    """Rows of a stream that fit in the quota of their key.

    A task passes on n rows of a key at most, the first in order, before keys
    meet: a key with a third of all rows brings few to its own task.
    """

    def limit(frames: Batches) -> Batches:
        best = None
        for frame in frames:
            both = (frame if best is None else pd.concat([best, frame])).sort_values(order, kind="stable")
            best = both.groupby(key, dropna=False, sort=False).head(n)
        if best is not None:
            yield best

    few = stream.mapInPandas(limit, stream.schema)
    return few.groupBy(key).transformWithStateInPandas(Quota(n, order, ttl_ms), stream.schema, "Append", "ProcessingTime" if ttl_ms else "None")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, key: str, topic: str, n: int, event_time: str | None = None, horizon: str = "1 day", files: int = 1000, ttl_ms: int | None = None) -> dict:
    """Files of path to a Parquet table: each key once over all batches and restarts, at most n rows a topic; returns how many numbers each state has.

    Without event_time the state holds every key that was ever seen; with it,
    keys are forgotten once they are older than the horizon.  A topic's state is
    the number of rows that it has had; it lives for ttl_ms after the last of
    them, or for ever.  The table's files belong to batches as its log names
    them, so a batch that runs again after a failure adds nothing twice.
    """
    kept = within_quota(deduped(file_stream(spark, path, files), key, event_time, horizon), topic, [key], n, ttl_ms)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        run = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    run.awaitTermination()
    last = next((p for p in reversed(run.recentProgress) if p.stateOperators), None)
    return {o.operatorName: o.numRowsTotal for o in last.stateOperators} if last else {}


def stream_quota_counts(spark: SparkSession, path: str, key: str, topic: str, n: int, event_time: str | None = None, horizon: str = "1 day") -> DataFrame:
    base = fresh(spark, "banyan-stream")
    ingest(spark, path, f"{base}/out", f"{base}/checkpoint", key, topic, n, event_time, horizon)
    return spark.read.parquet(f"{base}/out").groupBy(topic).agg(F.count("*").alias("kept"))


def snapshots(stream: DataFrame, out: str, checkpoint: str, rows: int = 40, most: int = 64) -> None:
    """All rows so far as CSV and JSON lines in out/snapshot, which grow by files of the new ones once so many are new, and at the end.

    Each row is written once, and once more when files, more than most, are put
    together at the end.  A batch that runs again replaces what it wrote, and
    files of a flush are added once.
    """
    spark = stream.sparkSession
    state = {"new": 0, "batches": []}

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        state["batches"].append(number)
        state["new"] += s.read.schema(batch.schema).parquet(f"{out}/rows/batch={number}").count()
        if state["new"] >= rows:
            flush(s, batch.schema)

    def flush(s: SparkSession, schema) -> None:
        new = s.read.schema(schema).parquet(*[f"{out}/rows/batch={k}" for k in state["batches"]])
        add_snapshot(new, f"{out}/snapshot", max(state["batches"]))
        state.update(new=0, batches=[])

    # batches that a run before wrote and didn't flush
    if exists(spark, f"{out}/rows"):
        done = committed(spark, f"{out}/snapshot/json")
        state["batches"] = [k for k in folders(spark, f"{out}/rows", "batch=") if k > max(done, default=-1)]
        state["new"] = rows if state["batches"] else 0
    drain(stream, write, checkpoint)
    if state["batches"]:
        flush(spark, stream.schema)
    compact_snapshot(spark, f"{out}/snapshot", stream.schema, most)


def log_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends decisions, with the time, to JSON lines."""
    stamped = stream.withColumn("timestamp", X.utc_now())
    stamped.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
