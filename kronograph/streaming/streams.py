"""Structured Streaming forms (Z1-Z15): the same expressions as the batch operators, with watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kronograph.sources.shared import Written, remove

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: State lies on the executors' disks, and what is cached of it is bounded for each executor.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4", "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2"}


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = 1) -> DataFrame:
    """Events from Parquet files that arrive in a folder (Z7); the schema is given, the rate limited.

    None takes all files that are there at once: the files of a table that is
    read again aren't in the order of time, and no row is late for its file.
    """
    source = spark.readStream.schema(EVENT_SCHEMA)
    source = source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source
    return source.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and type; windows close when the watermark passes."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by user; a pause of more than the gap ends one."""
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("actions"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("started"), "actions", "value")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once; its state is dropped with the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def novelty(events: DataFrame, least: float = 0.7, expire_ms: int | None = None) -> DataFrame:
    """The first event of each type whose value / 100 reaches a threshold (N1, Z8, Z9); one flag of state for each type.

    expire_ms gives the flag a time to live, for queries that run on; such a
    query never runs out of batches.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.getOption
        best = None
        for pdf in parts:
            good = pdf[pdf["value"] / 100 >= least]
            if len(good):
                row = good.sort_values(["ts", "event_id"]).iloc[0]
                if best is None or (row["ts"], row["event_id"]) < (best["ts"], best["event_id"]):
                    best = row
        if seen is None and best is not None:
            state.update((True,))
            if expire_ms:
                state.setTimeoutDuration(expire_ms)
            yield pd.DataFrame({"event_type": [key[0]], "event_id": [best["event_id"]]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, event_id bigint", "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout)


def cooldown(events: DataFrame, seconds: float = 30.0, late: str = "1 day") -> DataFrame:
    """Events that come at least so long after the last accepted one of their user (Z4); late ones are dropped.

    A user's state goes once the watermark has passed the end of the cooldown.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.getOption
        last = last[0] if last else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])  # one user's events of one micro-batch
        taken = []
        for t, e in zip(rows["ts"], rows["event_id"]):
            at = t.timestamp()
            if last is None or at - last >= seconds:
                last = at
                taken.append(e)
        state.update((last,))
        # the limit may lie behind the watermark already: then the state goes with the next batch
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": [key[0]] * len(taken), "event_id": taken})

    watched = events.withWatermark("at", late).select("user_id", "event_id", "ts", "at")
    return watched.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def matched(left: DataFrame, right: DataFrame, seconds: int, late: str = "1 day") -> DataFrame:
    """(event_id, other): pairs of events of two streams that one user made within a time of each other.

    Both sides have watermarks and the join a time range, so state behind it is dropped.
    """
    a = left.withWatermark("at", late).select("user_id", "event_id", F.col("at").alias("a"))
    b = right.withWatermark("at", late).select(F.col("user_id").alias("user"), F.col("event_id").alias("other"), F.col("at").alias("b"))
    span = F.expr(f"interval {int(seconds)} seconds")
    return a.join(b, (F.col("user_id") == F.col("user")) & (F.col("b") >= F.col("a")) & (F.col("b") <= F.col("a") + span)).select("event_id", "other")


@contextmanager
def started_with(spark: SparkSession, settings: dict[str, str]):
    """Streams started within have these settings, but for what the session sets itself; a stream copies its session's settings as it starts."""
    mine = {k: v for k, v in settings.items() if spark.conf.get(k, None) is None}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def run_available(out: DataFrame, name: str, mode: str, checkpoint: str, expire: bool = True) -> DataFrame:
    """Process all that has arrived, into a Parquet table in the shared folder; no row passes through the driver.

    expire: a last batch without data drops the state that the watermark has
    passed, and appends windows that it has closed. Only what appends windows
    needs it: the state goes with the run.
    """
    spark = out.sparkSession

    def write(path: str) -> None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # is there even if no batch comes
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        with started_with(spark, STATE if expire else STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
            q = ingest(out, path, checkpoint, mode=mode)
        q.awaitTermination()
        remove(spark, checkpoint)

    return Written(out, name, write).read()


def notify(events: DataFrame, send: Callable[[DataFrame], None], checkpoint: str, every: str | None = None):
    """Hand each micro-batch to a sender, in order (Z10, H9); every: a processing interval for loops that run on."""

    def push(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            send(batch.withColumn("batch", F.lit(batch_id)))

    out = events.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def ingest(events: DataFrame, target: str, checkpoint: str, before: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append"):
    """Append micro-batches to a Parquet table, once each (Z7): the batch id is part of the path, so a repeated batch overwrites itself.

    In complete mode each micro-batch holds the whole result, and overwrites the one before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (before(batch) if before else batch).write.mode("overwrite").parquet(f"{target}/batch={'all' if mode == 'complete' else batch_id}")

    return events.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
