"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def relay(outbox: DataFrame, deliver: Callable[[DataFrame], None], checkpoint: str):
    """Hand each micro-batch to `deliver`, which must be idempotent in the event id; once all that is available."""

    def batch(rows: DataFrame, _: int) -> None:
        deliver(rows.dropDuplicates(["event_id"]))

    return outbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leases(heartbeats: DataFrame, seconds: int) -> DataFrame:
    """(user_id, last, n): an owner's lease when no heartbeat came for `seconds` of event time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last": [last], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for rows in batches:
            if len(rows):
                last, n = max(last, int(rows["ts"].max().timestamp() * 1000)), n + len(rows)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    watched = heartbeats.withWatermark("ts", "0 seconds")
    return watched.groupBy("user_id").applyInPandasWithState(step, "user_id long, last long, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
