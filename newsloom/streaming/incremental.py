"""Incremental work on streams of files, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.sources.sinks import appended_once


def drain(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str, target: str, checkpoint: str, files: int = 100) -> None:
    """Work off every file of a folder that no earlier run has seen, batch by batch, then stop.

    ``work`` maps a batch to the rows to write. Keys that the target holds are not written again, so a
    batch repeated after a loss adds nothing: each row counts once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        appended_once(work(df), target, key)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums by fixed windows and type; with ``late`` rows older than the watermark are dropped in a stream."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "events", "total"
    )


def sliding(events: DataFrame, size: str = "5 days", step: str = "1 day") -> DataFrame:
    """Counts by overlapping windows."""
    return events.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Sessions of each user: events not further apart than the gap."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")


class TokenBucket(StatefulProcessor):
    """Token bucket per key over a stream: state is the time of the last request and the tokens left."""

    def __init__(self, rate: float, capacity: float):
        self.rate, self.capacity = rate, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "last long, tokens double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last, tokens = self.state.get() if self.state.exists() else (None, self.capacity)
        for part in rows:
            part = part.sort_values(["t", "id"])
            ok = []
            for t in part["t"]:
                if last is not None:
                    tokens = min(self.capacity, tokens + max(0, t - last) / 1e6 * self.rate)
                last = t if last is None else max(last, t)
                ok.append(tokens >= 1)
                tokens -= 1 if tokens >= 1 else 0
            yield pd.DataFrame({"key": key[0], "id": part["id"], "allowed": ok})
        self.state.update((int(last or 0), float(tokens)))

    def close(self) -> None:
        pass


def limited(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """A stream of requests (key, id, t in microseconds) through a token bucket for each key."""
    return requests.groupBy("key").transformWithStateInPandas(TokenBucket(rate, capacity), "key string, id long, allowed boolean", "Append", "none")
