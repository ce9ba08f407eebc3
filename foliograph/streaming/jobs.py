"""Continuous work: files as they come, counters, event-time windows, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 50, kind: str = "parquet") -> DataFrame:
    """A stream of the folder's files, at most ``per_batch`` at a time. Its checkpoint remembers what was done, so a restart repeats nothing."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, stop: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Apply ``work`` to what is there, batch by batch, and end; a batch is skipped once ``stop`` says so."""

    def step(batch: DataFrame, number: int) -> None:
        if not stop():
            work(batch, number)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def window_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Events of each kind by time window; batch and stream alike. Later rows than ``late`` are dropped in a stream."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), key)
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: runs of events without a pause as long as ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("stop"), "n")


def running_counters(messages: DataFrame, key: str = "event_type") -> DataFrame:
    """How often each message has been seen so far, kept in state across batches; write it in update mode for one row for each key that a batch holds."""
    return messages.groupBy(key).agg(F.count("*").alias("n"))
