"""A work queue over a stream: results and the state of every source, written back batch by batch.

A store is a folder with ``results``, ``status`` and the stream's ``checkpoint``. Each batch has
one folder below the first two, named by its number, and replaces it as a whole: first the
results, then the states. A batch that is run again, as after a loss of the driver, has the
same number and the same sources, so it leaves one set of rows. Readers take the results of
those batches alone whose states are written. The checkpoint lies in the store, so that numbers
never start again over rows of another stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DONE, ERROR = "processed", "error"


def settled(store: str, work: Callable[[DataFrame], DataFrame], key: str) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch``: ``work`` makes rows with ``key`` of a batch of sources; sources that come to no row end in error.

    A source that is in a batch more than once has one state; one without a key has a state too.
    """

    def step(batch: DataFrame, number: int) -> None:
        results = f"{store}/results/batch={number}"
        work(batch).write.mode("overwrite").parquet(results)
        done = batch.sparkSession.read.parquet(results).select(F.col(key).alias("_done")).distinct().withColumn("_is_done", F.lit(True))
        each = batch.select(key).distinct().join(done, F.col(key).eqNullSafe(F.col("_done")), "left")
        state = F.when(F.col("_is_done"), DONE).otherwise(ERROR)
        each.select(key, state.alias("status")).write.mode("overwrite").parquet(f"{store}/status/batch={number}")

    return step


def run_queue(stream: DataFrame, work: Callable[[DataFrame], DataFrame], store: str, key: str = "doc_id") -> StreamingQuery:
    """Work off what the stream has and end. Called again with the same store it goes on where it was."""
    query = stream.writeStream.foreachBatch(settled(store, work, key)).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def statuses(spark: SparkSession, store: str, key: str = "doc_id") -> DataFrame:
    """The state of every source in the last batch that had it: key, status, batch. The store must have had a batch."""
    rows = spark.read.parquet(f"{store}/status").withColumn("batch", F.col("batch").cast("long"))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n")


def results(spark: SparkSession, store: str, key: str = "doc_id") -> DataFrame:
    """The results of every source in the last batch that had it, of batches whose states are written."""
    rows = spark.read.parquet(f"{store}/results").withColumn("batch", F.col("batch").cast("long"))
    last = statuses(spark, store, key).filter(F.col("status") == DONE).select(F.col(key).alias("_key"), F.col("batch").alias("_batch"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("batch")


def open_sources(sources: DataFrame, store: str, key: str = "doc_id", retry: bool = False) -> DataFrame:
    """Sources without a state, and with ``retry`` those that ended in error: what a new stream should be given."""
    known = statuses(sources.sparkSession, store, key)
    known = known.filter(F.col("status") == DONE) if retry else known
    return sources.join(known.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
