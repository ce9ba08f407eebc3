"""Queries that run a stream over a table's file to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.plans import views as V
from foliograph.plans.catalog import query
from foliograph.streaming import jobs as J
from foliograph.streaming import queue as Q


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The rows a stream appends until its input is used up."""
    folder = _folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = V.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").load(sf_dir)


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events, as a batch (§2.12)."""
    return J.window_counts(V.table(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n")


@query(
    "event_sessions",
    "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, as a batch (§2.12)."""
    return J.sessions(V.table(spark, sf_dir, "events"))


@query("streamed_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message counters kept across batches of a stream (§2.12, A9)."""
    rows = _drained(spark, J.running_counters(_events(spark, sf_dir).select("event_type")), "update")
    return rows.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))


@query("streamed_windows", "SELECT * FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 10 minute FROM events)")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream by event time, each written once the watermark has passed its end (§2.12)."""
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs the type with a zone
    return _drained(spark, J.window_counts(events, "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "append")


@query(
    "worked_sources",
    "SELECT doc_id, status, CASE WHEN status = 'processed' THEN n_lines END AS n_lines FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'processed' ELSE 'error' END AS status, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents)",
)
def worked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents worked off as a queue of files, with results and states written back."""
    documents, store = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _folder(spark)
    documents.repartition(8, "doc_id").write.parquet(f"{store}/sources")
    work = lambda batch: batch.filter("lang = 'en'").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    Q.run_queue(J.new_files(spark, f"{store}/sources", documents.schema, 3), work, store)
    states = Q.statuses(spark, store).select("doc_id", "status")
    return states.join(Q.results(spark, store), "doc_id", "left")
