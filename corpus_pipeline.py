"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input: rejected documents go, near
copies collapse to one, documents that hold benchmark passages go, secrets in texts are
masked (``n_chars`` follows). The last returns the packing plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import near_dups, packing, quality_gam, secrets, wu_manber
from foliograph.llm.shared import cleared, fold, made, table, written


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows beside their text, so that no column of theirs can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality_gam.with_score(_rows(docs), model, text="_text", score="_score").filter("_score >= 0.3").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dups.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    found = wu_manber.with_hits(_rows(docs), table(spark, sf_dir, "benchmark"), text="_text")
    return found.filter(F.size("hits") == 0).select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that the documents go into."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]

#: No statement of SQL expresses the learned and the iterative stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared folder and read again, and what it needed on the way is removed."""
    docs, since = table(spark, sf_dir, "documents"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            cleared(spark, since, but_last=True)
    return docs
