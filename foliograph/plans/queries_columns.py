"""Queries over page columns. Their folds have no SQL; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import columns as C
from foliograph.plans import views as V
from foliograph.plans.catalog import query


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in two columns of a page: the first twenty of forty on the left, with some that are indented, short or wide."""
    i, d = F.col("line_idx") % 40, F.col("doc_id")
    right = i >= 20
    left_edge = F.when(right, 320).otherwise(72) + F.when(i % 7 == 3, 12).when(i % 9 == 4, 1).otherwise(0)
    right_edge = F.when((i == 0) & (d % 2 == 0), 540).when(right, 540).otherwise(290) - F.when(i % 6 == 5, 80 + d % 4).when(i % 5 == 2, 3).otherwise(0)
    lly = 700 - 14 * (i % 20) - F.when(i % 20 == 19, 30).otherwise(0)
    return V.line(spark, sf_dir).select("doc_id", "line_idx", "page", left_edge.alias("llx"), lly.alias("lly"), right_edge.alias("urx"), (lly + 10).alias("ury"))


@query("column_candidates")
def column_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column candidates of pages."""
    return C.candidates(two_columns(spark, sf_dir)).select("doc_id", "page", F.posexplode("candidates").alias("place", "c")).select("doc_id", "page", "place", "c.*")


@query("page_columns")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of pages."""
    return C.columns(C.candidates(two_columns(spark, sf_dir))).select("doc_id", "page", F.posexplode("columns").alias("place", "c")).select("doc_id", "page", "place", "c.*")


@query("line_columns")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of each line."""
    lines = two_columns(spark, sf_dir)
    return C.with_column(lines, C.columns(C.candidates(lines)), F.lit(14)).select("doc_id", "line_idx", "column")
