"""Body labels over random flags: windows against a recursion that goes line by line."""

import random
from collections import Counter

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.operators import body_labels as BL
from foliograph.plans import queries_body as Q
from foliograph.plans import views as V

NAMES = [n for n in BL.FLAGS if not n.startswith("figure_")]


def test_windows_equal_a_line_by_line_recursion(spark):
    draw, rows = random.Random(4), []
    for doc in range(150):
        share = {n: draw.choice([0.05, 0.3, 0.6, 0.9]) for n in NAMES}
        for i in range(draw.choice([1, 2, 3, 8, 40, 120])):
            flags = {n: draw.random() < share[n] for n in NAMES}
            flags["starts_figure"] &= not flags["starts_table"]
            rows.append((doc, i, *flags.values()))
    types = "doc_id long, line_idx long, " + ", ".join(f"`{n}` boolean" for n in NAMES)
    frame = spark.createDataFrame(rows, types)
    closing = lambda of: F.max(F.col("ends_left") & F.col("space2")).over(Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(0, of - 1))
    found = BL.body_labels(frame.withColumns({"figure_near": closing(6), "figure_far": closing(15)})).select("doc_id", "line_idx", "label", "paragraph").collect()
    con = duckdb.connect()
    flagged = frame.toPandas()
    con.register("flagged", flagged)
    views = ", ".join(f"{n} AS ({V.SQL[n]})" for n in ("ahead", "titles"))
    sql = f"WITH RECURSIVE {views}, walked AS MATERIALIZED ({V.SQL['walked']}), walk AS ({Q._walk()}) SELECT doc_id, line_idx, label, CASE WHEN par THEN number END FROM walk WHERE line_idx >= 0"
    assert Counter(map(tuple, found)) == Counter(con.execute(sql).fetchall())
    kinds = {label.split("--")[0] for _, _, label, _ in map(tuple, found)}
    assert kinds >= {"notext", "paragraph-begin", "paragraph-inside", "section-marker-begin", "section-marker-inside", "table-marker-begin", "table-marker-inside", "figure-marker-begin", "figure-marker-inside"}


def labels_of(spark, *lines):
    """Labels of one document, each line given by the flags it has."""
    rows = [(1, k, *[n in line.split() for n in BL.FLAGS]) for k, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc_id long, line_idx long, " + ", ".join(f"`{n}` boolean" for n in BL.FLAGS))
    return [r["label"] for r in BL.body_labels(frame).orderBy("line_idx").collect()]


def test_a_small_paper(spark):
    got = labels_of(
        spark,
        "numbered word_form space2 rise2 new_column",  # a heading
        "starts_cap",
        "ends_in_dot ends_left space2 rise2",
        "starts_table right",  # a caption, its rows, and text behind a gap
        "no_words",
        "no_words space2 rise2",
        "starts_cap",
        "is_index_line",
        "no_column new_page",
        "rise4",
        "starts_enum near_bottom lower1",  # a footer up to the next column
        "starts_cap",
        "up new_column",
    )
    assert got == ["section-marker-begin", "paragraph-begin--_--id=1", "paragraph-inside", "table-marker-begin", "table-marker-inside", "table-marker-inside", "paragraph-begin--_--id=2", "notext", "notext", "paragraph-begin--_--id=2", "notext", "notext", "paragraph-begin--_--id=2"]


def test_nulls_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0, *[None] * len(BL.FLAGS))], "doc_id long, line_idx long, " + ", ".join(f"`{n}` boolean" for n in BL.FLAGS))
    assert [tuple(r) for r in BL.body_labels(frame).select("label", "paragraph").collect()] == [("paragraph-inside", 0)]
    assert BL.body_labels(frame.limit(0)).count() == 0
