"""Regions of a bibliography that are ignored, step by step and on whole pages."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from foliograph.operators import ignored_lines as I
from foliograph.operators import line_features as L

PLAIN = {"page": 0, "lly": 500, "ury": 510, "same_pattern": False, "title": False, "odd": False, "left_of_last": False, "down": 12, "gap": 12, "low": False, "breaks": False, "indented": False, "next_indented": False, "next_untabbed": False, "next_fresh": False}


def walked(*lines, hanging=False):
    found = list(I.walk((SimpleNamespace(**PLAIN | x) for x in lines), hanging))
    return "".join("-" if ignored else "B" if begins else "." for ignored, begins in found)


def test_steps():
    start = {"same_pattern": True}
    assert walked({"title": True}, start, {}, start) == "-B.B"
    assert walked(start, {"odd": True}, start, {"odd": True, "same_pattern": True}) == "B-B-"  # one line alone
    # up to a line that is lower than the one before the jump to the left
    assert walked(start, {"lly": 300}, {"left_of_last": True, "ury": 700, "lly": 690}, {"ury": 400}, {"ury": 290, **start}) == "B.--B"
    assert walked(start, {"lly": 300}, {"left_of_last": True, "ury": 700}, {"page": 1, **start}) == "B.-B"
    # with hanging indents a reference begins before an indented line, and lines at its margin begin others
    hung = [{"next_indented": True}, {"indented": True, "next_untabbed": True}, {"next_indented": True}, {"indented": True}]
    assert walked(*hung, hanging=True) == "B.B."
    assert walked(start, {}, {"breaks": True}, hanging=True) == "BB."
    # a wide distance near the foot ends the page
    foot = [start, start, {"down": 20, "low": True, "same_pattern": True}, start, {"page": 1, **start}]
    assert walked(*foot, hanging=True) == "BB--B"
    assert walked(*foot) == "BBBBB"
    assert walked() == ""


def test_out_of_column(spark):
    margins = F.array(F.struct(F.lit(72).alias("left"), F.lit(300).alias("right"), F.lit(90).alias("left2"), F.lit(300).alias("right2")))
    cases = [(72, 300, False), (72, 320, True), (90, 290, False), (96, 290, True), (400, 500, False)]
    rows = spark.createDataFrame(cases, "llx long, urx long, want boolean")
    out = rows.select("want", I.out_of_column(margins, F.col("llx"), F.col("urx"), F.lit(True)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)
    none = F.array().cast("array<struct<left: bigint, right: bigint, left2: bigint, right2: bigint>>")
    assert not rows.filter(I.out_of_column(none, F.col("llx"), F.col("urx"), F.lit(True))).count()


def lines_of(spark, boxes):
    rows = [(1, k, 0, x, 700 - 12 * k, r, 710 - 12 * k, 1, t) for k, (x, r, t) in enumerate(boxes)]
    return spark.createDataFrame(rows, "doc_id long, line_idx long, page long, llx long, lly long, urx long, ury long, font long, text string")


def test_margins(spark):
    one = lines_of(spark, [(72, 400, "a"), (90, 395, "b"), (72, 398, "c"), (90, 390, "d"), (72, 100, "e")])
    assert [tuple(m) for m in I.page_margins(one).first()["margins"]] == [(72, 400, 90, 395)]
    two = lines_of(spark, [(72, 270, "a"), (72, 272, "b"), (90, 272, "c"), (300, 500, "d"), (300, 498, "e"), (318, 500, "f")])
    assert [tuple(m) for m in I.page_margins(two).first()["margins"]] == [(72, 272, 90, 272), (300, 500, 318, 500)]
    assert I.page_margins(one.limit(0)).count() == 0


def test_a_page(spark):
    texts = [(72, 300, "References"), (72, 400, "[1] A. Low, on it"), (90, 395, "and more"), (72, 398, "[2] B. Gee, on that"), (90, 460, "a line across the margin"), (72, 399, "[3] C. Hay, on all")]
    found = I.with_ignored(L.with_layout_features_v2(L.with_lexical_features_v2(lines_of(spark, texts))))
    got = "".join("-" if r["ignored"] else "B" if r["possible_init"] else "." for r in found.orderBy("line_idx").collect())
    assert got[0] == "-" and got[1] == "B" and got[3] == "B"
    assert I.with_ignored(L.with_layout_features_v2(L.with_lexical_features_v2(lines_of(spark, texts).limit(0)))).count() == 0
