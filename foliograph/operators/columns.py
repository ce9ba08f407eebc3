"""Columns of pages: candidates by margins, which of them are columns, and which column each line is in.

Lines are taken in order, and the first seen of several alike stands for them, so a page's
lines are folded as one array. Pages are short; documents and pages are the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COLUMN = "struct<left: bigint, right: bigint, top: bigint, bottom: bigint, qty: bigint, contiguous: bigint>"
#: How far left and right margins may be off, and what makes a column.
LEFT, RIGHT, WIDTH, LEAST, RATIO = 3, 5, 50, 3, 0.8


def _alike(left: Column, right: Column, other_left: Column, other_right: Column) -> Column:
    """Right margins equal and left ones near, or right ones near and left ones within one pixel."""
    d_left, d_right = F.abs(left - other_left), F.abs(right - other_right)
    return (d_right == 0) & (d_left <= LEFT) | (d_right <= RIGHT) & (d_left <= 1)


def candidates(lines: DataFrame) -> DataFrame:
    """Column candidates of each page as an array in the order seen: margins, extent, lines, and lines next to one alike."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    near = [f(c).over(order).cast("bigint").alias(f"{n}_{c}") for n, f in (("back", F.lag), ("ahead", F.lead)) for c in ("llx", "urx")]
    rows = lines.select("doc_id", "page", F.struct(F.col("line_idx").alias("i"), *[F.col(c).cast("bigint").alias(c) for c in ("llx", "urx", "lly", "ury")], *near).alias("x"))
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    flag = lambda c: F.coalesce(c, F.lit(False))

    def touches(left: Column, right: Column, x: Column) -> Column:
        one = flag(_alike(left, right, x["back_llx"], x["back_urx"])) | flag(_alike(left, right, x["ahead_llx"], x["ahead_urx"]))
        return one.cast("bigint")

    def step(found: Column, x: Column) -> Column:
        at = F.array_position(F.transform(found, lambda c: _alike(c["left"], c["right"], x["llx"], x["urx"])), F.lit(True))
        grown = lambda c: F.struct(c["left"].alias("left"), c["right"].alias("right"), F.greatest(c["top"], x["ury"]).alias("top"), F.least(c["bottom"], x["lly"]).alias("bottom"), (c["qty"] + 1).alias("qty"), (c["contiguous"] + touches(c["left"], c["right"], x)).alias("contiguous"))
        new = F.struct(x["llx"].alias("left"), x["urx"].alias("right"), x["ury"].alias("top"), x["lly"].alias("bottom"), F.lit(1).cast("bigint").alias("qty"), touches(x["llx"], x["urx"], x).alias("contiguous"))
        return F.when(at > 0, F.transform(found, lambda c, k: F.when(k == at - 1, grown(c)).otherwise(c))).otherwise(F.concat(found, F.array(new)))

    return pages.select("doc_id", "page", F.aggregate("xs", F.array().cast(f"array<{_COLUMN}>"), step).alias("candidates"))


def _apart(a: Column, b: Column) -> Column:
    """Whether two columns may stand on one page: beside or above each other, or with one margin shared and the other well off."""
    beside = (a["left"] > b["right"]) | (b["left"] > a["right"]) | (a["bottom"] > b["top"]) | (b["bottom"] > a["top"])
    same_left, same_right = F.abs(a["left"] - b["left"]) <= 2, F.abs(a["right"] - b["right"]) <= 2
    far = lambda c: F.abs(a[c] - b[c]) >= 0.15 * (b["right"] - b["left"])
    return beside | same_left & far("right") | same_right & far("left")


def columns(found: DataFrame) -> DataFrame:
    """The columns of each page: candidates with most lines first (of equals the first seen), wide enough and mostly contiguous, that stand apart from those chosen before. The very first only has to be wide enough."""
    ranked = F.transform(F.array_sort(F.transform("candidates", lambda c, k: F.struct((-c["qty"]).alias("n"), k.alias("k"), c.alias("c")))), lambda x: x["c"])
    wide = lambda c: c["right"] - c["left"] > WIDTH
    first = F.filter(F.slice("_ranked", 1, 1), wide)
    fits = lambda c: (c["qty"] >= LEAST) & (c["contiguous"] >= RATIO * c["qty"]) & wide(c)
    step = lambda chosen, c: F.when(fits(c) & F.forall(chosen, lambda b: _apart(c, b)), F.concat(chosen, F.array(c))).otherwise(chosen)
    return found.withColumn("_ranked", ranked).select("doc_id", "page", F.aggregate("_ranked", first, step).alias("columns"))


def with_column(lines: DataFrame, pages: DataFrame, usual_distance: Column) -> DataFrame:
    """Lines with ``column``, the place of theirs in the page's columns from 0, or null.

    A line is in the first column whose margins are its own, or that holds it in both directions;
    else in the last that holds it from left to right and ends no further above or below it than
    ``usual_distance`` and two pixels.
    """
    strict = lambda c: _alike(c["left"], c["right"], F.col("llx"), F.col("urx"))
    beside = lambda c: (F.col("llx") > c["left"] - LEFT) & (F.col("urx") < c["right"] + RIGHT)
    inside = lambda c: (F.col("ury") <= c["top"]) & (F.col("lly") >= c["bottom"])
    off = lambda c: F.least(F.abs(F.col("lly") - c["top"]), F.abs(c["bottom"] - F.col("ury")))
    at = lambda test: F.array_position(F.transform("columns", test), F.lit(True)) - 1
    first = at(lambda c: strict(c) | beside(c) & inside(c))
    near = F.transform("columns", lambda c: beside(c) & (off(c) <= usual_distance + 2))
    last = F.size("columns") - F.array_position(F.reverse(near), F.lit(True))
    column = F.when(first >= 0, first).when(F.array_contains(near, F.lit(True)), last)
    return lines.join(pages, ["doc_id", "page"], "left").withColumn("column", column.cast("int")).drop("columns")
