"""Which lines of a bibliography to ignore, and where references may begin.

Margins and all that a line shows by itself are columns. What depends on the lines before, which
regions are ignored and how far references stand apart so far, is one pass over a document's
lines; documents share batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.by_document import passed

_SIDE = "struct<left: bigint, right: bigint, left2: bigint, right2: bigint>"


def page_margins(lines: DataFrame) -> DataFrame:
    """The one or two text columns of each page: doc_id, page, box (left, right, bottom, height), ``margins`` (left and right of the first and of a second indent, for each column; null where there is none).

    A page whose first line is wider than half of it has one column. Left margins are taken by how
    many lines have them, of equals the smaller first; the widest line that a column may hold gives the right one.
    """
    page = ["doc_id", "page"]
    wide = F.struct(F.min("line_idx").alias("at"), F.min_by(F.col("urx") - F.col("llx"), "line_idx").alias("width"))
    box = lines.groupBy(*page).agg(F.min("llx").alias("left"), F.max("urx").alias("right"), F.min("lly").alias("bottom"), (F.max("ury") - F.min("lly")).alias("height"), wide.alias("first"))
    width = F.col("right") - F.col("left")
    one = F.col("first.width") > width / 2
    box = box.withColumns({"one": one, "most": F.when(one, width).otherwise(F.floor(width / 2) + 10), "least": F.when(one, F.ceil(width / 1.5)).otherwise(F.floor(width / 3))}).drop("first")
    w = F.col("urx") - F.col("llx")
    lefts = lines.join(box, page).groupBy(*page, "llx").agg(F.count("*").alias("n"), F.max(F.when(w <= F.col("most"), w)).alias("w"), *[F.first(c).alias(c) for c in ("left", "right", "one", "least")]).filter(F.col("w") > F.col("least"))
    llx, end = F.col("llx"), F.col("llx") + 2 * F.col("w") - 10
    on_right = (llx - F.col("w") + 10 > F.col("left")) & (end > F.col("right"))
    on_left = (llx - F.col("w") < F.col("left")) & (end < F.col("right"))
    side = F.when(F.col("one"), 0).when(on_right, 1).when(on_left, 0)
    ranked = lefts.withColumn("side", side).filter("side is not null").groupBy(*page, "side").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), llx.cast("bigint").alias("x"), (llx + F.col("w")).cast("bigint").alias("r")))).alias("xs"))

    def made(left: Column, right: Column, left2: Column, right2: Column) -> Column:
        return F.struct(left.alias("left"), right.alias("right"), left2.alias("left2"), right2.alias("right2"))

    def step(s: Column, m: Column) -> Column:
        near, before = s["left"] - m["x"] < 10, m["x"] < s["left"]
        return (
            F.when(s["left"].isNull(), made(m["x"], m["r"], s["left2"], s["right2"]))
            .when(before & near, made(m["x"], F.greatest(s["right"], m["r"]), s["left2"], s["right2"]))
            .when(before, made(m["x"], m["r"], s["left"], s["right"]))
            .when(m["x"] - s["left"] >= 5, made(s["left"], s["right"], m["x"], m["r"]))
            .otherwise(s)
        )

    none = F.lit(None).cast("bigint")
    sides = ranked.withColumn("m", F.aggregate("xs", made(none, none, none, none), step)).groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "m"))), lambda x: x["m"]).alias("margins"))
    return box.drop("one", "most", "least").join(sides, page, "left").withColumn("margins", F.coalesce("margins", F.array().cast(f"array<{_SIDE}>")))


def _last_said(margins: Column, said) -> Column:
    """What the last column that says anything says, else false."""
    return F.coalesce(F.get(F.reverse(F.filter(F.transform(margins, said), lambda x: x.isNotNull())), F.lit(0)), F.lit(False))


def out_of_column(margins: Column, llx: Column, urx: Column, hanging: Column) -> Column:
    """Whether a line reaches across its column's right margin, or, with hanging indents, begins right of both indents."""
    far = lambda m: F.greatest(m["right"], m["right2"])
    across = lambda m: F.when((llx >= m["left"]) & (llx <= far(m)) & (urx > far(m) + 10), True).when((llx >= m["left"] - 10) & (llx <= far(m) + 10) & (urx < far(m) + 10), False)
    inside = lambda m: hanging & m["left2"].isNotNull() & (llx >= m["left"]) & (llx <= far(m))
    aside = lambda m: F.when(inside(m) & (llx - m["left2"] > 5), True).when(inside(m) & (llx - m["left"] <= 30), False)
    return _last_said(margins, across) | _last_said(margins, aside)


def walk(rows: Iterator, hanging: bool) -> Iterator[tuple[bool, bool]]:
    """(ignored, possible_init) of each line of a document, in order.

    A line alone, the lines up to a place higher on the page, or all the rest of a page may be
    ignored. Notes at a page's foot are told by a distance larger than what references have had so far.
    """
    mode, limit, page, moved, began, n, total, last = "read", 0, 0, False, False, 0, 0, None
    for x in rows:
        if mode == "line" or page != x.page:
            mode, page = "read", x.page
        if mode == "above" and x.ury < limit:
            mode = "read"
        if mode == "read" and x.odd:
            mode = "line"
        if x.left_of_last and mode != "rest" and not (mode == "above" and limit < last.lly):
            mode, limit = "above", last.lly
        if mode == "read" and x.title:
            mode = "line"
        if n and hanging and x.low and x.down > total // n + max(2, math.ceil(total // n * 0.1)):
            mode = "rest"
        begins = False
        if mode == "read":
            if not moved:
                begins = x.same_pattern or hanging and began and not x.breaks and not x.indented
                if hanging and x.next_indented and not x.title:
                    begins = moved = True
            if begins and x.gap > 0:
                n, total = n + 1, total + x.gap
        yield mode != "read", begins
        if hanging and x.next_untabbed or x.next_fresh:
            moved = False
        began, last = begins, x


def with_ignored(lines: DataFrame) -> DataFrame:
    """Lines with ``ignored`` and ``possible_init``; they have boxes and the lexical and layout features of the second kind."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    back, ahead = lambda c: F.lag(c).over(order), lambda c: F.lead(c).over(order)
    flag = lambda c: F.coalesce(c, F.lit(False))
    title = flag(F.array_contains("features", "bibliography"))
    is_ = lambda name: flag(F.col("place") == name)
    placed = lines.join(page_margins(lines).select("doc_id", "page", "bottom", F.col("height").alias("page_height"), "margins"), ["doc_id", "page"], "left")
    same_page, hanging = flag(back("page") == F.col("page")), F.col("indentation") == "indented"
    higher = same_page & ~is_("new_column") & (F.col("lly") > back("lly"))
    last_words = F.col("short_line") & F.col("last_on_page") & F.col("big_space_before")
    outside = ~F.col("same_line") & out_of_column(F.col("margins"), F.col("llx"), F.col("urx"), hanging)
    down = F.when(same_page & ~is_("new_column"), back("lly") - F.col("lly"))
    facts = placed.select(
        *["doc_id", "line_idx", "page", "lly", "ury", "same_pattern", "indentation"],
        title.alias("title"),
        flag(last_words | higher | outside).alias("odd"),
        flag(same_page & (F.col("urx") < back("llx")) & ~back("same_line")).alias("left_of_last"),
        F.coalesce(down, F.lit(0)).alias("down"),
        F.when(~flag(back(title)), F.greatest(F.coalesce(down, F.lit(0)), F.lit(0))).otherwise(0).alias("gap"),
        flag((F.col("lly") - F.col("bottom")) < 0.08 * F.col("page_height")).alias("low"),
        (is_("new_page") | is_("new_column") | back("line_idx").isNull()).alias("breaks"),
        is_("indented").alias("indented"),
        flag(ahead("place") == "indented").alias("next_indented"),
        flag(ahead("place") == "untabbed").alias("next_untabbed"),
        flag(ahead("place").isin("new_page", "new_column") & ahead("same_pattern")).alias("next_fresh"),
    )

    def walked(frame: pd.DataFrame, documents: list[tuple[int, int]]) -> pd.DataFrame:
        rows = list(frame.itertuples(index=False))
        found = [x for a, b in documents for x in walk(iter(rows[a:b]), rows[a].indentation == "indented")]
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "line_idx": frame["line_idx"].to_numpy(), "ignored": [i for i, _ in found], "possible_init": [p for _, p in found]})

    told = passed(facts, walked, "doc_id long, line_idx long, ignored boolean, possible_init boolean")
    return lines.join(told, ["doc_id", "line_idx"])
