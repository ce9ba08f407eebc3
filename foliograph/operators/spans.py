"""Labelled spans and tokens: labels of tokens, token bounds of spans, nested elements, selections by rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _texts(order: str = "tok_idx"):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "token"))), lambda x: x["token"]), " ")


def token_labels(tokens: DataFrame, spans: DataFrame, background: str = "O") -> DataFrame:
    """Tokens (doc_id, tok_idx, start) with the labels of all spans they start in, outermost first, joined by colons.

    ``spans`` has doc_id, label, start and stop, the stop being the last place that belongs to
    a span. Of spans that start together the longer is the outer one.
    Spans come to a document's tokens as one list, outermost first, so tokens stay one row each and are dealt by document alone.
    """
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("stop"), "label"))).alias("_spans"))
    around = F.filter("_spans", lambda x: (x["start"] <= F.col("start")) & (F.col("start") <= -x["stop"]))
    # a span without a name makes no background, and is left out of the names
    label = F.when(F.size(around) > 0, F.array_join(F.transform(around, lambda x: x["label"]), ":"))
    return tokens.join(listed, "doc_id", "left").withColumn("label", F.coalesce(label, F.lit(background))).drop("_spans")


def span_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (doc_id, span_id, start, stop) with the first and last token that starts in them and the tokens' text; null for none."""
    inside = spans.join(tokens.select("doc_id", "tok_idx", "token", F.col("start").alias("_at")), "doc_id").filter((F.col("start") <= F.col("_at")) & (F.col("_at") <= F.col("stop")))
    bounds = inside.groupBy("doc_id", "span_id").agg(F.min("tok_idx").alias("first_token"), F.max("tok_idx").alias("last_token"), _texts().alias("text"))
    return spans.join(bounds, ["doc_id", "span_id"], "left")


def bio_paths(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels like ``B-x`` and ``I-x`` as the paths ``^x`` and ``x``."""
    return labels.withColumn(label, F.regexp_replace(F.regexp_replace(label, "^B-", "^"), "^I-", ""))


def reopened_fields(labelled: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields that a document opens again after closing them: how many runs of tokens have them."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    new = F.coalesce(F.lag("label").over(order) != F.col("label"), F.lit(True))
    runs = labelled.withColumn("_new", new).filter(F.col("_new") & F.col("label").isin(*fields)).groupBy("doc_id", F.col("label").alias("field")).agg(F.count("*").alias("runs"))
    return runs.filter("runs > 1")


def in_rectangles(boxes: DataFrame, rectangles: DataFrame, indent: int = 2) -> DataFrame:
    """Text boxes that lie in a rectangle of their page, in mentions: one starts where a box stands within ``indent`` of the rectangle's left edge.

    ``rectangles`` has doc_id, page, rect_id, x0, y0, x1 and y1.
    """
    held = boxes.join(rectangles, ["doc_id", "page"]).filter((F.col("llx") >= F.col("x0")) & (F.col("urx") <= F.col("x1")) & (F.col("lly") >= F.col("y0")) & (F.col("ury") <= F.col("y1")))
    starts = (F.col("llx") - F.col("x0") <= indent).cast("long")
    order = Window.partitionBy("doc_id", "page", "rect_id").orderBy("line_idx")
    return held.withColumn("mention", F.sum(starts).over(order)).drop("x0", "y0", "x1", "y1")


def contiguous(rows: DataFrame, group: str, order: str, value: str, n: int) -> DataFrame:
    """Every ``n`` neighbouring values of a group as an array, by where they start."""
    w = Window.partitionBy(group).orderBy(order)
    values = F.array(*[F.col(value) if k == 0 else F.lead(value, k).over(w) for k in range(n)])
    return rows.select(group, order, values.alias("values"), F.lead(order, n - 1).over(w).alias("_last") if n > 1 else F.col(order).alias("_last")).filter("_last is not null").drop("_last")


def combinations(rows: DataFrame, group: str, value: str, n: int = 2) -> DataFrame:
    """All combinations of ``n`` different values of a group, in order: as a and b where they are two, else as an array ``values``. Made from each group's list, so no rows meet twice."""
    if n < 1:
        raise ValueError("combinations are of one at least")
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("_all"))
    each = listed.select(group, "_all", F.posexplode("_all").alias("_k", "_v")).select(group, "_all", "_k", F.array("_v").alias("values"))
    for _ in range(n - 1):
        later = F.transform(F.slice("_all", F.col("_k") + 2, F.size("_all")), lambda v, i: F.struct((F.col("_k") + 1 + i).alias("k"), v.alias("v")))
        each = each.select(group, "_all", "values", F.explode(later).alias("_n")).select(group, "_all", F.col("_n.k").alias("_k"), F.concat("values", F.array("_n.v")).alias("values"))
    return each.select(group, F.col("values")[0].alias("a"), F.col("values")[1].alias("b")) if n == 2 else each.select(group, "values")


def target_labels(labelled: DataFrame, segment_authors: bool = True, prefix_notes: bool = True) -> DataFrame:
    """Tokens (doc_id, tok_idx, ``label``: names of the spans around, outermost first, with colons between) with ``target``.

    The innermost name is the target. Inside of an author it says whether the token begins one, which is the first
    of neighbouring tokens in one; inside of a note it has that in front.
    """
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    names = F.split("label", ":")
    inner, outer = F.element_at(names, -1), F.slice(names, F.lit(1), F.size(names) - 1)
    within = F.array_contains(names, "author")
    begins = within & ~F.coalesce(F.lag(within).over(order), F.lit(False))
    target = F.lit("")
    if prefix_notes:
        target = F.when(F.array_contains(outer, "note") & (inner != "note"), "note|").otherwise("")
    if segment_authors:
        part = F.when(begins, "author-begin|").otherwise("author-inside|")
        target = F.concat(target, F.when(F.array_contains(outer, "author") & (inner != "author"), part).otherwise(""))
    return labelled.withColumn("target", F.concat(target, inner))


def lead_marker(text: Column) -> Column:
    """How many characters a reference's marker takes at its beginning, with the white space behind: brackets, behind nothing but tags, or a number of up to three digits with a period; 0 without one."""
    bare = F.regexp_replace(text, r"^(?:\s++|<[^>]*+>)*+", "")
    close = F.instr(bare, "]")
    white = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t\n\x0b\f\r")))
    behind = F.substring(bare, close + 1, F.length(bare))
    bracket = F.length(text) - F.length(bare) + close + white(behind)
    line = F.ltrim(text, F.lit(" \t\n\x0b\f\r"))
    first = F.substring_index(line, ".", 1)
    rest = F.substring(line, F.length(first) + 2, F.length(line))
    number = F.length(text) - F.length(rest) + white(rest)
    return F.when(F.startswith(bare, F.lit("[")) & (close > 2), bracket).when(first.rlike("^[0-9]{1,3}$") & (white(rest) > 0), number).otherwise(0)


def seeded_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows with ``part`` train or test, by a digest of seed and key: the same on every run and every cluster."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("part", F.when(place < int(share * 2**32), "train").otherwise("test"))


def not_done(rows: DataFrame, done: DataFrame, key: str, reprocess: bool = False) -> DataFrame:
    """Rows that are not marked as done; all of them where they are to be processed again."""
    return rows if reprocess else rows.join(done.select(key), key, "left_anti")


def attributes(pairs: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Multi-valued attributes of each key as a map from name to its different values, ascending."""
    each = pairs.groupBy(key, name).agg(F.array_sort(F.collect_set(value)).alias("_values"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_values")))).alias("attributes"))


def in_all(rows: DataFrame, value: str, *tests: Column) -> DataFrame:
    """The different values that have rows for each of the tests: one aggregation, so that repeats go before the shuffle."""
    flags = [F.max(F.coalesce(t, F.lit(False))).alias(f"_{k}") for k, t in enumerate(tests)]
    return rows.groupBy(value).agg(*flags).filter(" and ".join(f"_{k}" for k in range(len(tests)))).select(value)


def normalised(text):
    """Text with runs of white space as one blank, and none at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "), r"^ | $", "")
