"""Hints where references begin and end: by gaps between lines, by indents, by the order of names, and all of them fused.

``lines`` are the lines of a bibliography: doc_id, line_idx (from 0 without holes), page, llx, lly
and text. Hints have doc_id, line_idx and ``ends``, true where the references end before that line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.by_document import passed

#: How much larger a gap between references must be, and how much gaps taken as equal may differ, as shares.
LARGER, EQUAL = 0.15, 0.09
#: Lines that are looked at for two kinds of gaps.
SAMPLE = 23
#: Least and most that the lines of a reference are indented, and what makes a new column.
INDENT, MOST, COLUMN = 5, 90, 150
_HINT = "doc_id long, line_idx long, ends boolean"


def _distinct(least: Column, most: Column) -> Column:
    """Whether the largest gap stands out from the smallest."""
    return F.when(least == 0, most > 0).otherwise(F.try_divide(most - least, least) >= LARGER)


def _gap_kinds(gaps: Column) -> Column:
    """Smallest and largest of the gaps (structs with ``gap``, in order) and whether the larger ones part references, as a struct."""
    none = F.struct(F.lit(None).cast("double").alias("least"), F.lit(0.0).alias("most"), F.lit(False).alias("varied"))

    def step(s: Column, x: Column) -> Column:
        g = x["gap"]
        least = F.least(s["least"], g)  # a null is passed over
        same = (s["most"] > 0) & (F.try_divide(F.abs(g - s["most"]), s["most"]) <= EQUAL)
        larger = ~same & (g > s["most"])
        stands_out = _distinct(least, s["most"])
        most = F.when(same, F.greatest(g, s["most"])).when(larger & ~stands_out, g).otherwise(s["most"])
        varied = F.when(same, _distinct(least, most)).otherwise(larger & stands_out)
        return F.when(s["varied"], s).otherwise(F.struct(least.alias("least"), most.alias("most"), F.coalesce(varied, F.lit(False)).alias("varied")))

    return F.aggregate(gaps, none, step)


def _first_gap() -> Column:
    return (F.col("line_idx") < SAMPLE) & (F.col("gap") >= 0)


def gap_kinds(lines: DataFrame) -> DataFrame:
    """The smallest and the largest gap at a document's start, and whether the larger ones part references (``varied``): doc_id, least, most, varied.

    The largest gap must stand out, and come twice or be followed by a still larger one. First lines of columns have no gap.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    gap = (F.lag("lly").over(order) - F.col("lly")).cast("double")
    rows = lines.withColumn("gap", gap).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(_first_gap(), F.struct("line_idx", "gap")))).alias("gaps"))
    return rows.select("doc_id", _gap_kinds(F.col("gaps")).alias("k")).select("doc_id", "k.*")


def gap_hints(lines: DataFrame) -> DataFrame:
    """Hints by vertical gaps. There is always an end: at a gap too large, at a column whose first gap fits no other, or behind the last line.

    A document's gaps are one list, so its lines are read once.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    gap, ahead = (F.lag("lly").over(order) - F.col("lly")).cast("double"), (F.col("lly") - F.lead("lly").over(order)).cast("double")
    spaced = lines.filter("doc_id is not null").select("doc_id", "line_idx", gap.alias("gap"), ahead.alias("ahead"))
    some = F.collect_list(F.when(_first_gap(), F.struct("line_idx", "gap")))
    each = spaced.groupBy("doc_id").agg(F.array_sort(some).alias("gaps"), F.max("line_idx").alias("last"), F.collect_list(F.struct("line_idx", "gap", "ahead")).alias("lines"))
    known = each.select("doc_id", "last", "lines", _gap_kinds(F.col("gaps")).alias("k"))

    def kind(x: Column) -> Column:
        least, most, varied = (F.col(f"k.{c}") for c in ("least", "most", "varied"))
        near = lambda kind: F.when(kind == 0, F.abs(x["ahead"]) < 2).otherwise(F.try_divide(F.abs(x["ahead"] - kind) - 2, kind) < EQUAL)
        fits = F.coalesce(near(least), F.lit(False)) | F.coalesce(near(most), F.lit(False)) | F.coalesce(x["ahead"].between(least, most), F.lit(False))
        column = x["gap"] < 0
        seen = F.when(column & varied, most).otherwise(x["gap"])
        part = F.when(seen > most, F.when(most == 0, seen <= 2).otherwise(F.try_divide(seen - (most + 2), most) <= EQUAL)).otherwise(most - seen < seen - least)
        large = F.when(varied, seen > most).otherwise(F.when(least == 0, seen > 2).otherwise(F.try_divide(seen - (least + 2), least) >= LARGER))
        return (
            F.when(x["line_idx"] == 0, F.when(varied, "begins"))
            .when(column & ~fits, "ends")
            .when(column & ~varied, None)
            .when(varied & F.coalesce(part, F.lit(False)), "begins")
            .when(F.coalesce(large, F.lit(False)), "ends")
        )

    marked = known.select("doc_id", "last", F.filter(F.transform("lines", lambda x: F.struct(x["line_idx"].alias("line_idx"), kind(x).alias("kind"))), lambda x: x["kind"].isNotNull()).alias("marked"))
    stopped = marked.withColumn("stop", F.coalesce(F.array_min(F.transform(F.filter("marked", lambda x: x["kind"] == "ends"), lambda x: x["line_idx"])), F.col("last") + 1))
    begins = F.transform(F.filter("marked", lambda x: (x["kind"] == "begins") & (x["line_idx"] < F.col("stop"))), lambda x: F.struct(x["line_idx"].alias("line_idx"), F.lit(False).alias("ends")))
    return stopped.select("doc_id", F.inline(F.concat(begins, F.array(F.struct(F.col("stop").alias("line_idx"), F.lit(True).alias("ends"))))))


def indented(x: list[int], y: list[int], page: list[int], size: list[int], budget: int, look: int = 10) -> list[tuple[int, bool]]:
    """(line, ends) by left margins: a reference begins left of where its other lines stand, or, if the first column shows it, right of there.

    At the start of each column up to ``look`` lines are searched for one that stands aside: to the
    right, and the column begins with a reference; to the left, and that line begins one. A column without ends the references.
    """
    n, sign, margin, first, at, held, above = len(x), 1, 0, True, 0, 0, None
    out: list[tuple[int, bool]] = []
    while at < n:
        here, line = sign * x[at], at
        fresh = first or page[at] != page[at - 1] or y[at] > above or abs(margin - here) > COLUMN
        above = y[at]
        if fresh:
            side = 0
            for k in range(at + 1, min(n, at + 1 + look)):
                if page[k] != page[k - 1] or k > at + 1 and y[k] > y[k - 1]:
                    break
                aside = sign * x[k] - here
                if first and -MOST <= aside <= -INDENT:
                    sign, here, aside = -sign, -here, -aside
                if abs(aside) >= INDENT:
                    side = k if abs(aside) <= MOST else 0
                    break
            if not side:
                return [] if first else [*out, (at, True)]
            if aside > 0:
                margin = sign * x[side]
            else:
                margin, here, line = here, sign * x[side], side
        if INDENT <= margin - here <= MOST:
            out.append((line, False))
            held = 0
        elif margin - here < INDENT:
            held += size[line]
            if held > budget:
                return out
        first, at = False, line + 1
    return out


def indent_hints(lines: DataFrame, budget: int = 3200) -> DataFrame:
    """Hints by indents; ``budget`` characters without a beginning end the search. A document's lines are gone through at once."""

    def found(frame: pd.DataFrame, documents: list[tuple[int, int]]) -> pd.DataFrame:
        x, y, page, size, line, doc = (frame[c].tolist() for c in ("llx", "lly", "page", "size", "line_idx", "doc_id"))
        hints = [(doc[a], line[a + k], ends) for a, b in documents for k, ends in indented(x[a:b], y[a:b], page[a:b], size[a:b], budget)]
        return pd.DataFrame(hints, columns=["doc_id", "line_idx", "ends"])

    sized = lines.select("doc_id", "line_idx", "page", "llx", "lly", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return passed(sized, found, _HINT)


def name_words(text: Column) -> Column:
    """The first word of a line, capital if it is a particle of a name."""
    first = F.split(F.trim(F.regexp_replace(text, r"\s", " ")), " +")[0]
    return F.when(first.isin("van", "von", "de"), F.initcap(first)).otherwise(first)


def may_be_name(text: Column) -> Column:
    """Whether a line may begin with an author: five words at least, a capital letter, and a comma, et, and or a year to go with it."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s", " ")), " +")
    second = F.get(words, F.lit(1))
    joined = name_words(text).endswith(",") | second.isin(",", "et", "ET", "et.", "ET.", "and", "AND") | text.rlike("(19|20)[0-9]{2}")
    return (F.size(words) >= 5) & name_words(text).rlike(r"^\p{Lu}") & joined


def longest_rise(words: list[str], able: list[bool], back: int = 20) -> list[int]:
    """Places of the longest run of able words, none below the first two letters of the one before it, which is at most ``back`` places away. Of equals the earliest."""
    length, came = [0] * len(words), [-1] * len(words)
    starts = [w[:2] if len(w) >= 3 else w for w in words]
    for j, word in enumerate(words):
        if able[j]:
            best = max((i for i in range(max(0, j - back), j) if starts[i] <= word), key=lambda i: (length[i], -i), default=-1)
            if best >= 0 and length[best]:
                came[j] = best
            length[j] = 1 + (length[best] if best >= 0 else 0)
    at = max(range(len(words)), key=lambda j: (length[j], -j), default=-1)
    chain = []
    while at >= 0 and length[at]:
        chain.append(at)
        at = came[at]
    return chain[::-1]


def alphabet_hints(lines: DataFrame) -> DataFrame:
    """Hints by the order of names, in documents whose first line begins with a name. A document's first words are gone through at once."""
    able = F.coalesce(may_be_name(F.col("text")), F.lit(False))
    named = F.coalesce(F.col("text").rlike(r"^\p{Lu}(\p{L}.|.\p{L})"), F.lit(False))
    # words that cannot begin a reference count for nothing
    words = lines.select("doc_id", "line_idx", F.when(able, F.coalesce(name_words(F.col("text")), F.lit(""))).otherwise("").alias("word"), able.alias("able"), named.alias("named"))

    def found(frame: pd.DataFrame, documents: list[tuple[int, int]]) -> pd.DataFrame:
        word, able, named = (frame[c].tolist() for c in ("word", "able", "named"))
        places = [a + k for a, b in documents if named[a] for k in longest_rise(word[a:b], able[a:b])]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[places], "line_idx": frame["line_idx"].iloc[places], "ends": False})

    return passed(words, found, _HINT)


def fused(hints: DataFrame) -> DataFrame:
    """The hints of one source for each document: doc_id, source, line_idx, ends, with an end; or a row with the ``error`` why there are none.

    ``hints`` has source (gap, regex, indent, alphabet), doc_id, line_idx, ends, style. Gaps must
    tell the end. Brackets and numbers with periods (styles 1 and 6), else names in order, that go beyond it are believed, up
    to their last hint, which ends them. Else one source is cut at the end: brackets or numbers, indents unless
    they are less than three quarters of another source, names, other patterns, gaps alone.
    """
    of = lambda s: F.col("source") == s
    counts = [F.count(F.when(of(s), 1)).alias(f"n_{s}") for s in ("gap", "regex", "indent", "alphabet")]
    lasts = [F.max(F.when(of(s), F.col("line_idx"))).alias(f"last_{s}") for s in ("regex", "alphabet")]
    listed = F.array_sort(F.collect_list(F.struct("line_idx", "ends", "source"))).alias("hints")
    facts = hints.groupBy("doc_id").agg(*counts, *lasts, F.max(F.when(of("gap") & F.col("ends"), F.col("line_idx"))).alias("stop"), F.max(F.when(of("regex"), F.col("style"))).alias("style"), listed)
    n = lambda s: F.col(f"n_{s}")
    reliable = (n("regex") > 0) & F.coalesce(F.col("style").isin(1, 6), F.lit(False))
    firm = F.when(reliable, "regex").when(n("alphabet") > 0, "alphabet")
    beyond = F.when(reliable, F.col("last_regex")).otherwise(F.col("last_alphabet"))
    short = (n("indent") * 4 < n("alphabet") * 3) | (n("indent") * 4 < n("regex") * 3)
    source = (
        F.when(beyond > F.col("stop"), firm)
        .when(reliable, "regex")
        .when((n("indent") > 0) & ~short, "indent")
        .when(n("alphabet") > 0, "alphabet")
        .when(n("regex") > 0, "regex")
        .otherwise("gap")
    )
    error = F.when(F.col("stop").isNull(), "no end by gaps").when((n("gap") == 1) & (n("regex") + n("indent") + n("alphabet") == 0), "no hints")
    chosen = facts.select("doc_id", "hints", source.alias("source"), error.alias("error"), F.when(beyond > F.col("stop"), beyond).otherwise(F.col("stop")).alias("stop"))
    # a document's hints are one list, which is looked through without joins
    before = F.filter("hints", lambda x: (x["source"] == F.col("source")) & (x["line_idx"] < F.col("stop")))
    cut = chosen.withColumn("before", before).withColumn("end", F.array_position(F.transform("before", lambda x: x["ends"]), True).cast("int"))
    row = lambda line, ends: F.struct(line.cast("long").alias("line_idx"), ends.cast("boolean").alias("ends"))
    kept = F.transform(F.when(F.col("end") > 0, F.slice("before", F.lit(1), F.col("end"))).otherwise(F.col("before")), lambda x: row(x["line_idx"], x["ends"]))
    stop = F.when(F.col("end") > 0, F.array().cast("array<struct<line_idx: bigint, ends: boolean>>")).otherwise(F.array(row(F.col("stop"), F.lit(True))))
    rows = F.when(F.col("error").isNull(), F.concat(kept, stop)).otherwise(F.array(row(F.lit(None), F.lit(None))))
    return cut.select("doc_id", F.when(F.col("error").isNull(), F.col("source")).alias("source"), F.inline(rows), "error")


def all_hints(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Hints of all four sources as ``fused`` takes them; ``starts`` has those by patterns (doc_id, line_idx, style)."""
    named = lambda hints, source: hints.select(F.lit(source).alias("source"), "doc_id", "line_idx", "ends", F.lit(None).cast("int").alias("style"))
    patterns = starts.select(F.lit("regex").alias("source"), "doc_id", "line_idx", F.lit(False).alias("ends"), "style")
    return patterns.unionByName(named(gap_hints(lines), "gap")).unionByName(named(indent_hints(lines), "indent")).unionByName(named(alphabet_hints(lines), "alphabet"))


def parted(lines: DataFrame, hints: DataFrame) -> DataFrame:
    """Lines with ``part`` and ``ref_no``: prologue before the first hint, a reference from each beginning on, epilogue from the end on. Documents without hints are all prologue."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    marks = hints.filter("error is null").groupBy("doc_id", "line_idx").agg(F.max("ends").alias("_ends"))
    at = lines.join(marks, ["doc_id", "line_idx"], "left")
    number = F.sum(F.when(~F.col("_ends"), 1).otherwise(0)).over(order).cast("long")
    over = F.coalesce(F.max("_ends").over(order), F.lit(False))
    part = F.when(over, "epilogue").when(number > 0, "reference").otherwise("prologue")
    return at.withColumns({"part": part, "ref_no": F.when(~over & (number > 0), number)}).drop("_ends")
