"""Positions of regular-expression matches as DataFrame expressions.

Spark returns what a pattern matched and what it left between, but not where. Both come from
the same left-to-right scan, so running lengths of the pieces and matches give each match's
place, in code points. A fold that appends to an array copies it at every step, so pieces are
folded in blocks of about the square root of their number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind: string, start: int, stop: int, body: string>"
_NONE = f"array<{SPAN}>"


def matches(text: Column, pattern: str, kind: str, test: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches; ``test`` may tell cheaply that there are none. ``text`` must not be null."""
    pair = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["hit"].alias("body"))
        return F.struct(stop.alias("at"), F.when(x["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    none = F.array().cast(_NONE)

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    size = F.ceil(F.sqrt(F.size(pair))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(pair), size), lambda k: F.slice(pair, k, size))
    found = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_NONE}>").alias("out")), block, lambda state: state["out"]))
    return F.when(text.rlike(pattern) if test is None else test & text.rlike(pattern), found).otherwise(none)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be among the columns."""
    taken = {c.lower() for c in columns}
    longest = max(map(len, taken), default=0)
    return [next(n for k in range(longest + 1) if (n := name + "_" * k) not in taken) for name in names]


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def ordered(spans: Column, kinds: tuple[str, ...], by_start: bool) -> Column:
    """The spans by start and then kind as listed, or by kind as listed and then start; kinds that are not listed come last, by name."""
    place = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), x["kind"]), F.lit(0)), F.lit(len(kinds) + 1))
    keyed = F.transform(spans, lambda x: F.struct(*([x["start"], place(x)] if by_start else [place(x), x["start"]]), x["kind"], x["stop"], x.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn test."""
    reverse = F.transform(F.split(F.reverse(number), ""), lambda x: x.cast("int"))
    total = F.aggregate(
        F.transform(reverse, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
        F.lit(0),
        lambda n, d: n + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0
