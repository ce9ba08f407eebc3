"""Labels carried from a text to another reading of it, by alignment in a band.

The old text is gone through character by character. For each there is one row of costs: for every
place of the new text within the band, the fewest changes that lead there. The band moves with
the cheapest place. Costs of one row in so many are kept, and the way back is found again
from these, block by block, so memory is the band times the root of the text's length.
Beginnings and ends of the new text that the old one lacks: the end is free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAR = 1 << 29
_OUT = "width int, spans array<struct<label: string, start: int, stop: int>>"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Band:
    """The alignment of ``old`` to ``new`` within ``width`` places to both sides of the cheapest one."""

    def __init__(self, old: str, new: str, width: int, most_cells: int = 1 << 25):
        self.old, self.new, self.width = _codes(old), _codes(new), width
        self.cells = np.arange(2 * width + 1)
        self.bases = np.zeros(len(self.old), np.int64)
        # short texts keep all ways back, long ones the costs of one row in so many
        self.every = len(self.old) if len(self.old) * len(self.cells) <= most_cells else math.isqrt(len(self.old))
        self.kept: dict[int, np.ndarray] = {}
        self.ways: list[np.ndarray] = []
        costs = None
        for row in range(len(self.old)):
            if row and row % self.every == 0:
                self.kept[row] = costs
            costs, way = self._row(row, costs)
            if self.every == len(self.old):
                self.ways.append(way)
            if row + 1 < len(self.old):
                self.bases[row + 1] = self.bases[row] + costs.argmin() - width
        self.costs = costs

    @property
    def cost(self) -> int:
        return int(self.costs.min())

    def _row(self, row: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Costs of a row and how each was reached: 0 as the same or another character, 1 without one of the new text, 2 over one of it."""
        offset = self.bases[row] + self.cells - self.width
        at = row + offset
        valid = (at >= 0) & (at < len(self.new))
        differs = self.new[np.clip(at, 0, len(self.new) - 1)] != self.old[row]
        if before is None:
            return np.where(valid, differs + offset, _FAR), np.zeros(len(at), np.uint8)
        padded = np.full(len(before) + 2 * len(before) + 1, _FAR)
        padded[len(before) : 2 * len(before)] = before
        shift = int(self.bases[row] - self.bases[row - 1])
        start = min(max(len(before) + shift, 0), 2 * len(before))
        same, none = padded[start : start + len(before)] + differs, padded[start + 1 : start + 1 + len(before)] + 1
        best = np.where(valid, np.minimum(same, none), _FAR)
        costs = np.where(valid, np.minimum.accumulate(best - self.cells) + self.cells, _FAR)
        over = np.concatenate([[_FAR], costs[:-1] + 1])
        return costs, np.where((same <= none) & (same <= over), 0, np.where(none < over, 1, 2)).astype(np.uint8)

    def places(self) -> np.ndarray:
        """The place in the new text for each character of the old one."""
        n, width = len(self.old), self.width
        out = np.zeros(n, np.int64)
        offset = int(self.bases[-1] + self.costs.argmin() - width)
        for first in range((n - 1) // self.every * self.every, -1, -self.every):
            rows, costs, ways = range(first, min(n, first + self.every)), self.kept.get(first), self.ways
            if not ways:
                ways = []
                for row in rows:
                    costs, way = self._row(row, costs)
                    ways.append(way)
            for row in reversed(rows):
                out[row] = offset
                cell = offset - int(self.bases[row]) + width
                while cell > 0 and ways[row - first][cell] == 2:
                    cell -= 1
                offset = int(self.bases[row]) + cell - width + (row > 0 and int(ways[row - first][cell] == 1))
        # what was skipped in the new text belongs to the character behind it
        return _led(out) + np.arange(n)


def _led(offsets: np.ndarray) -> np.ndarray:
    """Offsets where each that is larger than the one before it takes that one's, from the end on."""
    out = offsets.copy()
    rises = np.flatnonzero(offsets[1:] > offsets[:-1]) + 1
    out[rises] = offsets[rises - 1]
    return out


def cost(a: str, b: str, width: int = 400) -> int:
    """Changes that lead from the longer text to a beginning of the shorter one."""
    short, long = sorted((a, b), key=len)
    return Band(long, short, width).cost if short else len(long)


#: Texts that are aligned beside each other: enough that numpy's calls count little, few enough for the cache.
_TOGETHER = 128


def places_of(pairs: list[tuple[str, str]], width: int, most_cells: int = 1 << 25) -> list[np.ndarray]:
    """``Band(old, new, width).places()`` of many pairs, row by row beside each other; texts too long to keep all ways back go on their own."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pairs)
    some: list[int] = []
    # longest first, so that those which still have rows stand in front
    for k in sorted(range(len(pairs)), key=lambda k: -len(pairs[k][0])):
        if len(pairs[k][0]) * (2 * width + 1) > most_cells:
            found[k] = Band(*pairs[k], width, most_cells).places()
            continue
        if some and (len(some) == _TOGETHER or len(pairs[some[0]][0]) * (len(some) + 1) * (2 * width + 1) > most_cells):
            for i, places in zip(some, _beside([pairs[i] for i in some], width)):
                found[i] = places
            some = []
        some.append(k)
    if some:
        for i, places in zip(some, _beside([pairs[i] for i in some], width)):
            found[i] = places
    return found


def _beside(pairs: list[tuple[str, str]], width: int) -> list[np.ndarray]:
    """``Band.places`` of pairs, none empty, the longest old text first: the same rows with one more axis."""
    olds, news = [_codes(old) for old, _ in pairs], [_codes(new) for _, new in pairs]
    sizes, ends = np.array([len(x) for x in olds]), np.array([len(x) for x in news])
    n, length, cells = len(pairs), 2 * width + 1, np.arange(2 * width + 1, dtype=np.int32)
    old = np.zeros((n, sizes[0]), np.uint32)
    # new texts go on with their first and last character
    new = np.zeros((n, ends.max() + 2 * length), np.uint32)
    for k, (x, y) in enumerate(zip(olds, news)):
        old[k, : len(x)] = x
        new[k, :length], new[k, length : length + len(y)], new[k, length + len(y) :] = y[0], y, y[-1]
    seen = np.lib.stride_tricks.sliding_window_view(new, length, axis=1)
    padded = np.full((n, 3 * length + 1), _FAR, np.int32)
    before = np.lib.stride_tricks.sliding_window_view(padded, length, axis=1)
    bases, shift, out, ways = np.zeros((sizes[0], n), np.int64), np.zeros(n, np.int64), np.zeros((n, sizes[0]), np.int64), []
    last = np.zeros(n, np.int64)
    for row in range(sizes[0]):
        m = int(np.searchsorted(-sizes, -row, side="left"))  # pairs with more rows than this
        each, base = np.arange(m), bases[row, :m]
        first = row + base - width
        at = first.astype(np.int32)[:, None] + cells
        valid = (at >= 0) & (at < ends[:m, None])
        differs = seen[each, np.clip(first, -length, ends[:m]) + length] != old[:m, row, None]
        if row == 0:
            costs, way = np.where(valid, differs + at, _FAR), np.zeros((m, length), np.uint8)
        else:
            start = np.clip(length + shift[:m], 0, 2 * length)
            same, none = before[each, start] + differs, before[each, start + 1] + 1
            best = np.where(valid, np.minimum(same, none), _FAR)
            costs = np.where(valid, np.minimum.accumulate(best - cells, axis=1) + cells, _FAR)
            over = np.full((m, length), _FAR, np.int32)
            over[:, 1:] = costs[:, :-1] + 1
            way = np.where((same <= none) & (same <= over), 0, np.where(none < over, 1, 2)).astype(np.uint8)
        ways.append(way)
        padded[:m, length : 2 * length] = costs
        shift = costs.argmin(axis=1) - width
        done = sizes[:m] == row + 1
        last[:m][done] = (base + shift)[done]
        if row + 1 < sizes[0]:
            bases[row + 1, :m] = base + shift
    offset = last
    for row in range(sizes[0] - 1, -1, -1):
        way, m = ways[row], len(ways[row])
        each, base = np.arange(m), bases[row, :m]
        out[:m, row] = offset[:m]
        cell = offset[:m] - base + width
        taken = way[each, cell]
        while (back := (taken == 2) & (cell > 0)).any():
            cell -= back
            taken = way[each, cell]
        offset[:m] = base + cell - width + ((taken == 1) if row else 0)
    return [_led(out[k, :size]) + np.arange(size) for k, size in enumerate(sizes)]


def _changes(old: np.ndarray, new: np.ndarray, places: np.ndarray) -> int:
    """Changes on the way that ``places`` shows from the old text to the new one, which begins and ends with it."""
    steps = np.diff(places)
    stays = np.concatenate([[False], steps == 0])
    return int(stays.sum() + (~stays & (old != new[places])).sum() + np.maximum(steps - 1, 0).sum())


def _told(old: str, new: str, places: np.ndarray, span: tuple[str, int, int]) -> bool:
    """Whether less than half of a span of 6 to 999 characters changes."""
    _, x, y = span
    a, b = int(places[x]), int(places[y - 1]) + 1
    if not 0 <= a < b <= len(new):
        return False
    if not 5 < y - x < 1000 or old[x:y] == new[a:b]:
        return True
    # a way of so few changes lies in the band of ``cost``, which then cannot be larger: what is within 200 changes
    # is no more than 200 places aside, and so is the cheapest place that the band moves with
    steps = places[x:y] - a
    if steps[0] == 0 and (np.diff(steps) >= 0).all() and (way := _changes(_codes(old[x:y]), _codes(new[a:b]), steps)) <= 200 and way < 0.5 * (y - x):
        return True
    return cost(old[x:y], new[a:b]) < 0.5 * (y - x)


def aligned_all(texts: list[tuple[str, str, list[tuple[str, int, int]]]], widths: tuple[int, ...] = (100, 200, 400, 800, 1600)) -> list[tuple[int, list[tuple[str, int, int]]] | None]:
    """``aligned`` of many texts (old, new, spans)."""
    found: list[tuple[int, list[tuple[str, int, int]]] | None] = [None] * len(texts)
    todo = []
    for k, (old, new, spans) in enumerate(texts):
        if not spans:
            found[k] = (0, [])
        elif new and abs(len(old) - len(new)) <= max(1000, len(old) / 2):
            todo.append(k)
    for width in widths:
        some, todo = todo, []
        for k, places in zip(some, places_of([texts[k][:2] for k in some], width)):
            old, new, spans = texts[k]
            if all(_told(old, new, places, span) for span in spans):
                found[k] = width, [(label, int(places[x]), int(places[y - 1]) + 1) for label, x, y in spans]
            else:
                todo.append(k)
    return found


def aligned(old: str, new: str, spans: list[tuple[str, int, int]], widths: tuple[int, ...] = (100, 200, 400, 800, 1600)) -> tuple[int, list[tuple[str, int, int]]] | None:
    """The spans (label, start, stop not included) in the new text and the width that told them; the first width at which none of 6 to 999 characters changes by half or more. None if none does, or sizes are far apart."""
    return aligned_all([(old, new, spans)], widths)[0]


def aligned_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (doc_id, label, start, stop) of old texts in the new ones, beside the ``width`` of the band; documents (doc_id, old, new) whose texts do not align have one row with nulls.

    Null texts are empty. Empty spans and spans outside of the old text are left out. A document is aligned as a whole by one task, short ones beside each other.
    """

    @F.pandas_udf(_OUT)
    def carried(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for olds, news, wanted in batches:
            texts = [(old or "", new or "", [(x["label"], x["start"], x["stop"]) for x in some if 0 <= x["start"] < x["stop"] <= len(old or "")]) for old, new, some in zip(olds, news, wanted)]
            out = [(None, None) if found is None else (found[0], [{"label": n, "start": a, "stop": b} for n, a, b in found[1]]) for found in aligned_all(texts)]
            yield pd.DataFrame(out, columns=["width", "spans"]).astype({"width": "Int32"})

    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "label"))).alias("wanted"))
    parts = 4 * documents.sparkSession.sparkContext.defaultParallelism  # the work is far larger than the rows
    told = documents.join(listed, "doc_id").repartition(parts, "doc_id").select("doc_id", carried("old", "new", "wanted").alias("a"))
    return told.select("doc_id", "a.width", F.explode_outer("a.spans").alias("s")).select("doc_id", "width", "s.label", "s.start", "s.stop")
