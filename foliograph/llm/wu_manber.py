"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every
``window`` consecutive words of an item are a pattern; an item with fewer words, but with
any, is one pattern. Patterns of one length are searched together. A block is two words
(one, where the pattern has only one). The shift table says how far the search may jump
after a block, so most words of a document are never looked at; where the shift is zero,
the suffix bucket and in it the first block select patterns, which are then compared word
by word.

Patterns are broadcast. Their number is counted first: beyond ``max_patterns`` the items
are dealt into blocks by hash, and the documents pass once for each block, with what was
found so far kept in a table of the shared folder. Documents are never shuffled.

Null and empty texts have no words and no hits. Null items and items without words have no
patterns. Items of one id count once, however often the id repeats; a null id counts as
none, though its windows are searched. Each repeated document row is searched on its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import written

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FOUND = "n_words long, hits array<struct<start: int, stop: int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """Patterns of one length, each with the ids that have it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[str]]]]] = {}
        for pattern, ids in patterns.items():
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
            self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern[: self.block], []).append((pattern, ids))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, ids) of every occurrence."""
        m, b, far, shift = self.length, self.block, self.far, self.shift
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            jump = shift.get(block, far)
            if jump:
                end += jump
                continue
            start = end - m
            for pattern, ids in self.buckets[block].get(tuple(words[start : start + b]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, ids
            end += 1


def searchers(items: Iterable[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """One searcher for each length of pattern, from (id, text) items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            ids = by_length[size].setdefault(tuple(words[k : k + size]), set())
            if item is not None:
                ids.add(item)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def with_hits(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_patterns: int = 200_000) -> DataFrame:
    """The documents with n_words, hits (word spans inside occurrences, united) and items (ids found, in text order).

    These replace columns of such names.
    """
    names = ("n_words", "hits", "items")
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("body"))
    # white space and separators only over-count words, so this bounds the patterns
    words = F.size(F.split(F.coalesce("body", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(words).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // max_patterns))
    found = documents.select(*[documents[f"`{c}`"] for c in documents.columns if c not in names])
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == k)
        search = documents.sparkSession.sparkContext.broadcast(searchers(((r["id"], r["body"]) for r in part.collect()), window))
        before = F.struct("hits", "items") if k else F.lit(None).cast("struct<hits: array<struct<start: int, stop: int>>, items: array<string>>")
        found = found.withColumn("_found", _searched(search, F.col(text), before)).drop(*names).select("*", "_found.*").drop("_found")
        if k + 1 < blocks:
            found = written(found, "decontamination")
    return found


def _searched(search, text: Column, before: Column) -> Column:
    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, earlier in batches:
            rows = []
            for x, hits, items in zip(texts, earlier["hits"], earlier["items"]):
                words = words_of(x)
                spans = [(h["start"], h["stop"]) for h in hits] if hits is not None else []
                ids = set(items) if items is not None else set()
                for searcher in search.value:
                    for start, found in searcher.find(words):
                        spans.append((start, start + searcher.length))
                        ids |= found
                rows.append((len(words), [{"start": a, "stop": b} for a, b in united(spans)], sorted(ids)))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return scan(text, before)
