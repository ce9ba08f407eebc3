"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents, maps homoglyphs of other scripts and digit or sign
substitutions to letters, drops zero-width characters and collapses white space. A lexicon
entry is a word, or the beginning of a word (written with ``*``). A match inside an
exception phrase does not count. The weights of what matched, alone and for each word of
the text, give the score by a logistic curve.

Entries are learned from labelled documents: those words and word beginnings whose presence
(or, where one use is common, whose repeated use) speaks most for label 1, chosen greedily so
that each explains documents that the earlier ones do not, until none does; exception phrases
are pairs of words, one of them an entry, that only label-0 documents use. Beginnings have
``least`` to ``most`` letters, as words and not texts are cut to them. Learning sees at most
``max_rows`` labelled documents (a hash sample), written once to the shared folder; that is the
only bound. Candidates are counted in Spark; the driver gets those that tell the labels apart,
and which of them each sampled document contains. Scoring covers every whole text. Of entries
that tell as much, the whole word, then the longer, then the last by name comes first.

Null and empty texts match nothing and get the score of a text without matches. Without
labelled rows the seed lexicon alone is used. Each repeated row is scored on its own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import labelled_sample, written

#: Words that count as entries before anything is learned, with their weight.
SEEDS = {"idiot": 4.0, "moron": 4.0, "imbecile": 4.0, "scumbag": 4.0, "worthless": 3.0, "pathetic": 3.0, "stupid": 3.0}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser", "idiot proof", "pond scum")

_LETTERS = {
    **dict(zip("авекмнорстухіјѕԁɡһӏ", "abekmhopctyxijsdghl")),
    **dict(zip("αβεικνορτυχ", "abeikvoptux")),
    **{c: "" for c in "­​‌‍⁠﻿"},
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
_DIGITS = str.maketrans("013457", "oieast")
_SIGNS = re.compile(r"[@$!](?=[^\W\d_])")
_SIGN_OF = {"@": "a", "$": "s", "!": "i"}
_WORD = re.compile(r"[^\W\d_]+")


class _Fold(dict):
    """Code point to folded text, worked out once for each character met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower() if code > 127 else c
        self[code] = out = "".join(_LETTERS.get(x, x) for x in plain)
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = text.translate(_DIGITS)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGNS.sub(lambda m: _SIGN_OF[m[0]], text)
    return " ".join(text.split())


@dataclass
class Lexicon:
    """Entry weights, exception phrases and the curve: bias, slope of the sum, slope of the sum for each word."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.5)

    def __post_init__(self):
        self.machine = ahocorasick.Automaton()
        for entry in self.weights:
            self.machine.add_word(entry.rstrip("*"), ())
        phrases = {folded(x) for x in self.exceptions}
        for phrase in phrases:
            self.machine.add_word(phrase, ())
        for text in list(self.machine.keys()):
            self.machine.add_word(text, (len(text), tuple(e for e in (text, text + "*") if e in self.weights), text in phrases))
        if len(self.machine):
            self.machine.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve)

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, entry) in folded text; a longer match hides those inside it."""
        if not len(self.machine):
            return []
        found, excepted, size = [], [], len(text)
        for last, (length, entries, exception) in self.machine.iter(text):
            start, end = last - length + 1, last + 1
            if start and text[start - 1].isalpha():
                continue
            whole = end == size or not text[end].isalpha()
            if exception and whole:
                excepted.append((start, end))
            found += [(start, end, e) for e in entries if whole or e.endswith("*")]
        if excepted:  # how far the exceptions reach that begin up to each
            excepted.sort()
            starts, reach = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
            found = [x for x in found if not (k := bisect_right(starts, x[0])) or reach[k - 1] < x[1]]
        best: dict[int, tuple[int, int, str]] = {}
        for x in found:  # all begin where a word begins
            if x[0] not in best or (x[1], not x[2].endswith("*")) > (best[x[0]][1], not best[x[0]][2].endswith("*")):
                best[x[0]] = x
        return sorted(best.values())

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + weight found), log(1 + weight found for 100 words)."""
        plain = folded(text)
        total = sum(self.weights[e] for _, _, e in self.matches(plain))
        return math.log1p(total), math.log1p(100 * total / (plain.count(" ") + 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-(a + b * x + c * y)))


def _candidates(text: str | None, least: int, most: int) -> Counter:
    """Uses of words and word beginnings."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(folded(text))).items():
        out[w] += n
        for k in range(least, min(most, len(w) - 1) + 1):
            out[w[:k] + "*"] += n
    return out


def _pairs(text: str | None, entries: dict[str, float]) -> set[str]:
    """Neighbouring words of which one is an entry."""
    words = _WORD.findall(folded(text))
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if a in entries or b in entries}


def _small(batches: Iterator[pd.DataFrame], rows: int = 200) -> Iterator[pd.DataFrame]:
    """The same rows in small frames, so that counts held at a time stay few."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def fit(documents: DataFrame, labels: DataFrame, learn, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, least: int = 3, most: int = 9, support: int = 4, cover: int = 3, tasks: int = 48) -> Lexicon:
    """Learn a lexicon from at most ``max_rows`` labelled documents."""
    few = labelled_sample(labels, key, label, learn, max_rows)
    # an id may repeat: one text of each, so that the sample is bounded by the labels
    texts = documents.select(key, text).join(F.broadcast(few), key).groupBy(key, "y").agg(F.max(text).alias(text)).select("y", text)
    texts = written(texts.repartition(tasks), "toxicity-sample")

    columns = ("n1", "n0", "m1", "m0")  # documents of either label with one use, and with two

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _small(batches):
            found: dict[str, list[int]] = {}
            for y, x in zip(batch["y"], batch[text]):
                for entry, uses in _candidates(x, least, most).items():
                    row = found.setdefault(entry, [0, 0, 0, 0])
                    row[1 - y] += 1
                    row[3 - y] += uses > 1
            counts = pd.DataFrame(list(found.values()), columns=list(columns), dtype="int64")
            yield counts.assign(entry=pd.Series(list(found), dtype=object))[["entry", *columns]]

    n1, n0 = few.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = int(n1 or 0), int(n0 or 0)
    if not n1 or not n0:
        return Lexicon(dict(SEEDS))
    odds = lambda one, zero: F.log((F.col(one) + 0.5) / (n1 + 1)) - F.log((F.col(zero) + 0.5) / (n0 + 1))
    counts = texts.mapInPandas(counted, "entry string, n1 long, n0 long, m1 long, m0 long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns])
    once, twice = (F.col("n1") >= support) & (F.col("w") > 2.5), (F.col("m1") >= support) & (F.col("w2") > 2.5)
    worth = F.greatest(F.when(once, F.col("w") * F.sqrt("n1")), F.when(twice, F.col("w2") * F.sqrt("m1")))
    ranked = counts.withColumn("w", odds("n1", "n0")).withColumn("w2", odds("m1", "m0")).filter((F.col("w") > 1) & (once | twice))
    best = ranked.withColumn("need", F.when(once, 1).otherwise(2)).orderBy(F.desc(worth), "entry").collect()
    weights, need = {r["entry"]: float(r["w"]) for r in best}, {r["entry"]: r["need"] for r in best}

    @F.pandas_udf("array<string>")
    def contained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sorted(e for e, uses in _candidates(x, least, most).items() if uses >= need.get(e, uses + 1)) for x in batch])

    rows = texts.select("y", contained(F.col(text)).alias("has")).collect() if weights else []
    entries = {e: weights[e] for e in _cover([(r["y"], r["has"]) for r in rows], max(support - 1, n1 // 100), cover)}

    def in_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _small(batches):
            pairs = [(y, p) for y, x in zip(batch["y"], batch[text]) for p in _pairs(x, entries)]
            yield pd.DataFrame({"entry": pd.Series([p for _, p in pairs], dtype=object), "y": pd.Series([y for y, _ in pairs], dtype="int64")})

    pairs = texts.mapInPandas(in_pairs, "entry string, y long").groupBy("entry").agg(F.sum("y").alias("n1"), F.count("y").alias("n"))
    safe = pairs.filter((F.col("n1") == 0) & (F.col("n") >= support))
    phrases = sorted(r["entry"] for r in safe.collect()) if entries else []
    lexicon = Lexicon({**SEEDS, **entries}, [*EXCEPTIONS, *phrases])

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([list(lexicon.features(x)) for x in batch])

    rows = texts.select("y", measured(F.col(text)).alias("x")).toPandas()
    rows = sorted((*x, y) for x, y in zip(rows["x"], rows["y"]))  # sums in one order, whatever the tasks
    lexicon.curve = _logistic(np.array([x[:2] for x in rows], float), np.array([x[2] for x in rows], float))
    return lexicon


def _cover(rows: list[tuple[int, list[str]]], least: int, times: int) -> list[str]:
    """Entries in the order chosen: each time the one that tells most of the open documents apart; a document is open until ``times`` entries hold it."""
    gain: Counter = Counter()
    holders: dict[str, list[int]] = {}
    for k, (y, entries) in enumerate(rows):
        for e in entries:
            gain[e] += 1 if y else -1
            holders.setdefault(e, []).append(k)
    chosen: list[str] = []
    covered = [0] * len(rows)
    while gain:
        entry = max(gain, key=lambda e: (gain[e], not e.endswith("*"), len(e), e))
        if gain[entry] < least:
            break
        chosen.append(entry)
        stem = entry.rstrip("*")
        for e in [e for e in gain if stem.startswith(e.rstrip("*")) or e.startswith(stem)]:
            del gain[e]  # itself, and what would count the same uses again
        for k in holders[entry]:
            covered[k] += 1
            if covered[k] == times:
                for e in rows[k][1]:
                    if e in gain:
                        gain[e] -= 1 if rows[k][0] else -1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton's method with a small ridge on the slopes; slopes are held at 0 or more."""
    z = np.column_stack([np.ones(len(x)), x.reshape(-1, 2)])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, ridge * 10, ridge * 10])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([0, ridge * 10, ridge * 10]) * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    if b[1] < 0 or b[2] < 0:
        keep = 1 if b[1] >= b[2] else 2
        fallback = _logistic(np.column_stack([x[:, keep - 1], np.zeros(len(x))]), y, ridge) if x[:, keep - 1].any() else (-4.0, 1.0, 0.0)
        return (fallback[0], max(0.0, fallback[1]), 0.0) if keep == 1 else (fallback[0], 0.0, max(0.0, fallback[1]))
    return tuple(map(float, b))


def with_score(documents: DataFrame, lexicon: Lexicon, *, text: str = "text", score: str = "score") -> DataFrame:
    """The documents with a score column; ``score`` replaces a column of that name."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([lexicon.score(x) for x in batch], dtype="float64")

    return documents.withColumn(score, scored(F.col(text)))
