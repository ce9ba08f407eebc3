"""Quality classifier: a generalised additive model with pairwise interactions.

Training is cyclic boosting. In each round every feature in turn gets one shallow tree of
the current residuals over that feature's bins; the trees of a feature add up to one lookup
table. Pairs of features whose joint table would explain most of what is left then get
two-dimensional tables in the same way. A score is the sum of the table entries that a
document's bins select, so scoring is a few vectorised look-ups and additions.

The model is fitted on at most ``max_rows`` labelled documents (a hash sample), whose
feature rows are the only thing that comes to the driver; scoring covers every document.

Null and empty texts have the features of a text without words and get a score like any
other. Without labelled rows every score is 0.5. Rows that repeat are scored each on its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import labelled_sample

FEATURES = (
    "log_chars",
    "log_words",
    "upper",
    "digits",
    "spaces",
    "stops",
    "symbols",
    "bars",
    "bangs",
    "non_ascii",
    "word_chars",
    "distinct_words",
    "top_word",
    "symbol_ends",
    "repeated_lines",
    "line_words",
    "echoed_words",
    "log_longest_word",
)


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_UPPER, _LETTER, _DIGIT, _SPACE = (_table(x) for x in (bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)), b"0123456789", b" \t\n\r\x0b\x0c"))
_STOP, _SYMBOL = _table(b".,;:?'\"()-"), _table(b"#$%&*<>^~@\\/_+={}[]`")
_SYMBOL_END = tuple("#$%&*|<>!^~")


def text_features(text: str | None) -> list[float]:
    """One row in the order of FEATURES; shares are of bytes, words or lines and 0 where there are none."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    histogram, size = np.bincount(raw, minlength=256), max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    longest = max(map(len, counts), default=0)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        histogram[_UPPER].sum() / max(1, histogram[_LETTER].sum()),
        histogram[_DIGIT].sum() / size,
        histogram[_SPACE].sum() / size,
        histogram[_STOP].sum() / size,
        histogram[_SYMBOL].sum() / size,
        histogram[ord("|")] / size,
        histogram[ord("!")] / size,
        histogram[128:].sum() / size,
        len(text) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(k for w, k in counts.items() if w.endswith(_SYMBOL_END)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        np.log1p(longest),
    ]


def _best_cuts(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf values by bin of a tree with at most ``leaves`` leaves, split greedily where the gain is largest."""
    g, w = np.concatenate([[0.0], gradient.cumsum()]), np.concatenate([[0.0], weight.cumsum()])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            k = np.arange(a + 1, b)
            k = k[(w[k] - w[a] >= least) & (w[b] - w[k] >= least)]
            if len(k):
                gains = gain(a, k) + gain(k, b) - gain(a, b)
                if gains.max() > best:
                    best, at = gains.max(), int(k[gains.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The two-dimensional tree of one cut on each axis with the largest gain, and that gain."""
    g, w = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (gradient, weight))
    parts = []
    for x in (g, w):
        a, b, c, d = x[1:-1, 1:-1], x[1:-1, -1:], x[-1:, 1:-1], x[-1, -1]
        parts.append(np.stack([a, b - a, c - a, d - b - c + a]))
    gains = (parts[0] ** 2 / (parts[1] + 1.0)).sum(0)
    if not gains.size:
        return 0.0, np.zeros_like(gradient)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    values = parts[0][:, i, j] / (parts[1][:, i, j] + 1.0)
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gains.max()), out


@dataclass
class QualityModel:
    """Bin edges, the prior and the lookup tables."""

    prior: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each feature row."""
        total = np.full(len(x), self.prior)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_tables(x: np.ndarray, y: np.ndarray, *, bins: int = 32, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1, leaves: int = 3, least: float = 2.0) -> QualityModel:
    """Fit the additive model to feature rows ``x`` and labels ``y``."""
    if not len(y):
        return QualityModel(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    k = x.shape[1]
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(k)]
    edges, coarse = quantiles(bins), quantiles(pair_bins)
    binned = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)]
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate_1 / (1 - rate_1)))
    model = QualityModel(prior, edges, [np.zeros(len(e) + 1) for e in edges], coarse=coarse)
    total = np.full(len(y), prior)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = residual()
            size = len(edges[j]) + 1
            step = rate * _best_cuts(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size), leaves, least)
            model.tables[j] += step
            total += step[binned[j]]
    small = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(k)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(small[a] * cols + small[b], v, rows * cols).reshape(rows, cols)

    g, h = residual()
    gains = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:pairs]]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for t, (a, b) in zip(model.pair_tables, model.pairs):
            g, h = residual()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            t += step
            total += step[small[a], small[b]]
    return model


def fit(documents: DataFrame, labels: DataFrame, learn, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **options) -> QualityModel:
    """Learn from at most ``max_rows`` labelled documents; ``learn`` is the condition on label rows that allows it."""
    few = labelled_sample(labels, key, label, learn, max_rows)

    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([text_features(x) for x in batch])

    rows = documents.select(key, text).join(F.broadcast(few), key).select(key, "y", features(F.col(text)).alias("x")).groupBy(key, "y").agg(F.max("x").alias("x")).orderBy(key, "y").toPandas()
    return fit_tables(np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(float), **options)


def with_score(documents: DataFrame, model: QualityModel, *, text: str = "text", score: str = "score") -> DataFrame:
    """The documents with a score column; ``score`` replaces a column of that name."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(np.array([text_features(x) for x in batch], float).reshape(-1, len(FEATURES))), dtype="float64")

    return documents.withColumn(score, scored(F.col(text)))
