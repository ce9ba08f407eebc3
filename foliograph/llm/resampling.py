"""Target-distribution importance resampling over hashed features.

Texts are lower-cased (A-Z) and cut into words, runs of letters, digits and non-ASCII
characters; all runs of 1 to ``upto`` words are features, and a feature falls into the bucket
crc32 modulo ``buckets``. A first Arrow pass counts: every task adds up one vector of
``buckets`` places with np.bincount, and the vectors are merged by treeReduce, so that the
driver takes in a few of them, whatever the number of tasks. From the counts of all documents
and of the target every bucket gets a gain, the scaled logarithm of how much likelier it is in
the target; this table of fixed size is broadcast. A second pass gathers the gains and sums them
by document with np.bincount weights.

A document's score is its weight plus Gumbel noise made from its id. The best share of the
documents with enough words is drawn by order: rows are sorted by ranges, each range knows its
number of rows, and a row's rank is its place in the range behind all ranges before. No task
sees more than a range.

Null texts are empty: no features, weight 0, never drawn, but scored. A null id is an empty
text in the hash and comes last among equal scores; rows that repeat an id and a score are
ordered at will. An empty table gives an empty result; an empty target gives equal treatment to
all buckets but for their own counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import written
from foliograph.llm.wu_manber import words_of

#: Texts whose features are held at once.
_SOME = 256


def features_of(words: list[bytes], upto: int) -> list[bytes]:
    """All runs of 1 to ``upto`` words."""
    out = list(words)
    for size in range(2, upto + 1):
        out += [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
    return out


def buckets_of(features: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, features), np.int64, len(features)) % buckets


def counts(texts: DataFrame, buckets: int, upto: int, depth: int = 3) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``texts`` has one column."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, _SOME):
                found = [y for x in batch.column(0)[k : k + _SOME].to_pylist() for y in features_of(words_of(x), upto)]
                n += np.bincount(buckets_of(found, buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()])], ["n"])

    parts = texts.mapInArrow(counted, "n binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return parts.treeReduce(np.add, depth) if parts.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) for each bucket."""
    n, whole, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + n) / ((s + 1) * (wanted + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: str, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the sha256 of ``seed`` and the key."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(
    documents: DataFrame,
    target: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    upto: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: str = "2024:",
) -> DataFrame:
    """One row for each document: its id, n_features, weight, score and rank (from 1; null where not drawn), all but the id long."""
    spark = documents.sparkSession
    table = gains(counts(documents.select(f"`{text}`"), buckets, upto), counts(target.select(f"`{target_text}`"), buckets, upto))
    known = spark.sparkContext.broadcast(table.astype(np.float64))  # buckets doubles

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [pd.DataFrame(columns=["n_words", "n_features", "weight"], dtype=np.int64)]
            for k in range(0, len(batch), _SOME):
                words = [words_of(x) for x in batch.iloc[k : k + _SOME]]
                found = [features_of(w, upto) for w in words]
                sizes = [len(f) for f in found]
                bins = buckets_of([x for f in found for x in f], buckets)
                weights = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=known.value[bins], minlength=len(sizes))
                parts.append(pd.DataFrame({"n_words": [len(w) for w in words], "n_features": sizes, "weight": weights.astype(np.int64)}))
            yield pd.concat(parts, ignore_index=True)

    rows = documents.select(F.col(f"`{key}`").alias("id"), weighed(F.col(f"`{text}`")).alias("w"))
    scored = rows.select("id", "w.*", (F.col("w.weight") + noise("id", seed)).alias("score"))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "weighed")

    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    dealt = scored.filter(F.col("n_words") >= least_words).select("score", "id", "row").repartitionByRange(*order).sortWithinPartitions(*order)
    # an increasing id is the number of the range above the place in it
    placed = written(dealt.select("row", F.monotonically_increasing_id().alias("at")), "ranges")
    number, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in placed.groupBy(number).count().collect()}  # a row for each range
    before, start = [], 0
    for range_, n in sorted(sizes.items()):
        before.append((range_, start))
        start += n
    offsets = spark.createDataFrame(before, "range int, start long")
    ranks = placed.select("row", number.alias("range"), place.alias("place")).join(F.broadcast(offsets), "range").select("row", (F.col("start") + F.col("place") + 1).alias("rank"))
    drawn = ranks.filter(F.col("rank") <= start * percent // 100)
    return scored.join(drawn, "row", "left").select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
