"""Best-fit packing: conflict-constrained best-fit decreasing into bins of fixed capacity.

Sizes are words between white space. A text longer than a bin is cut into full pieces, each a
bin of its own, and a rest; texts and rests are packed, largest first, each into the fullest
bin it fits. Two conflicts rule a bin out: it already holds a piece of the same duplicate
cluster (texts of equal words), or ``per_source`` pieces of the same source. Bins carry both
as bitmaps, and are kept in the order of their free space; the search starts at the tightest
bin that is large enough and goes on to its successors until a compatible one is found, so
it finds the tightest compatible bin, or opens a new one.

Documents are dealt by a hash of id and words into shards of about ``shard_rows``, whatever
their source or cluster, and every shard is packed on its own. Rows that repeat are counted,
numbered in blocks and dealt by their number as well, so no shard gets them all. Only ids,
sizes, sources and digests are shuffled, never texts. The number of shards grows with the table.

Null, empty and wordless texts take no space and are in no bin. A null source is a source
like others. Null and repeated ids are kept as they are; each row is packed on its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.near_dups import words_of
from foliograph.llm.shared import written

_BINS = 1 << 24  # more than a shard can have


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """The bin of each item, from 0, for items no larger than ``capacity``."""
    place: dict = {}
    for x in sources:
        place.setdefault(x, len(place) * per_source)
    many = [x for x, n in Counter(clusters).items() if n > 1]
    bit_of = {x: 1 << k for k, x in enumerate(many)}
    full = (1 << per_source) - 1
    bins: list[int] = [0] * len(sizes)
    free: list[tuple[int, int]] = []  # (space left, bin), ascending
    of_source: list[int] = []
    of_cluster: list[int] = []
    held: list[list[int]] = []  # clusters of each bin, and of each cluster the bins with space left that hold it
    open_with: Counter = Counter()
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, cluster, at = sizes[k], bit_of.get(clusters[k], 0), place[sources[k]]
        slots = full << at
        i = bisect_left(free, (size, -1)) if open_with[cluster] < len(free) else len(free)
        while i < len(free) and (of_cluster[free[i][1]] & cluster or of_source[free[i][1]] & slots == slots):
            i += 1
        if i < len(free):
            left, b = free.pop(i)
            open_with.subtract(held[b])
        else:
            left, b = capacity, len(of_source)
            of_source.append(0)
            of_cluster.append(0)
            held.append([])
        taken = (of_source[b] & slots) >> at
        of_source[b] |= ((taken << 1) | 1) << at
        of_cluster[b] |= cluster
        bins[k] = b
        if cluster:
            held[b].append(cluster)
        if left > size:
            insort(free, (left - size, b))
            open_with.update(held[b])
    return bins


def packed(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, per_source: int = 4, shard_rows: int = 4096) -> DataFrame:
    """One row for each piece: bin_id, the id, the source, piece (from 0), start and stop (words) and n_words."""

    @F.pandas_udf("n long, cluster binary")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len((x or "").split()), hashlib.blake2b(words_of(x), digest_size=16).digest()) for x in batch]
            yield pd.DataFrame(rows, columns=["n", "cluster"])

    sized = written(documents.select(F.col(key).alias("id"), F.col(source).alias("source"), measured(F.col(text)).alias("m")).select("id", "source", "m.*").filter("n > 0"), "sized")
    shards = max(1, -(-sized.count() // shard_rows))
    # equal rows are told apart by their number: blocks of it first, so that no task writes out a large group alone
    same = sized.groupBy("id", "source", "n", "cluster").agg(F.count("*").alias("times"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(shard_rows).cast("long"))).alias("block")
    blocks = same.select("id", "source", "n", "cluster", "times", block)
    number = F.explode(F.sequence(F.col("block"), F.least(F.col("times"), F.col("block") + shard_rows) - 1))
    once, more = blocks.filter("times = 1").withColumn("number", F.lit(0).cast("long")), blocks.filter("times > 1").repartition("id", "cluster", "block").withColumn("number", number)
    dealt = once.union(more).select("id", "source", "n", "cluster", F.pmod(F.xxhash64("id", "cluster", "number"), F.lit(shards)).alias("shard"))
    types = {f.name: f.dataType.simpleString() for f in sized.schema.fields}

    def pack(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        shard = table["shard"][0].as_py()
        rests = [k for k, n in enumerate(sizes) if n % capacity or n == 0]
        bins = best_fit([sizes[k] % capacity for k in rests], [table["source"][k].as_py() for k in rests], [table["cluster"][k].as_py() for k in rests], capacity, per_source)
        opened = max(bins, default=-1) + 1
        rows: list[tuple[int, int, int]] = [(b, k, sizes[k] // capacity) for b, k in zip(bins, rests)]
        for k, n in enumerate(sizes):
            for piece in range(n // capacity):
                rows.append((opened, k, piece))
                opened += 1
        at = pa.array([k for _, k, _ in rows], pa.int64())
        starts = [piece * capacity for *_, piece in rows]
        stops = [min(sizes[k], (piece + 1) * capacity) for _, k, piece in rows]
        return pa.table(
            {
                "bin_id": pa.array([shard * _BINS + b for b, *_ in rows], pa.int64()),
                key: table["id"].take(at),
                source: table["source"].take(at),
                "piece": pa.array([p for *_, p in rows], pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "stop": pa.array(stops, pa.int64()),
                "n_words": pa.array([b - a for a, b in zip(starts, stops)], pa.int64()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(pack, f"bin_id long, `{key}` {types['id']}, `{source}` {types['source']}, piece int, start long, stop long, n_words long")
