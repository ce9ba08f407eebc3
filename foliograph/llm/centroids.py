"""Centroid clustering by weighted deduplication.

A vector is kept if it has exactly ``dims`` components, none of them null, NaN or infinite. A
component x becomes the integer floor(scale * x). Equal integer vectors become one row with
their number, so that a group of copies, however large, costs one row in every round. The
rounds run on these rows: each task sums its vectors, times their number, by centroid, and
only these sums are shuffled. Sums, floors and squared distances are integers, so the result
does not depend on how rows are dealt out. At last the assignments are joined back to the
ids by a 128-bit digest of the integer vector; a hot digest can be split there, as nothing
but the join needs its rows together.

Ties: of equally near centroids the one of the smaller number; of equal start hashes (ids that
repeat) the smaller vector. Vectors with a null id are clustered but start no centroid; where
no vector can start one, cluster and all that follows are null. Fewer kept vectors than ``k``
make fewer centroids. Repeated rows count as often as they occur. An empty table gives an empty
result. Integer components are held within 2^27 in size, so that distances fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import written

_MOST = 2.0**27
_OUT = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """The integer vector, null where the vector is not kept."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    bounded = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(-_MOST)), F.lit(_MOST))
    return F.when((F.size(vector) == dims) & whole, F.transform(vector, lambda x: F.floor(bounded(x)).cast("int")))


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centre, the smaller one of several, and the squared distance."""
    best, distance = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.iinfo(np.int64).max)
    for k, centre in enumerate(centres):
        apart = vectors - centre
        now = np.einsum("ij,ij->i", apart, apart)
        closer = now < distance
        best[closer], distance[closer] = k, now[closer]
    return best, distance


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moved(distinct: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after one round: floor(sum / count) of what is nearest to each; a centre without vectors stays."""
    dims = centres.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), dims + 1), np.int64)
        for batch in batches:
            q, n = _matrix(batch, dims), batch.column("n").to_numpy()
            cluster = nearest(q, centres)[0]
            for k in np.unique(cluster):
                own = cluster == k
                total[k, :dims] += n[own] @ q[own]
                total[k, dims] += n[own].sum()
        some = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(some)), pa.int32()), pa.array(total[some].ravel())],
            ["cluster", "place", "total"],
        )

    parts = distinct.select("q", "n").mapInArrow(summed, "cluster int, place int, total long")
    out = centres.copy()
    found = {(r[0], r[1]): int(r[2]) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}
    for (cluster, place), total in found.items():
        if place < dims:
            out[cluster, place] = total // found[cluster, dims]
    return out


def _assigned(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    dims = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch, dims), centres)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(cluster), pa.array(distance)], ["node", "n", "cluster", "distance"])

    return distinct.select("q", "node", "n").mapInArrow(assign, "node binary, n long, cluster int, distance long")


def clusters(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """One row for each kept vector: its id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` (the final one of its cluster).

    Centroids start as the ``k`` kept vectors whose ids, as text behind ``seed``, have the smallest sha256.
    """
    spark = embeddings.sparkSession
    kept = embeddings.select(F.col(f"`{key}`").alias("id"), quantised(F.col(f"`{vector}`"), dims, scale).alias("q")).filter(F.col("q").isNotNull())
    node = F.unhex(F.md5(F.array_join(F.col("q").cast("array<string>"), ",").cast("binary"))).alias("node")
    distinct = written(kept.groupBy("q").agg(F.count("*").alias("n")).select("q", node, "n"), "distinct-vectors")
    first = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    starts = kept.filter(F.col("id").isNotNull()).select(first.alias("hash"), "q").orderBy("hash", "q").limit(k).collect()
    if not starts:
        return kept.select(F.col("id").alias(key), *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _OUT.split(", ")])
    centres = np.array([r["q"] for r in starts], np.int64)
    for _ in range(rounds):
        moved = _moved(distinct, centres)
        if (moved == centres).all():
            break  # all further rounds would give the same
        centres = moved
    assigned = written(_assigned(distinct, centres), "assigned-vectors")
    worth = F.sum(F.col("n").cast("decimal(38,0)") * F.col("distance"))
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(worth).collect()}  # a row for each centre
    whole, most = sum(sums.values()), 2**63 - 1
    facts = spark.createDataFrame([(c, min(x, most), min(whole, most), centres[c].tolist()) for c, x in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    known = assigned.select("node", "cluster", "distance").join(F.broadcast(facts), "cluster")
    return kept.select("id", node).join(known, "node").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas, in lowercase hex."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ",").cast("binary"), 256)
