"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

Words are lower-cased runs of letters, digits and non-ASCII characters; five in a row are a
shingle, and a shorter text is one shingle. A shingle weighs its count times an inverse
document frequency, damped to between one half and one so that a large group of copies does
not weigh what its texts share by next to nothing. Document frequencies are counted over all
whole texts in ``slots`` hashed places, by the hashing trick: one pass, partial sums in each
task, and a result of fixed size that is broadcast. Shingles of one place share its count, so
a frequency is never too low, and too high by about the number of all shingles over ``slots``.

Texts with equal words are one node, told by a 128-bit digest. Improved consistent weighted
sampling draws ``bands * rows`` samples from each node's weights; two nodes agree on a sample
with the probability of their weighted Jaccard similarity. Nodes that agree on a whole band
share a bucket. Buckets are not expanded into pairs. First every node is compared with the
centre of each of its buckets, the node that shares buckets with most others; a group of near
copies becomes one class by that. Only buckets that then still hold several classes are
looked at again, completely: the nodes of the bucket's largest class and the others are dealt into
blocks, and every two blocks that are not both of the largest class meet in a group of
bounded size, first by their samples as one matrix, then, with the nodes that these leave, by
their texts. A pair that shares an earlier band is
left to that band's bucket, and a pair whose classes the block has already joined is
skipped, so what comes out is at most one link for each class joined. A link is always
decided by the weighted Jaccard similarity of whole texts. Links join classes, whose names
spread along links and then by pointer jumping.

Null texts count as empty, and texts without words are copies of each other. Ids may be null
or repeat: a class is named by its least id that is not null. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.shared import written

_TO_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_rng = np.random.default_rng(20_240_101)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[32] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(0, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_TIMES = _rng.integers(0, 2**63, 512, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 2**63, 512, dtype=np.uint64)
_GRID = np.linspace(0, 40, 400_001)
#: Quantiles of Gamma(2, 1) at the middle of 65,536 equal steps, and their logarithms.
_GAMMA = np.interp((np.arange(65_536) + 0.5) / 65_536, 1 - (1 + _GRID) * np.exp(-_GRID), _GRID).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_WIDTH = 64
_UNIFORM = ((np.arange(65_536) + 0.5) / 65_536).astype(np.float32)
#: Where the high, second and third 16 bits of a 64-bit number lie in memory.
_HIGH = (3, 2, 1) if sys.byteorder == "little" else (0, 1, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> bytes:
    """The words, with one space between."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())


def shingles(words: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles as 64-bit hashes, ascending, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = np.frombuffer(words, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    spread = _PLACES[place & 15] + _STEP * (place >> 4).astype(np.uint64)
    hashes = _mixed(np.add.reduceat(_BYTES[raw] * (spread | np.uint64(1)), starts))
    n = len(hashes) - size + 1
    if n < 1:
        size, n = len(hashes), 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _STEP + hashes[k : k + n]
    return np.unique(_mixed(total + np.uint64(size)), return_counts=True)


def slots_of(found: np.ndarray, slots: int) -> np.ndarray:
    """The slots of shingles; ``slots`` is a power of two."""
    return (found >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


class Weights:
    """Shingle weights: how often a shingle occurs times its inverse document frequency, between one half and one."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def of(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times * (0.5 + 0.5 * self.idf[slots_of(found, len(self.idf))])


def samples(found: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples, each as one 64-bit value."""
    best, chosen = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
    logs = np.log(weights).astype(np.float32)
    columns = np.arange(n)
    for k in range(0, len(found), 2048):
        some = found[k : k + 2048]
        x = some[:, None] * _TIMES[None, :n] + _PLUS[None, :n]
        part = x.view(np.uint16).reshape(*x.shape, 4)  # the high bits of a product are the well mixed ones
        r, c, beta = _GAMMA.take(part[..., _HIGH[0]]), _LOG_GAMMA.take(part[..., _HIGH[1]]), _UNIFORM.take(part[..., _HIGH[2]])
        t = np.floor(logs[k : k + 2048, None] / r + beta)
        value = c - r * (t - beta + 1)
        row = value.argmin(0)
        least = value[row, columns]
        better = least < best
        best = np.where(better, least, best)
        chosen = np.where(better, _mixed(some[row] + t[row, columns].astype(np.int64).view(np.uint64) * _STEP), chosen)
    return chosen


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending shingles, weights); 1 for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = np.minimum(a[1][both], b[1][at[both]]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total)


def similarities(a: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``similarity`` of one to each of several, none of them empty."""
    found, weights = (np.concatenate(x) for x in zip(*others))
    at = np.minimum(np.searchsorted(a[0], found), len(a[0]) - 1)
    common = np.where(a[0][at] == found, np.minimum(weights, a[1][at]), 0.0)
    starts = np.cumsum([0, *(len(x[0]) for x in others[:-1])])
    common, own = np.add.reduceat(common, starts), np.add.reduceat(weights, starts)
    return common / (own + a[1].sum() - common)


def document_frequencies(texts: DataFrame, size: int, slots: int) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold a shingle of each slot.

    Every task counts all its texts in one array and hands it on in rows of ``_WIDTH`` slots, those
    without counts left out; these are summed slot by slot.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n[slots_of(shingles(words_of(x), size)[0], slots)] += 1
        chunks = n.reshape(-1, _WIDTH)
        some = np.flatnonzero(chunks.any(1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(chunks[some].ravel()), _WIDTH).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), values], ["chunk", "n"])

    parts = texts.mapInArrow(counted, "chunk long, n array<long>")
    total, out = texts.count(), np.zeros(slots, np.int64)
    for row in parts.groupBy("chunk").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(_WIDTH)]).collect():
        out[row[0] * _WIDTH : (row[0] + 1) * _WIDTH] = row[1:]
    return total, out


def inverse_frequencies(total: int, counts: np.ndarray) -> np.ndarray:
    """For each slot log(1 + total / count) as a share of its largest value, that of a count of one."""
    return (np.log1p(total / np.maximum(counts, 1)) / np.log1p(max(total, 1))).astype(np.float32)


def classes(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    bands: int = 15,
    rows: int = 4,
    slots: int = 1 << 20,
) -> DataFrame:
    """One row for each document: its id, ``node`` (digest of its words), ``class_id`` (the least id of its class) and ``label`` (the least node of its class)."""
    weights = Weights(inverse_frequencies(*document_frequencies(documents.select(text), size, slots)))
    n = bands * rows

    def sign(words: bytes) -> tuple[list[int], bytes]:
        found, times = shingles(words, size)
        drawn = samples(found, weights.of(found, times), n)
        buckets = np.zeros(bands, np.uint64)
        for k in range(rows):
            buckets = _mixed(buckets * _STEP + drawn[k::rows] + np.arange(bands, dtype=np.uint64))
        return buckets.view(np.int64), drawn.astype(np.uint16).tobytes()

    @F.pandas_udf("node binary, bands array<long>, drawn binary")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            out = []
            for x in batch:
                words = words_of(x)
                node = hashlib.blake2b(words, digest_size=16).digest()
                if node not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[node] = (node, *sign(words))
                out.append(known[node])
            yield pd.DataFrame(out, columns=["node", "bands", "drawn"], dtype=object)

    rows_signed = written(documents.select(F.col(key).alias("id"), _sum(text).alias("sum"), signed(F.col(text)).alias("s")).select("id", "sum", "s.*"), "signed")
    nodes = written(rows_signed.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("id", "sum")).alias("row"), F.first("bands").alias("bands"), F.first("drawn").alias("drawn")), "nodes")
    member = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = member.join(sizes, "bucket")
    weight = F.sum("n").over(Window.partitionBy("node"))
    members = written(members.select("band", "bucket", "node", weight.alias("weight")), "members")
    labels = written(members.select("node").distinct().withColumn("label", F.col("node")), "labels")
    drawn = written(nodes.join(labels, "node", "left_semi").select("node", "drawn", "bands"), "drawn")
    bodies = written(_bodies(documents, nodes.join(labels, "node", "left_semi").select("node", "row.*"), key, text), "bodies")

    centres = members.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    pairs = members.join(centres, "bucket").filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    labels = _merged(labels, _verified(_likely(pairs, drawn, threshold, n), bodies, weights, size, threshold))
    labels = _merged(labels, _across(members.drop("weight"), labels, drawn, bodies, weights, size, threshold, n))
    grouped = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = grouped.groupBy("label").agg(F.min("id").alias("class_id"))
    of_node = grouped.join(names, "label").select("node", "class_id", "label")
    return rows_signed.select(F.col("id").alias(key), "node").join(of_node, "node").select(key, "node", "class_id", "label")


def _digest(text: str):
    @F.pandas_udf("binary")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([hashlib.blake2b(words_of(x), digest_size=16).digest() for x in batch], dtype=object)

    return digest(F.col(text))


def _sum(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _bodies(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, body): the text of each wanted (node, id, sum). The digest of the text is a key beside the id, so that a text meets only its own node."""
    wanted = wanted.select("node", F.col("id").alias("_id"), F.col("sum").alias("_sum"))
    texts = documents.select(F.col(key).alias("_key"), F.col(text).alias("body"), _sum(text).alias("_of"))
    found = texts.join(wanted, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_sum")))
    return found.groupBy("node").agg(F.first("body").alias("body"))


def _least(n: int, threshold: float) -> float:
    """Agreeing samples of ``n`` that a similar pair has: four standard deviations below what it should have."""
    return n * threshold - 4 * (n * threshold * (1 - threshold)) ** 0.5


def _likely(pairs: DataFrame, drawn: DataFrame, threshold: float, n: int) -> DataFrame:
    """The pairs (a, b) whose samples agree often enough. They are written, so that no task holds a Python worker for these beside one for the texts."""
    least = _least(n, threshold)

    @F.pandas_udf("boolean")
    def likely(left: pd.Series, right: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, n) for x in (left, right))
        return pd.Series((a == b).sum(1) >= least)

    a, b = (drawn.select(F.col("node").alias(c), F.col("drawn").alias(f"drawn_{c}")) for c in "ab")
    return written(pairs.join(a, "a").join(b, "b").filter(likely("drawn_a", "drawn_b")).select("a", "b"), "likely")


def _across(members: DataFrame, labels: DataFrame, drawn: DataFrame, bodies: DataFrame, weights: Weights, size: int, threshold: float, n: int, block: int = 512) -> DataFrame:
    """Links (a, b) that join classes within buckets that hold several classes.

    A bucket's nodes are dealt into blocks of about ``block``, those of its largest class and
    the others apart. A group is two blocks, at least one of them of the others, so that no
    group grows with the bucket. Groups see samples only; texts come to the nodes whose samples
    agree with another's in the group. Groups are many, so a task's frame holds several.
    Buckets of two are settled: one of them was the other's centre.
    """
    least = _least(n, threshold)
    place = ["band", "bucket", "x", "y"]
    placed = members.join(labels, "node")
    mixed = placed.groupBy("band", "bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).filter("a != b and n > 2").select("band", "bucket", "n")
    counts = placed.join(mixed.select("band", "bucket"), ["band", "bucket"]).groupBy("band", "bucket", "label").agg(F.count("*").alias("k"))
    largest = counts.groupBy("band", "bucket").agg(F.max(F.struct("k", "label")).alias("l")).select("band", "bucket", F.col("l.label").alias("largest"), F.col("l.k").alias("k"))
    many = lambda c: F.ceil(c / block).cast("int")
    blocks = mixed.join(largest, ["band", "bucket"]).select("band", "bucket", "largest", many(F.col("k")).alias("majors"), many(F.col("n") - F.col("k")).alias("minors"))
    minor = F.col("label") != F.col("largest")
    own = F.pmod(F.xxhash64("node"), F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int")
    # x is a block of the largest class, or one of the others counted down from -1; y is one of the others
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    group = lambda x, y, left, here: F.struct(x.alias("x"), y.alias("y"), left.alias("left"), here.alias("here"))
    among = each(F.col("minors"), lambda k: group(-1 - F.least(own, k), F.greatest(own, k), own >= k, own <= k))
    with_majors = each(F.col("majors"), lambda k: group(k, own, F.lit(True), F.lit(False)))
    as_major = each(F.col("minors"), lambda k: group(own, k, F.lit(False), F.lit(True)))
    to = F.when(minor, F.concat(with_majors, among)).otherwise(as_major)
    dealt = placed.join(blocks, ["band", "bucket"]).select("band", "bucket", "node", "label", F.explode(to).alias("to")).select("band", "bucket", "node", "label", "to.*")

    def framed(dealt: DataFrame) -> DataFrame:
        frames = max(1, dealt.count() // 2000)
        return dealt.withColumn("frame", F.pmod(F.xxhash64(*place), F.lit(frames))).join(drawn, "node")

    def each_group(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return (frame.iloc[rows] for rows in frame.groupby(place, sort=False).indices.values())

    def agreeing(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each left row with the rows here that its samples allow, and how many samples agree."""
        samples_of = np.frombuffer(b"".join(frame["drawn"]), np.uint16).reshape(-1, n)
        earlier = np.array(frame["bands"].tolist(), np.int64)[:, : frame["band"].iloc[0]]
        classes_of = pd.factorize(frame["label"])[0]
        here = np.flatnonzero(frame["here"])
        for i in np.flatnonzero(frame["left"]):
            agree = (samples_of[here] == samples_of[i]).sum(1)
            some = (agree >= least) & (classes_of[here] != classes_of[i]) & ~(earlier[here] == earlier[i]).any(1)
            yield i, here[some], agree[some]

    def needed(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group in each_group(frame):
            hit = np.zeros(len(group), bool)
            for i, others, _ in agreeing(group):
                hit[others] = True
                hit[i] |= len(others) > 0
            out.append(group[hit])
        return pd.concat(out)[["node", "label", *place, "left", "here"]]

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([x for group in each_group(frame) for x in links_in(group)], columns=["a", "b"], dtype=object)

    def links_in(frame: pd.DataFrame) -> list[tuple[bytes, bytes]]:
        classes_of = pd.factorize(frame["label"])[0]
        parent = list(range(len(frame)))
        nodes, bodies_of, lefts = frame["node"].tolist(), frame["body"].tolist(), frame["left"].to_numpy()
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: list[tuple[bytes, bytes]] = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def weighed(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in known:
                mine, times = shingles(words_of(bodies_of[k]), size)
                known[k] = (mine, weights.of(mine, times))
            return known[k]

        for i, others, agree in agreeing(frame):
            # two nodes of one block meet twice, and are compared once
            left = [j for j in others[np.argsort(-agree, kind="stable")] if not (lefts[j] and nodes[j] < nodes[i])]
            while left := [j for j in left if root(classes_of[j]) != root(classes_of[i])]:
                now, left = left[:64], left[64:]
                for j, alike in zip(now, similarities(weighed(i), [weighed(j) for j in now])):
                    a, b = root(classes_of[i]), root(classes_of[j])
                    if alike >= threshold and a != b:
                        parent[a] = b
                        found.append((nodes[i], nodes[j]))
        return found

    looked = framed(written(dealt, "dealt")).groupBy("frame").applyInPandas(needed, "node binary, label binary, band int, bucket long, x int, y int, left boolean, here boolean")
    looked = framed(written(looked, "needed")).join(bodies, "node")
    return written(looked.groupBy("frame").applyInPandas(joined, "a binary, b binary"), "across")


def _verified(pairs: DataFrame, bodies: DataFrame, weights: Weights, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked for."""

    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def weighed(x: str) -> tuple[np.ndarray, np.ndarray]:
            if x not in known:
                if len(known) > 64:
                    known.clear()
                found, times = shingles(words_of(x), size)
                known[x] = (found, weights.of(found, times))
            return known[x]

        for left, right in batches:
            yield pd.Series([similarity(weighed(x), weighed(y)) for x, y in zip(left, right)], dtype="float64")

    a, b = (bodies.select(F.col("node").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab")
    texts = pairs.join(b, "b").join(a, "a")
    return written(texts.filter(similar("body_a", "body_b") >= threshold).select("a", "b"), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after the classes that links connect have become one, named by its least node."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").select("la", "lb").filter("la != lb").distinct()
    edges = written(ends.select(F.col("la").alias("x"), F.col("lb").alias("y")).union(ends.select("lb", "la")), "edges")
    if edges.isEmpty():
        return labels
    names = written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("name")), "names")
    while True:
        near = edges.join(names.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("name").alias("near"))
        closer = names.join(near, "x").select("x", F.col("name").alias("old"), F.least("name", "near").alias("name"))
        jump = names.select(F.col("x").alias("name"), F.col("name").alias("further"))
        moved = written(closer.join(jump, "name", "left").select("x", "old", F.least("name", F.coalesce("further", "name")).alias("name")), "names")
        names = moved.select("x", "name")
        if moved.filter(F.col("old") != F.col("name")).isEmpty():
            break
    return written(labels.join(names.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("name", "label").alias("label")), "labels")


def deduplicated(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, that of the least id; ids that are null come last."""
    found = classes(documents, key=key, text=text, **options)
    first = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("id"))
    # the node of each class that holds its least id; classes may share that id or have none, so their label tells them apart
    nodes = found.groupBy("label").agg(F.min(F.struct(first(key), F.col("node"))).alias("m")).select(F.col("m.node").alias("_node"))
    columns = [documents[f"`{c}`"] for c in documents.columns]
    one = documents.select(F.struct(*columns).alias("_row"), F.col(key).alias("_key"), _digest(text).alias("_node")).groupBy("_node").agg(F.min_by("_row", first("_key")).alias("_row"))
    return one.join(nodes, "_node", "left_semi").select("_row.*")
