"""N-gram Jaccard join by parity sketches.

A document's set holds its different shingles of five words as 64-bit hashes. Texts with one
set are one node. Two sets of n and m shingles whose Jaccard similarity is at least t differ in
at most (1 - t) / (1 + t) * (n + m) shingles, and m is at most n / t.

Sketches. Every shingle toggles one place of a bit vector, so two sets differ in at least as
many shingles as their vectors differ in places. The vector of a size band, whose sets have from
2^g to 2^(g+1) - 1 shingles, is cut into blocks, and what is kept of a block, whose places are
2^64, is the XOR of the hashes in it. Sets that differ in d shingles differ in at most d blocks. Each
set takes its d + 1 blocks of most shingles, d being the most by which it can differ from a
partner: of two sets whose blocks all but d agree, the first d + 1 in one common order share
one, and this order, by the number of shingles and then place, looks at nothing but the block
itself. So linked sets share a bucket (band, place, XOR), and no bucket needs to hold empty blocks or such of one
common shingle. A set stands in its own band and, if a smaller partner may be in the band below, in
that too. A second sketch of about two bits for each shingle goes with the set, and pairs
whose sketches differ in more places than linked sets can are left without looking at texts.

Buckets are never expanded into pairs. Buckets that hold the same nodes count once. Each node is
compared with the least node of its buckets, which joins a group of near copies. Buckets that then still hold
several classes are looked at again completely: nodes are dealt into blocks of bounded size,
every two blocks that are not both of the bucket's largest class meet, first by sketches, then,
with the nodes that these leave, by the sets of whole texts. Links join classes.

Null and empty texts and those without words have empty sets, are linked with nothing and form a
class each. A text of fewer words than a shingle is one shingle. Ids may be null or repeat: a class is named by
its least id that is not null. Repeated rows are linked. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.near_dups import _merged, _mixed, shingles
from foliograph.llm.shared import written

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_STEP, _BAND = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def words_of(text: str | None) -> bytes:
    """The words, with one space between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return shingles(words_of(text), size)[0]


class Measure:
    """Jaccard similarity of at least ``percent`` of 100, in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def apart(self, total: int | np.ndarray) -> int | np.ndarray:
        """By how many shingles sets of ``total`` together may differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def largest(self, n: int) -> int:
        """The largest size of a partner of a set of ``n``."""
        return n * 100 // self.percent

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def places(band: int, measure: Measure) -> int:
    """Blocks of a band: a fifth more than the shingles by which its sets may differ, and some more where these are few."""
    n = 2 ** (band + 1) - 1
    return measure.apart(n + measure.largest(n)) * 6 // 5 + 8


def buckets(found: np.ndarray, measure: Measure) -> np.ndarray:
    """The buckets of a set of ascending hashes."""
    n = len(found)
    band, out = n.bit_length() - 1, []
    if n:
        out.append(_first(found, band, places(band, measure), measure.apart(n + measure.largest(n)) + 1))
    below = 2**band - 1
    if n and below and n <= measure.largest(below):
        out.append(_first(found, band - 1, places(band - 1, measure), measure.apart(n + below) + 1))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _first(found: np.ndarray, band: int, blocks: int, wanted: int) -> np.ndarray:
    place = ((found >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascending, as the hashes are
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    full = place[starts].astype(np.int64)
    sums, size = np.zeros(blocks, np.uint64), np.zeros(blocks, np.int64)
    sums[full] = np.bitwise_xor.reduceat(found, starts)
    size[full] = np.diff(np.append(starts, len(found)))
    chosen = np.argsort(-size, kind="stable")[:wanted]
    return _mixed(_mixed(sums[chosen] + _STEP * chosen.astype(np.uint64)) + np.uint64(_BAND * (band + 1) % 2**64))


def sketch(found: np.ndarray) -> bytes:
    """Two to four bits for each shingle, 64 at least: which places were toggled an odd number of times."""
    bits = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch_: bytes, words: int) -> np.ndarray:
    """A sketch as so many 64-bit words; a longer one is folded, which cannot add to a distance."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch_, np.uint64).reshape(-1, words), axis=0)


def may_link(a: bytes, b: bytes, n: int, m: int, measure: Measure) -> bool:
    if measure.percent * max(n, m) > 100 * min(n, m):
        return False
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) <= measure.apart(n + m)


def classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, max_broadcast: int = 250_000, block: int = 512) -> DataFrame:
    """One row for each document: its id, ``n_shingles`` and ``component_id`` (the least id that links lead to; its own for an empty set)."""
    measure = Measure(percent)

    @F.pandas_udf("node binary, n long, sketch binary, buckets array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch:
                found = shingle_set(x, size)
                node = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                out.append((node, len(found), sketch(found), buckets(found, measure).view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "sketch", "buckets"])

    rows = documents.select(F.col(f"`{key}`").alias("id"), _sum(F.col(f"`{text}`")).alias("sum"), signed(F.col(f"`{text}`")).alias("s"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "sum", "s.*"), "sketched")
    full = rows.filter("n > 0")
    own = full.groupBy("node").agg(F.min("row").alias("uid"), F.min("id").alias("id"), F.count("*").alias("copies"))
    own = written(own, "nodes")
    # all but one row of each set are left out; most sets have one
    again = _small(written(full.select("node", "row").join(own.filter("copies > 1").select("node", "uid"), "node").filter("row != uid").select("row"), "copies"), max_broadcast)
    nodes = full.join(again, "row", "left_anti").select(F.col("row").alias("uid"), "id", "sum", "n", "sketch", "buckets")
    member = nodes.select("uid", F.explode("buckets").alias("bucket"))
    mark = F.xxhash64("uid")
    shared = member.groupBy("bucket").agg(F.min("uid").alias("least"), F.max("uid").alias("last"), F.bit_xor(mark).alias("mark"), F.count("*").alias("n")).filter("least != last")
    # buckets of the same nodes count once
    shared = written(shared.groupBy("mark", "least", "last", "n").agg(F.min("bucket").alias("bucket")), "shared")
    # buckets grow with the table, so both sides are dealt by bucket at every size
    several = written(member.join(shared.filter("n > 2").select("bucket", "least").hint("merge"), "bucket").select("bucket", "uid", "least"), "members")

    facts = nodes.select("uid", "n", "sketch")
    pairs = shared.filter("n = 2").select("least", F.col("last").alias("uid")).union(several.filter("uid != least").select("least", "uid")).distinct()
    likely = written(_likely(pairs, facts, measure), "likely")
    labels = written(several.select("uid").union(shared.select("least")).union(shared.select("last")).distinct().select(F.col("uid").alias("node"), F.col("uid").alias("label")), "labels")
    where = nodes.select("uid", "id", "sum")
    texts = lambda wanted, name: _bodies(documents, where, wanted, key, text, max_broadcast, name)
    ends = likely.select(F.col("a").alias("uid")).union(likely.select("b")).distinct()
    labels = _merged(labels, _verified(likely, texts(ends, "texts-of-pairs"), size, measure))
    labels = _merged(labels, _across(several.select("bucket", "uid"), labels, facts, texts, size, measure, block))
    grouped = own.select("node", "uid", "id").join(labels.select(F.col("node").alias("uid"), "label"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    names = grouped.groupBy("label").agg(F.min("id").alias("component_id"))
    of_node = grouped.join(names, "label").select("node", "component_id")
    known = rows.select("id", "n", "node").join(of_node, "node", "left")
    return known.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _sum(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _small(table: DataFrame, most: int) -> DataFrame:
    """The table, to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def _bodies(documents: DataFrame, where: DataFrame, wanted: DataFrame, key: str, text: str, max_broadcast: int, name: str) -> DataFrame:
    """(uid, body) of the wanted nodes. Up to ``max_broadcast`` of them are sent to the documents, else both are dealt by id and digest."""
    wanted = _small(written(where.join(wanted, "uid"), f"{name}-wanted"), max_broadcast)
    body = documents.select(F.col(f"`{key}`").alias("_id"), _sum(F.col(f"`{text}`")).alias("_sum"), F.col(f"`{text}`").alias("body"))
    found = body.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_sum") == F.col("sum"))).select("uid", "body")
    return written(found, name).dropDuplicates(["uid"])  # rows that repeat in all are there several times


def _likely(pairs: DataFrame, facts: DataFrame, measure: Measure) -> DataFrame:
    """The pairs, as (a, b), that sizes and sketches allow."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_link(*each, measure) for each in zip(x, y, n, m)], dtype=bool)

    a, b = (facts.select(F.col("uid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    near = pairs.select(F.col("least").alias("a"), F.col("uid").alias("b")).join(a, "a").join(b, "b")
    return near.filter(likely("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")


def _verified(pairs: DataFrame, bodies: DataFrame, size: int, measure: Measure) -> DataFrame:
    """The pairs (a, b) that are linked."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}

        def of(x: str) -> np.ndarray:
            if x not in known:
                if len(known) > 64:
                    known.clear()
                known[x] = shingle_set(x, size)
            return known[x]

        for left, right in batches:
            yield pd.Series([measure.linked(of(x), of(y)) for x, y in zip(left, right)], dtype=bool)

    a, b = (bodies.select(F.col("uid").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab")
    return written(pairs.join(b, "b").join(a, "a").filter(linked("body_a", "body_b")).select("a", "b"), "links")


def _across(members: DataFrame, labels: DataFrame, facts: DataFrame, texts, size: int, measure: Measure, block: int) -> DataFrame:
    """Links (a, b) that join classes within buckets that hold several classes.

    The nodes of a bucket's largest class and the others are dealt into blocks apart. A group is
    two blocks, at least one of them of the others, so no group grows with the bucket.
    """
    place = ["bucket", "x", "y"]
    placed = written(members.join(labels.select(F.col("node").alias("uid"), "label"), "uid"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).filter("a != b").select("bucket", "n")
    in_mixed = placed.join(mixed, "bucket")
    by_class = in_mixed.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    largest = by_class.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("l"), F.max("n").alias("n"))
    many = lambda c: F.ceil(c / block).cast("int")
    blocks = largest.select("bucket", F.col("l.label").alias("largest"), many(F.col("l.k")).alias("majors"), many(F.col("n") - F.col("l.k")).alias("minors"))
    minor = F.col("label") != F.col("largest")
    mine = F.pmod(F.xxhash64("uid"), F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    group = lambda x, y, left, here: F.struct(x.alias("x"), y.alias("y"), left.alias("left"), here.alias("here"))
    # x is a block of the largest class, or one of the others counted down from -1; y is one of the others
    among = each(F.col("minors"), lambda k: group(-1 - F.least(mine, k), F.greatest(mine, k), mine >= k, mine <= k))
    with_majors = each(F.col("majors"), lambda k: group(k, mine, F.lit(True), F.lit(False)))
    as_major = each(F.col("minors"), lambda k: group(mine, k, F.lit(False), F.lit(True)))
    to = F.when(minor, F.concat(with_majors, among)).otherwise(as_major)
    dealt = written(placed.join(blocks, "bucket").select("bucket", "uid", "label", F.explode(to).alias("to")).select("bucket", "uid", "label", "to.*").join(facts.select("uid", "n"), "uid"), "dealt")

    def framed(dealt: DataFrame) -> DataFrame:
        shingled = dealt.agg(F.sum("n")).first()[0] or 0
        return dealt.withColumn("frame", F.pmod(F.xxhash64(*place), F.lit(max(1, int(shingled // 500_000)))))

    def each_group(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return (frame.iloc[rows] for rows in frame.groupby(place, sort=False).indices.values())

    def near(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Each left row with the rows here of other classes that sizes and sketches allow; two rows of one block meet once."""
        words = min(map(len, group["sketch"])) // 8
        bits = np.stack([folded(x, words) for x in group["sketch"]])
        uid, n, label = (group[c].to_numpy() for c in ("uid", "n", "label"))
        left, here = group["left"].to_numpy(), group["here"].to_numpy()
        for i in np.flatnonzero(left):
            fits = here & (label != label[i]) & (measure.percent * np.maximum(n, n[i]) <= 100 * np.minimum(n, n[i])) & ~(left & (uid < uid[i]))
            rows = np.flatnonzero(fits)
            apart = np.bitwise_count(bits[rows] ^ bits[i]).sum(1)
            yield i, rows[apart <= measure.apart(n[rows] + n[i])]

    def needed(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group in each_group(frame):
            hit = np.zeros(len(group), bool)
            for i, others in near(group):
                hit[others] = True
                hit[i] |= len(others) > 0
            out.append(group[hit])
        return pd.concat(out)[["bucket", "uid", "label", "x", "y", "left", "here", "n"]]

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([x for group in each_group(frame) for x in links_in(group)], columns=["a", "b"], dtype=np.int64)

    def links_in(group: pd.DataFrame) -> list[tuple[int, int]]:
        label, bodies, uid = pd.factorize(group["label"])[0].tolist(), group["body"].tolist(), group["uid"].tolist()
        parent, known, found = list(range(len(group))), {}, []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def of(k: int) -> np.ndarray:
            if k not in known:
                known[k] = shingle_set(bodies[k], size)
            return known[k]

        for i, others in near(group):
            for j in others.tolist():
                a, b = root(label[i]), root(label[j])
                if a != b and measure.linked(of(i), of(j)):
                    parent[a] = b
                    found.append((uid[i], uid[j]))
        return found

    sketches = facts.select("uid", "sketch")
    looked = framed(dealt).join(sketches, "uid").groupBy("frame").applyInPandas(needed, "bucket long, uid long, label long, x int, y int, left boolean, here boolean, n long")
    looked = written(looked, "needed")
    bodies = texts(looked.select("uid").distinct(), "texts-of-groups")
    return written(framed(looked).join(sketches, "uid").join(bodies, "uid").groupBy("frame").applyInPandas(joined, "a long, b long"), "across")
