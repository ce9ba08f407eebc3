"""Clustering, importance resampling and the parity sketch join against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.llm import centroids, parity_join, resampling
from llm.fixtures import awkward, documents


def plain_clusters(rows: list[tuple], *, dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3:") -> list[tuple]:
    """(id, cluster, distance) of the kept vectors, by loops over every row."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centres = [q for _, q in starts]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(q)[1] for _, q in kept]
        for j in range(len(centres)):
            own = [q for (_, q), c in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept] if centres else []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, q int, distance string")


def test_clusters_equal_plain_loops(spark):
    draw = random.Random(5)
    rows = [(k, [draw.gauss(draw.choice([-3, 0, 4]), 1) for _ in range(4)]) for k in range(150)]
    rows += [(1000 + k, rows[7][1]) for k in range(200)]  # a hot vector
    rows += [(7, rows[7][1])] * 3 + [(None, [0.1, -0.1, 0.0, 9.0])]
    bad = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 0.0, 0.0]), (5, [1.0, float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (8, [1.0] * 5)]
    out = centroids.clusters(vectors(spark, [(*r, 1, "x") for r in rows + bad]), dims=4, k=5)
    found = out.collect()
    exact = [(i, [float(np.float32(x)) for x in v] if v is not None and None not in v else v) for i, v in rows + bad]
    assert Counter((r[0], r[1], r[2]) for r in found) == Counter(plain_clusters(exact, dims=4, k=5))
    sums = Counter()
    for r in found:
        sums[r["cluster"]] += r["distance"]
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in found)


def test_cluster_edges(spark):
    empty = vectors(spark, []).limit(0)
    assert centroids.clusters(empty, dims=2).count() == 0
    alone = centroids.clusters(vectors(spark, [(None, [1.0, 2.0], 1, None)] * 2), dims=2).collect()
    assert [tuple(r) for r in alone] == [(None,) * 6] * 2
    few = centroids.clusters(vectors(spark, [(1, [1.0, 2.0], 1, None), (2, [3.0e38, -3.0e38], 1, None)]), dims=2, k=8).collect()
    assert {(r["vec_id"], r["distance"]) for r in few} == {(1, 0), (2, 0)}
    ties = centroids.nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert ties[0].tolist() == [0, 0] and ties[1].tolist() == [1, 1]


def plain_resampled(rows, target, buckets, least_words, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda w: crc32(w.encode()) % buckets
    s, t = (Counter(bucket(w) for text in texts for w in words(text)) for texts in ([r[1] for r in rows], target))
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets)))) for b in range(buckets)}
    out = []
    for key, text in rows:
        w = words(text)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in w)
        out.append([key, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


def test_resampling_equals_plain_version(spark):
    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice(["Alpha", "beta", "gamma", "d3", "Éa", "x-y"]) for _ in range(draw.randrange(0, 40)))) for k in range(300)]
    rows += [(k, rows[1][1]) for k in range(300, 420)] + [(5, rows[5][1])] * 4 + [(None, "beta " * 30), (1000, None), (1001, ""), (1002, "word " * 60_000)]
    target = ["alpha beta", None, "", "gamma gamma d3"]
    df = documents(spark, [(*r, "en", "s") for r in rows]).withColumn("score", F.lit("x")).withColumn("w", F.lit(1))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resampled(df, bench, buckets=50, least_words=10, percent=30).collect()
    assert Counter(map(tuple, out)) == plain_resampled(rows, target, 50, 10, 30)
    assert resampling.resampled(df.limit(0), bench).count() == 0
    assert resampling.resampled(df, bench.limit(0)).count() == len(rows)
    odd = awkward(spark)
    assert resampling.resampled(odd, bench).count() == odd.count()


def test_features_of_several_words():
    assert resampling.features_of([b"a", b"b", b"c"], 2) == [b"a", b"b", b"c", b"a b", b"b c"]


def plain_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def plain_classes(rows, percent=80):
    sets, name = [plain_set(t) for _, t in rows], list(range(len(rows)))
    root = lambda k: k if name[k] == k else root(name[k])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                name[root(i)] = root(j)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[root(k)] = min(key, least.get(root(k), key))
    return Counter((key, len(sets[k]), least.get(root(k)) if sets[k] else key) for k, (key, _) in enumerate(rows))


def edited(draw, words, share):
    """Some words changed, some dropped or added at the ends."""
    out = [draw.choice("pqrstuv") + w if draw.random() < share else w for w in words]
    return out[draw.randrange(0, 3) :] + [f"z{draw.random()}" for _ in range(draw.randrange(0, 3))]


def test_parity_join_equals_all_pairs(spark):
    draw, rows = random.Random(11), []
    for group in range(25):
        n = draw.choice([1, 3, 5, 6, 9, 13, 20, 40, 90, 200, 500])
        words = [f"w{draw.randrange(10**6)}" for _ in range(n)]
        for _ in range(draw.choice([1, 2, 5, 12])):
            rows.append((len(rows), " ".join(edited(draw, words, draw.choice([0, 0.01, 0.02, 0.04, 0.1])))))
    passage = " ".join(f"common{k}" for k in range(30))
    rows += [(len(rows) + k, passage + " " + " ".join(f"own{k}x{j}" for j in range(draw.choice([2, 5, 8, 12, 40])))) for k in range(60)]
    rows += [(2, rows[2][1].upper()), (None, rows[3][1]), (None, None), (900, None), (901, " \n\t"), (902, ""), (903, "one"), (904, "ONE"), (905, "lorem ipsum " * 40_000), (905, "lorem ipsum " * 40_000)]
    df = documents(spark, [(*r, "en", "s") for r in rows]).withColumn("node", F.lit(1)).withColumn("n", F.lit("x"))
    assert Counter(map(tuple, parity_join.classes(df).collect())) == plain_classes(rows)
    assert Counter(map(tuple, parity_join.classes(df, max_broadcast=0).collect())) == plain_classes(rows)
    assert parity_join.classes(df.limit(0)).count() == 0
    odd = awkward(spark)
    assert parity_join.classes(odd).count() == odd.count()


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 100), st.integers(0, 100), st.integers(0, 10**6), st.sampled_from([50, 80, 90]))
def test_linked_sets_share_a_bucket(n, gone, more, seed, percent):
    draw = np.random.default_rng(seed)
    measure = parity_join.Measure(percent)
    whole = draw.integers(0, 2**64, n + more, dtype=np.uint64)
    a, b = np.unique(whole[:n]), np.unique(whole[min(gone, n - 1) :])
    near = parity_join.may_link(parity_join.sketch(a), parity_join.sketch(b), len(a), len(b), measure)
    if measure.linked(a, b):
        assert near and len(np.intersect1d(parity_join.buckets(a, measure), parity_join.buckets(b, measure)))
    assert measure.linked(a, b) == (100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)))


def test_blocks_of_a_group(spark):
    """Many nodes of several classes in one bucket meet in groups of bounded size."""
    draw = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(base[: draw.randrange(30, 60)] + [f"u{k}y{j}" for j in range(draw.randrange(0, 14))])) for k in range(250)]
    df = documents(spark, [(*r, "en", "s") for r in rows])
    for block in (512, 16):
        assert Counter(map(tuple, parity_join.classes(df, block=block).collect())) == plain_classes(rows)
