"""Near-duplicate classes against brute force; the pipeline on awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import near_dups as N
from foliograph.llm import shared
from llm.fixtures import awkward, documents, save


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
    hot = [word() for _ in range(150)]
    for _ in range(40):
        near = list(hot)
        near[rng.randrange(150)] = word()
        out.append(" ".join(near))
    passage = [word() for _ in range(60)]
    out += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(40)]
    return out


def brute(found):
    """Classes by weighted similarity of every pair, with the operator's own weights."""
    sets = [N.shingles(N.words_of(t), 5) for t in found]
    total = len(found)
    df = {}
    for s, _ in sets:
        for x in s.tolist():
            df[x] = df.get(x, 0) + 1
    idf = lambda x: np.log1p(total / df[x]) / np.log1p(total)
    weighed = [(s, t * (0.5 + 0.5 * np.array([idf(x) for x in s.tolist()]))) for s, t in sets]
    parent = list(range(total))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(total):
        for b in range(a):
            if N.similarity(weighed[a], weighed[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(total)]


def test_classes_equal_brute_force(spark):
    found = texts()
    df = documents(spark, [(k, t, "en", "s") for k, t in enumerate(found)])
    got = {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()}
    assert [got[k] for k in range(len(found))] == brute(found)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = x[:2000], x[500:2500]
    wa, wb = (1 + (v % np.uint64(5)).astype(float) for v in (a, b))
    agree = (N.samples(a, wa, 500) == N.samples(b, wb, 500)).mean()
    assert abs(agree - N.similarity((a, wa), (b, wb))) < 0.08


def test_awkward_rows(spark):
    df = awkward(spark)
    out = N.classes(df).collect()
    assert len(out) == df.count()
    by = {}
    for r in out:
        by.setdefault(r["node"], set()).add(r["class_id"])
    assert all(len(x) == 1 for x in by.values())
    one = N.deduplicated(df)
    assert one.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    assert N.classes(df.limit(0)).count() == 0 and N.deduplicated(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    body = " ".join(f"bench{k}" for k in range(20))
    good = ["The river runs past the old mill and turns to the sea number %d, as people say it did." % k * 4 for k in range(20)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)]
    rows += [(100, "prefix " + body, "en", "s", 1), (101, "token = 'abcdefgh12' " + "unlike anything else here at all " * 3, "en", "s", 1), (102, "token = 'abcdefgh12' " + "unlike anything else here at all " * 3, "en", "s", 1), (None, None, None, None, None)]
    docs = documents(spark, rows, ", n_chars long")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, body)], "item_id long, text string")
    sf = save(spark, tmp_path, documents=docs, labels=labels, benchmark=bench)
    assert len(corpus_pipeline.STAGES) == 5
    before = shared.made()
    out = [r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()]
    assert shared.made() <= before + 2  # what the last stage reads, and its own table
    assert 100 not in out and 102 not in out and 101 in out
    masked = corpus_pipeline.mask_secrets(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert masked.columns == docs.columns
    assert masked.filter(F.col("text").contains("abcdefgh12")).count() == 0


def test_columns_may_clash(spark):
    df = awkward(spark).withColumn("node", F.lit(1)).withColumn("label", F.lit(2)).withColumn("id", F.lit(3))
    assert N.deduplicated(df).columns == df.columns


def near_copies(seed, n=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    base = [word() for _ in range(200)]
    return [" ".join([*base[:-1], word()]) for _ in range(n)]


def test_groups_of_a_bucket_are_bounded(spark, monkeypatch):
    found = near_copies(1, 30) + near_copies(2, 40)
    nodes = [bytes([k]) * 16 for k in range(len(found))]
    empty = N.Weights(np.ones(2))
    drawn = [(x, N.samples(*N.shingles(N.words_of(t), 5), 60).astype(np.uint16).tobytes(), list(range(k * 15, k * 15 + 15))) for k, (x, t) in enumerate(zip(nodes, found))]
    members = spark.createDataFrame([(0, 7, x) for x in nodes], "band int, bucket long, node binary")
    # the first 20 are one class, all others are classes of their own
    labels = spark.createDataFrame([(x, nodes[0] if k < 20 else x) for k, x in enumerate(nodes)], "node binary, label binary")
    bodies = spark.createDataFrame(list(zip(nodes, found)), "node binary, body string")
    seen = {}
    kept = N.written
    monkeypatch.setattr(N, "written", lambda df, name: seen.setdefault(name, kept(df, name)))
    links = N._across(members, labels, spark.createDataFrame(drawn, "node binary, drawn binary, bands array<long>"), bodies, empty, 5, 0.8, 60, block=4).collect()
    parent = {x: (nodes[0] if k < 20 else x) for k, x in enumerate(nodes)}
    for a, b in links:
        a, b = parent[a], parent[b]
        parent = {x: b if p == a else p for x, p in parent.items()}
    assert len({parent[x] for x in nodes[:30]}) == 1 and len({parent[x] for x in nodes[30:]}) == 1 and len(set(parent.values())) == 2
    sizes = seen["dealt"].groupBy("band", "bucket", "x", "y").count().agg(F.max("count")).first()[0]
    assert sizes < 35


def test_texts_of_one_id_meet_only_their_own_node(spark):
    rows = [(i, f"text {i} {k}") for i in (None, 5) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = df.select(F.col("text").cast("binary").alias("node"), F.col("doc_id").alias("id"), N._sum("text").alias("sum"))
    out = N._bodies(df, wanted, "doc_id", "text")
    assert {(bytes(r["node"]).decode(), r["body"]) for r in out.collect()} == {(t, t) for _, t in rows}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(_of#" in plan.split("Join Inner, ")[1].split("\n")[0]


def test_classes_that_share_an_id_or_have_none_stay_apart(spark):
    a, b = near_copies(3), near_copies(4)
    df = documents(spark, [(5, a[0], "en", "s"), (6, a[1], "en", "s"), (5, "another text that has nothing to do with it", "en", "s"), (None, b[0], "en", "s"), (None, b[1], "en", "s")])
    out = [(r["doc_id"], r["text"]) for r in N.deduplicated(df).collect()]
    assert len(out) == 3 and (5, a[0]) in out and (5, "another text that has nothing to do with it") in out and sum(x is None for x, _ in out) == 1


def test_document_frequencies(spark):
    """Counts of every shingle over all texts, in tables of many small batches of long texts as well."""
    found = [" ".join(f"w{(k * j) % 97}" for j in range(400)) for k in range(50)] + ["one two three four five six"] * 7 + [None, ""]
    df = spark.createDataFrame([(t,) for t in found], "text string").repartition(20)
    total, counts = N.document_frequencies(df, 5, 1 << 20)
    wanted = np.zeros(1 << 20, np.int64)
    for t in found:
        wanted[np.unique(N.slots_of(N.shingles(N.words_of(t), 5)[0], 1 << 20))] += 1
    assert total == len(found) and (counts == wanted).all() and counts.max() >= 7
    idf = N.inverse_frequencies(total, counts)
    assert idf.max() == 1 and idf[counts == 7].max() < idf[counts == 1].min()
    assert N.document_frequencies(df.limit(0), 5, 1 << 20)[1].sum() == 0


def test_a_thousand_null_ids(spark):
    texts = near_copies(7, 200) + [f"text number {k} that is like no other, {k * 7} or {k * 11} times" for k in range(800)]
    out = N.classes(documents(spark, [(None, t, "en", "s") for t in texts]))
    assert out.count() == 1_000 and out.select("label").distinct().count() == 801
    assert N.deduplicated(documents(spark, [(None, t, "en", "s") for t in texts])).count() == 801


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = awkward(spark).withColumn("n_chars", F.lit(1).cast("long")).withColumn("hits", F.lit("x")).withColumn("_score", F.lit("y")).withColumn("spans", F.lit("z")).withColumn("base", F.lit(3))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some item")], "item_id long, text string")
    for some in (docs, docs.limit(0)):
        sf = save(spark, tmp_path, documents=some, labels=labels, benchmark=bench)
        rows = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns and out.count() <= rows.count(), name
            assert out.filter("hits <> 'x' or _score <> 'y' or spans <> 'z' or base <> 3").count() == 0
        assert corpus_pipeline.pack(spark, rows, sf).count() >= 0
    sf = save(spark, tmp_path, benchmark=bench.limit(0), labels=labels.limit(0))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    held = []

    def kept(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        held.append((name, plan.count("ArrowEvalPython") + plan.count("FlatMapGroupsIn") + plan.count("MapInArrow")))
        return shared.written(df, name)

    monkeypatch.setattr(N, "written", kept)
    N.classes(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts()[:30])])).count()
    assert {"signed", "likely", "links", "across"} <= {name for name, _ in held} and max(n for _, n in held) == 1
