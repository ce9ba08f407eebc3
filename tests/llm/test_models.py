"""Quality and toxicity: held-out accuracy, awkward rows, no labels."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.llm import catalog, quality_gam, toxicity
from llm.fixtures import awkward

SF = os.environ.get("TEST_MODEL_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name, label, target, recall, precision", [("op1_quality_gam", "quality", 0, 0.75, 0.9), ("op1_quality_gam", "quality", 1, 0.9, 0.9), ("op9_toxicity", "toxic", 1, 0.6, 0.9)])
def test_held_out(spark, name, label, target, recall, precision):
    """Of the held-out documents of a label, how many are told, and how many told so are; labels hold some noise."""
    scored = catalog.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r[0], r[1]): r[2] for r in scored.groupBy("predicted", label).count().collect()}
    hit, told, are = n.get((target, target), 0), n.get((target, 0), 0) + n.get((target, 1), 0), n.get((0, target), 0) + n.get((1, target), 0)
    assert hit >= recall * are and hit >= precision * told and hit


def test_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for module, label in ((quality_gam, "quality"), (toxicity, "toxic")):
        for some in (labels, labels.limit(0)):
            model = module.fit(df, some, F.lit(True), label=label)
            out = module.with_score(df, model)
            assert out.count() == df.count() and out.columns == df.columns
            assert out.filter((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0
        assert module.with_score(df.limit(0), model).count() == 0


def test_folding():
    assert toxicity.folded("1d10T  ѕtupіd\n$cum") == "idiot stupid scum"
    assert toxicity.folded(None) == ""


def test_exceptions_and_boundaries():
    lexicon = toxicity.Lexicon({"trash": 3.0, "idi*": 2.0})
    found = lambda t: [e for *_, e in lexicon.matches(toxicity.folded(t))]
    assert found("put it in the trash can") == []
    assert found("what trash, idiots!") == ["trash", "idi*"]
    assert found("untrash trashy") == []


def test_tables_sum():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_tables(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9  # only a pair of features tells


def test_score_is_a_sum_of_table_entries():
    """Every score against prior, bins and tables looked up one by one."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality_gam.FEATURES))).round(1)
    y = (x[:, 0] + x[:, 2] * x[:, 3] + rng.normal(size=300) > 0).astype(float)
    model = quality_gam.fit_tables(x, y, rounds=20, pair_rounds=10)
    assert model.pairs
    for row, got in zip(x, model.score(x)):
        place = lambda edges, v: sum(v >= e for e in edges)
        total = model.prior + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, row))
        total += sum(t[place(model.coarse[a], row[a])][place(model.coarse[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert got == pytest.approx(1 / (1 + math.exp(-total)))


ENTRIES = {"idiot": 2.0, "idi*": 1.0, "scum": 3.0, "trash": 1.5, "tra*": 0.5, "a": 0.1}
PHRASES = ["trash can", "pond scum", "a trash can man", "can trash"]


def plain_matches(text):
    """At each place where a word begins the longest entry, whole words first, unless a phrase covers it."""
    out = []
    covered = [(k, k + len(p)) for p in PHRASES for k in range(len(text)) if text.startswith(p, k) and not text[k - 1 : k].isalpha() and not text[k + len(p) : k + len(p) + 1].isalpha()]
    for k in range(len(text)):
        if k and text[k - 1].isalpha():
            continue
        fits = []
        for entry in ENTRIES:
            stem = entry.rstrip("*")
            end = k + len(stem)
            if text.startswith(stem, k) and (entry.endswith("*") or not text[end : end + 1].isalpha()) and not any(a <= k and end <= b for a, b in covered):
                fits.append((end, not entry.endswith("*"), entry))
        if fits:
            out.append((k, max(fits)[0], max(fits)[2]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["trash", "can", "idiot", "idiots", "pond", "scum", "a", "man", "1d10t", "tr4shy", "x", "ѕcum"]), max_size=12).map(" ".join))
def test_matches_equal_plain_search(text):
    plain = toxicity.folded(text)
    assert toxicity.Lexicon(ENTRIES, PHRASES).matches(plain) == plain_matches(plain)
