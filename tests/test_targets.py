"""Targets of tokens, markers of references and combinations by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators import spans as P


def test_targets(spark):
    labels = ["O", "author:name", "author:name", "author", "note:author:mail", "note", "title", "author:name", "note:date"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(labels)], "doc_id long, tok_idx long, label string")
    got = [r["target"] for r in P.target_labels(rows).orderBy("tok_idx").collect()]
    assert got == ["O", "author-begin|name", "author-inside|name", "author", "note|author-inside|mail", "note", "title", "author-begin|name", "note|date"]
    assert [r["target"] for r in P.target_labels(rows, False, False).orderBy("tok_idx").collect()] == [x.split(":")[-1] for x in labels]
    assert P.target_labels(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text, n", [("[1] A", 4), (" <b>[Ab 9]</b>", 10), ("[] A", 0), ("12. A", 4), ("12.A", 0), ("1234. A", 0), ("A [1]", 0), ("[1", 0), ("", 0)])
def test_lead_marker(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(P.lead_marker(F.col("t")).alias("n")).first()["n"] == n


def test_combinations(spark):
    rows = spark.createDataFrame([(1, x) for x in "dabc"] + [(2, "a"), (1, "a")], "g long, v string")
    assert sorted("".join(r["values"]) for r in P.combinations(rows, "g", "v", 3).collect()) == ["abc", "abd", "acd", "bcd"]
    assert P.combinations(rows, "g", "v", 1).count() == 5 and P.combinations(rows, "g", "v").count() == 6
    with pytest.raises(ValueError):
        P.combinations(rows, "g", "v", 0)
