"""All lexicons at once."""

import pytest

from foliograph.operators import token_features as TF

LEXICONS = [("CITY", "New York", True), ("CITY", "york", True), ("FIRST", "York", False), ("STATE", "new york", False), ("LONG", "in new york city", True), ("NONE", None, True)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_lexicon_names(spark, longest):
    words = "york in New York City new york".split()
    tokens = spark.createDataFrame([(d, k, w) for d in (1, 2) for k, w in enumerate(words)] + [(3, 0, None)], "doc_id long, tok_idx long, token string")
    lexicons = spark.createDataFrame(LEXICONS, "name string, entry string, ignore_case boolean")
    entries = [(n, e.split(), fold) for n, e, fold in LEXICONS if e and len(e.split()) <= longest]
    low = lambda x, fold: [w.lower() for w in x] if fold else list(x)
    want = [sorted({n for n, e, fold in entries for a in range(len(words)) if a <= k < a + len(e) and low(words[a : a + len(e)], fold) == low(e, fold)}) for k in range(len(words))]
    got = {(r["doc_id"], r["tok_idx"]): r["lexicons"] for r in TF.lexicon_names(tokens, lexicons, longest).collect()}
    assert got == {**{(d, k): w for d in (1, 2) for k, w in enumerate(want)}, (3, 0): []}


def test_tokens_stay_where_they_are(spark, capsys):
    """Every phrase was a row that went to its word, and every hit one that came back."""
    tokens = spark.createDataFrame([(1, 0, "a")], "doc_id long, tok_idx long, token string")
    lexicons = spark.createDataFrame([("X", "a", True)], "name string, entry string, ignore_case boolean")
    TF.lexicon_names(tokens, lexicons, 3).explain("simple")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "Generate" not in plan
