"""Hyphens at line ends against one pass over the tokens."""

import random

from foliograph.operators import tokens as T


def plain(rows):
    out = []
    for k, (_, _, line, token) in enumerate(rows):
        if token == "-" and (k + 1 == len(rows) or rows[k + 1][2] != line):
            if len(out) > 1:
                out[-1][2] = True
        else:
            out.append([line, token, False])
    return [(k, *x) for k, x in enumerate(out)]


def test_withheld_hyphens(spark):
    rng = random.Random(2)
    docs = {d: [(d, k, k // rng.choice([1, 2, 3]), rng.choice(["a", "-", "b", None])) for k in range(rng.choice([1, 2, 5, 30]))] for d in range(40)}
    docs = {d: [(a, k, max(x[2] for x in rows[: k + 1]), t) for a, k, _, t in rows] for d, rows in docs.items()}
    df = spark.createDataFrame([r for rows in docs.values() for r in rows], "doc_id long, tok_idx long, line_idx long, token string")
    got = {}
    for r in T.withheld_hyphens(df).orderBy("doc_id", "tok_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["tok_idx"], r["line_idx"], r["token"], r["split_lhs"]))
    assert got == {d: plain(rows) for d, rows in docs.items() if plain(rows)}
