"""Hints of references: gaps, indents, names in order, and what is made of them all."""

import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.operators import reference_hints as H

LINES = "doc_id long, line_idx long, page long, llx long, lly long, text string"


def frame(spark, docs):
    """Lines of documents given as (llx, lly, text) rows; a row of None starts a page."""
    rows = []
    for doc, lines in docs.items():
        page = i = 0
        for line in lines:
            if line is None:
                page += 1
                continue
            rows.append((doc, i, page, *line))
            i += 1
    return spark.createDataFrame(rows, LINES)


def column(ys, x=72):
    return [(x, y, "text") for y in ys]


def hints(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["line_idx"], r["ends"]))
    return {k: sorted(v) for k, v in out.items()}


def test_gaps(spark):
    docs = {
        1: column([700, 688, 676, 664]),  # one gap: only the end
        2: column([700, 688, 670, 658, 640, 628]),  # two gaps
        3: column([700, 688, 670, 658, 640, 628, 540, 528]),  # and a far larger one
        4: column([700, 688, 676, 600, 588]),  # one gap, then the end
        5: [*column([700, 688, 670, 658, 640]), *column([700, 688, 670], 300)],  # a second column with gaps alike
        6: [*column([700, 688, 670, 658, 640]), *column([700, 500], 300)],  # a second column that has nothing of them
        7: column([700]),
    }
    found = hints(H.gap_hints(frame(spark, docs)))
    at = lambda *x: [(k, False) for k in x[:-1]] + [(x[-1], True)]
    assert found == {1: at(4), 2: at(0, 2, 4, 6), 3: at(0, 2, 4, 6), 4: at(3), 5: at(0, 2, 4, 5, 7, 8), 6: at(0, 2, 4, 5), 7: at(1)}
    assert H.gap_hints(frame(spark, {1: column([1])}).limit(0)).count() == 0


def run(*rows, budget=3200):
    """Hints of rows (x, y) or (x, y, page)."""
    x, y, page = ([r[k] if len(r) > k else 0 for r in rows] for k in range(3))
    return H.indented(x, y, page, [10] * len(rows), budget)


DOWN = list(range(700, 400, -12))


@pytest.mark.parametrize(
    "xs, found",
    [
        ([72, 90, 72, 90, 90, 72], [0, 2, 5]),
        ([90, 72, 72, 90, 72], [0, 3]),  # beginnings to the right
        ([72, 72, 72, 72], []),
        ([72, 74, 72], []),  # too little
        ([72, 200, 72], []),  # too much
        ([72], []),
        ([], []),
    ],
)
def test_indents(xs, found):
    assert run(*zip(xs, DOWN)) == [(k, False) for k in found]


def test_indents_over_columns():
    left, right = [(72, 700), (90, 688), (72, 676), (90, 664)], [(318, 700), (300, 688), (318, 676)]
    assert run(*left, *right) == [(0, False), (2, False), (5, False)]  # the column goes on with the reference before it
    assert run(*left, (300, 700), (318, 688)) == [(0, False), (2, False), (4, False)]
    assert run(*left, (300, 700), (300, 688)) == [(0, False), (2, False), (4, True)]  # nothing stands aside there
    assert run(*left, (72, 700, 1), (90, 688, 1)) == [(0, False), (2, False), (4, False)]
    assert run((72, 700), (90, 688), *[(90, y) for y in DOWN[2:]], (72, 300), budget=100) == [(0, False)]


def test_indent_rows(spark):
    df = frame(spark, {1: [(72, 700, "a"), (90, 688, None), (72, 676, "b")], 2: [(72, 700, "a"), None, (90, 688, "c")]})
    assert hints(H.indent_hints(df)) == {1: [(0, False), (2, False)]}
    assert H.indent_hints(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=3), st.booleans()), max_size=9), st.integers(1, 6))
def test_longest_rise(items, back):
    words, able = [w for w, _ in items], [a for _, a in items]
    start = lambda w: w[:2] if len(w) >= 3 else w
    fits = lambda c: all(j - i <= back and start(words[i]) <= words[j] for i, j in zip(c, c[1:]))
    places = [k for k, a in enumerate(able) if a]
    best = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if fits(c)), default=0)
    chain = H.longest_rise(words, able, back)
    assert len(chain) == best and fits(chain) and all(able[k] for k in chain)


def test_names(spark):
    texts = {
        1: ["Adams, B. The first of all", "and more words of this one", "Baker et al. 1990 on it", "van Dyk, C. The third of all", "Cole and Day on four things", "Ellis, F. More of the same", "Adams too short"],
        2: ["1 Adams, B. The first of all", "Baker, B. The first of all"],
        3: ["Nothing is here that has names"],
        4: ["A. B", None],
    }
    df = frame(spark, {d: [(72, 700 - 12 * k, t) for k, t in enumerate(lines)] for d, lines in texts.items()})
    assert hints(H.alphabet_hints(df)) == {1: [(0, False), (2, False), (4, False), (5, False)]}
    assert H.alphabet_hints(df.limit(0)).count() == 0


def plain_fused(rows):
    """The ladder, for one document's hints (source, line, ends, style)."""
    of = {s: sorted((line, ends) for source, line, ends, _ in rows if source == s) for s in ("gap", "regex", "indent", "alphabet")}
    gap, regex, indent, alphabet = of["gap"], of["regex"], of["indent"], of["alphabet"]
    stops = [line for line, ends in gap if ends]
    if not stops:
        return "no end by gaps"
    if len(gap) == 1 and not (regex or indent or alphabet):
        return "no hints"
    stop, style = max(stops), next((s for source, _, _, s in rows if source == "regex"), None)
    firm = regex if style in (1, 6) else alphabet
    if firm and firm[-1][0] > stop:
        return firm[:-1] + [(firm[-1][0], True)]
    if style in (1, 6):
        chosen = regex
    elif indent and 4 * len(indent) >= 3 * max(len(alphabet), len(regex)):
        chosen = indent
    else:
        chosen = alphabet or regex or gap
    out = []
    for line, ends in chosen:
        if line >= stop:
            break
        out.append((line, ends))
        if ends:
            return out
    return [*out, (stop, True)]


def test_fusion(spark):
    draw, rows = random.Random(8), []
    for doc in range(400):
        stop, style = draw.randrange(3, 30), draw.randrange(1, 7)
        if draw.random() < 0.95:
            rows.append((doc, "gap", stop, True, None))
        for source, share in (("gap", 0.4), ("regex", 0.5), ("indent", 0.5), ("alphabet", 0.5)):
            if draw.random() < share:
                most = stop if source == "gap" else 36
                lines = sorted(draw.sample(range(most), min(most, draw.randrange(1, 9))))
                ends = source == "indent" and draw.random() < 0.3
                rows += [(doc, source, k, ends and k == lines[-1], style if source == "regex" else None) for k in lines]
    df = spark.createDataFrame(rows, "doc_id long, source string, line_idx long, ends boolean, style int")
    found, errors = {}, {}
    for r in H.fused(df).collect():
        if r["error"]:
            errors[r["doc_id"]] = r["error"]
        else:
            found.setdefault(r["doc_id"], []).append((r["line_idx"], r["ends"]))
    for doc in {r[0] for r in rows}:
        want = plain_fused([r[1:] for r in rows if r[0] == doc])
        assert (errors.get(doc) or sorted(found[doc])) == want
    assert H.fused(df.limit(0)).count() == 0


def test_parts(spark):
    lines = spark.range(7).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_idx")).union(spark.sql("SELECT 2L, 0L"))
    marks = spark.createDataFrame([(1, "gap", 1, False, None), (1, "gap", 3, False, None), (1, "gap", 5, True, None), (2, None, None, None, "no hints")], "doc_id long, source string, line_idx long, ends boolean, error string")
    got = Counter(map(tuple, H.parted(lines, marks).collect()))
    assert got == Counter([(1, 0, "prologue", None), (1, 1, "reference", 1), (1, 2, "reference", 1), (1, 3, "reference", 2), (1, 4, "reference", 2), (1, 5, "epilogue", None), (1, 6, "epilogue", None), (2, 0, "prologue", None)])


def test_documents_share_batches(spark):
    """Every document was a call of its own; those that go over a batch's end are still whole."""
    import pandas as pd

    from foliograph.operators.by_document import passed

    sizes = [1, 7, 2, 1, 12, 3] * 20
    rows = [(d, k) for d, n in enumerate(sizes) for k in range(n)] + [(None, 0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        told = lambda frame, documents: pd.DataFrame([(frame["doc_id"].iloc[a], frame["line_idx"].iloc[a:b].tolist(), len(documents)) for a, b in documents], columns=["doc_id", "lines", "beside"])
        got = passed(spark.createDataFrame(rows[::-1], "doc_id long, line_idx long"), told, "doc_id long, lines array<long>, beside int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["doc_id"]: r["lines"] for r in got} == {d: list(range(n)) for d, n in enumerate(sizes)} and len(got) == len(sizes)
    assert max(r["beside"] for r in got) > 1


def test_fusion_reads_hints_once(spark, capsys):
    rows = [("gap", 1, 4, True, None), ("regex", 1, 0, False, 1)]
    H.fused(spark.createDataFrame(rows, "source string, doc_id long, line_idx long, ends boolean, style int")).explain("simple")
    assert "Join" not in capsys.readouterr().out


def test_gap_hints_read_lines_once(spark, capsys):
    rows = [(1, k, 0, 72, 700 - 12 * k, "x") for k in range(4)]
    H.gap_hints(spark.createDataFrame(rows, "doc_id long, line_idx long, page long, llx long, lly long, text string")).explain("simple")
    assert "Join" not in capsys.readouterr().out
