"""Alignment in a band against the full table, and labels carried over edits."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.operators import alignment as A


def full_cost(old, new):
    """Changes from the old text to a beginning of the new one whose end is free; the first character stands for one."""
    row = [int(c != old[0]) + k for k, c in enumerate(new)]
    for ch in old[1:]:
        now = []
        for k, c in enumerate(new):
            same = (row[k - 1] if k else 10**9) + (c != ch)
            none = row[k] + 1
            over = (now[k - 1] if k else 10**9) + 1
            now.append(min(same, none, over))
        row = now
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=14))
def test_cost_equals_the_full_table(old, new):
    band, blocks = A.Band(old, new, 40), A.Band(old, new, 40, most_cells=0)
    assert band.cost == blocks.cost == full_cost(old, new)
    places = band.places()
    assert places.tolist() == blocks.places().tolist()
    assert len(places) == len(old) and all(0 <= p < len(new) for p in places)


def test_exact_copies_and_shifts():
    text = "one two three four five six seven eight nine ten " * 4
    assert A.aligned(text, text, [("a", 4, 7), ("b", 0, len(text))]) == (100, [("a", 4, 7), ("b", 0, len(text))])
    width, spans = A.aligned(text, "## " + text, [("a", 4, 13)])
    assert spans == [("a", 7, 16)] and width == 100
    assert A.aligned("", "x", []) == (0, [])
    assert A.aligned("abc", "", [("a", 0, 1)]) is None
    assert A.aligned("a" * 4000, "a", [("a", 0, 10)]) is None
    assert A.aligned("abcdefghij" * 3, "0123456789" * 3, [("a", 0, 20)]) is None


def test_a_wider_band_where_text_is_missing():
    draw = random.Random(6)
    words = [f"{draw.randrange(10**6)}" for _ in range(400)]
    old = " ".join(words)
    gap = " ".join(words[:100] + words[140:])  # more characters are gone than the first bands hold
    start = old.index(words[300])
    width, spans = A.aligned(old, gap, [("x", start, start + 40)])
    assert gap[spans[0][1] : spans[0][2]] == old[start : start + 40] and width in (100, 200, 400)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_labels_over_edits(seed):
    draw = random.Random(seed)
    words = [f"w{draw.randrange(10**5)}" for _ in range(150)]
    old, at, spans, new = "", 0, [], []
    for k, w in enumerate(words):
        if k % 15 == 7:
            spans.append((w, len(old), len(old) + len(w)))
        old += w + " "
        if k % 15 != 7 and draw.random() < 0.05:
            continue
        new.append(w if k % 15 == 7 or draw.random() > 0.1 else w[1:] + "q")
    found = A.aligned(old, " ".join(new), spans)
    assert found is not None
    text = " ".join(new)
    # edges may lie a character or two off where what stands beside them was changed
    right = sum(label[2:-2] in text[max(0, a - 4) : b + 4] and abs(b - a - len(label)) <= 8 for label, a, b in found[1])
    assert right >= 0.7 * len(spans)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", "now the quick brown fox"), (2, None, "x"), (3, "abcdefghijk", "0123456789x"), (4, "no spans", "no spans")], "doc_id long, old string, new string")
    spans = spark.createDataFrame([(1, "q", 4, 9), (1, "out", 4, 90), (1, "none", 4, 4), (2, "x", 0, 1), (3, "y", 0, 10)], "doc_id long, label string, start long, stop long")
    got = sorted(map(tuple, A.aligned_spans(docs, spans).collect()))
    assert got == [(1, 100, "q", 8, 13), (2, 0, None, None, None), (3, None, None, None, None)]
    assert A.aligned_spans(docs.limit(0), spans).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=30), st.text("abc", min_size=1, max_size=30)), min_size=1, max_size=9), st.integers(1, 12))
def test_beside_each_other_as_alone(pairs, width):
    for got, (old, new) in zip(A.places_of(pairs, width), pairs):
        assert got.tolist() == A.Band(old, new, width).places().tolist()


def test_few_changes_need_no_second_table(monkeypatch):
    monkeypatch.setattr(A, "cost", None)  # each span had a table of its own to count its changes
    old = "the connection to the station was cut off by the nation " * 8
    new = "Turn: " + old.replace("ti", "fi").replace("nn", "n").replace("ff", "n")
    half = len(old) // 2
    width, spans = A.aligned(old, new, [("a", 0, half), ("b", half, len(old))])
    assert width == 100 and spans[0][2] == spans[1][1] and spans[1][2] == len(new)
