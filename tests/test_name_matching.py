"""Rungs of name matching and the cutting of e-mail strings by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators import name_matching as N


@pytest.mark.parametrize(
    "first, middle, last, user, kind",
    [
        ("Ann", "", "Low", "ann", "EXACT"),
        ("Ann", "", "Low", "low", "EXACT"),
        ("Ann", "", "Low", "alow", "EXACT"),
        ("Ann", "", "Low", "ann.low", "EXACT"),
        ("Ann", "", "Low", "a_l", "MIDDLE_GUESS"),  # an underscore is a letter to patterns
        ("Ann", "", "Low", "a-l", "EXACT"),
        ("Ann", "", "Low", "lowann", "EXACT"),
        ("Ann", "", "Low", "low.ann", "NAME_SUBSTRING_MATCH"),
        ("Ann", "Bea", "Low", "abl", "EXACT"),
        ("Ann", "Bea", "Low", "ann.b.low", "EXACT"),
        ("Ann", "Bea", "Low", "bea", "EXACT"),
        ("Ann", "Bea", "Low", "lowab", "EXACT"),
        ("Ann", None, "Low", "ann.x.low", "MIDDLE_GUESS"),
        ("Ann", "", "Low", "axlow", "MIDDLE_GUESS"),
        ("Ann", "", "Low", "lowax", "MIDDLE_GUESS"),
        ("Ann", "Bea", "Low", "axlow", "NAME_SUBSTRING_MATCH"),
        ("Ann", "", "Low", "lowland77", "NAME_SUBSTRING_MATCH"),
        ("Robert", "", "Smithe", "smthe", "LEVEN1"),
        ("Robert", "", "Smithe", "rsmiteh", "LEVEN2"),
        ("Robert", "", "Smithe", "qqqq", None),
        ("A", "", "B", "qqqq", "NAME_SUBSTRING_MATCH"),
    ],
)
def test_kinds(spark, first, middle, last, user, kind):
    row = spark.createDataFrame([(first, middle, last, user)], "f string, m string, l string, u string")
    assert row.select(N.match_kind(*map(F.col, "fmlu")).alias("k")).first()["k"] == kind


AUTHORS = [(1, 0, "Ann", "", "Low"), (1, 1, "Bob", "", "Gee"), (2, 0, "Flo", "", "Hug")]


@pytest.mark.parametrize(
    "doc, raw, found",
    [
        (1, "{ann, bob}@x.edu", ["ann@x.edu", "bob@x.edu"]),
        (1, "fann,bobg@x.edu", ["ann@x.edu", "bob@x.edu"]),
        (1, "1ann bob2@x.edu", ["ann@x.edu", "bob@x.edu"]),
        (2, "flo,hug@x.edu", ["flo@x.edu", "hug@x.edu"]),  # more match as they stand
        (9, "fann,bobg@x.edu", ["fann@x.edu", "bobg@x.edu"]),  # no authors to tell
        (1, "E-mail: ann|bob@cs.x.ac.uk", ["ann@cs.x.ac.uk", "bob@cs.x.ac.uk"]),
        (1, "ann@x.edu, bob@y.com.", ["ann@x.edu", "bob@y.com"]),
        (1, "ann@x.museum", ["ann@x.museum"]),
        (1, "ann@x.nowhere", []),
        (1, "no address", []),
        (1, "", []),
        (1, None, []),
    ],
)
def test_segments(spark, doc, raw, found):
    authors = spark.createDataFrame(AUTHORS, "doc_id long, author_no long, first string, middle string, last string")
    rows = spark.createDataFrame([(doc, 1, raw)], "doc_id long, email_ref long, raw string")
    got = N.segmented(rows, authors).orderBy("email_no").collect()
    assert [r["name"] + r["domain"] for r in got] == found and [r["email_no"] for r in got] == list(range(len(found)))


def test_pairs(spark):
    authors = spark.createDataFrame(AUTHORS, "doc_id long, author_no long, first string, middle string, last string")
    raw = spark.createDataFrame([(1, 1, "ann@x.edu"), (1, 2, "qqqqqq@x.edu"), (2, 3, "hug@x.edu")], "doc_id long, email_ref long, raw string")
    emails = N.segmented(raw, authors)
    got = sorted((r["doc_id"], r["author_no"], r["email_no"], r["kind"], r["same_position"]) for r in N.matches(authors, emails).collect())
    assert got == [(1, 0, 0, "EXACT", True), (2, 0, 0, "EXACT", True)]
    assert N.matches(authors, emails.limit(0)).count() == 0
