"""Headings, beginnings of references and citations by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators import line_features as L
from foliograph.operators import linking as C
from foliograph.operators import segmentation as S


def told(spark, test, texts):
    """The texts of which a test is true."""
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"] for r in rows.filter(test(F.col("text"))).collect()}


@pytest.mark.parametrize(
    "test, yes, no",
    [
        (S.is_introduction, ["Introduction", "1. Introduction", "II. INTRODUCTION to it", "# 1.2 \tIntroductions", "IIntroduction"], ["introduction", "An Introduction", "1a Introduction", "Intro", ""]),
        (S.is_abstract, ["Abstract", "ABSTRACT: we", " \tAbstract", "abstract", "abstract  "], ["abstract we", "An abstract", "1 Abstract", ""]),
        (S.is_bibliography, ["References", "5 REFERENCES", "IV. Bibliography ", "References and Notes", "Literature Cited", "Acknowledgements"], ["references", "References to it", "1.2.3. References", "My References", ""]),
        (S.is_opening, ["introduction", "1 Introduction", "1... BACKGROUND on", "II. Introduction", "iii introduction", "1.0 Background", "  Introduction"], ["12 Introduction", "1.1 Introduction", "1Introduction", "The Introduction", ""]),
        (S.is_numbered_heading, ["1 Models", "2. Models", "3.0 Models", "II. Models"], ["1 models", "ii. Models", "Models", "1 MODELS", "1.1 Models", "12 Models", ""]),
        (S.ends_in_bibliography, ["References", "5 REFERENCES:", "Bibliography.", "The Bibliography:. "], ["references", "References to", "References..", ""]),
    ],
)
def test_headings(spark, test, yes, no):
    assert told(spark, test, [*yes, *no, None]) == set(yes)


@pytest.mark.parametrize("text, yes", [("References", True), ("BIBLIOGRAPHY", True), ("5.References", True), ("ReferencesandNotes", True), ("LiteratureCited", True), ("references", False), ("123456References", False), ("Referencesto", False), ("Acknowledgements", False)])
def test_titles(spark, text, yes):
    assert (told(spark, L.is_title, [text]) == {text}) is yes


@pytest.mark.parametrize(
    "text, yes",
    [("May 5", True), ("in Jan. 1999", True), ("in Sept 1999", True), ("Jul.", True), ("Jul 5", False), ("Jan.1999", False), ("Junior", False), ("Mar\t", True), ("December", True)],
)
def test_months(spark, text, yes):
    assert (told(spark, L.names_month, [text]) == {text}) is yes


@pytest.mark.parametrize(
    "text, kind",
    [
        ("[1] Smith", 1),
        (" [Ab99] on it", 1),
        ("[] Smith", None),
        ("Smith A., 1999 On", 2),
        ("Smith A. B., Jones C., 1999", 2),
        ("Smith A B, 1999", 2),
        ("Smith AB., Jones C, 1999", 2),
        ("Smith A.,Jones C., 1999", None),
        ("Smith, 1999", None),
        ("A. Smith, and Bob Jones. 1984. On", 3),
        ("Bob Jones. 1984.", 3),
        ("Bob Jones. 1984 On", None),
        ("A. B. C. D. E. F. Gee. 1984.", None),
        ("bob Jones. 1984.", None),
        ("Smith, A. B., Jones, C. & Low, D. (1991).", 4),
        ("Smith A.-B. and Jones C. 1991", 4),
        ("Smith-Low A. 1991", 4),
        ("Smith and Jones 1991", None),
        ("Smith A.1991", None),
        ("12) The", 5),
        ("12)The", None),
        ("12) the", None),
        ("7. On it", 6),
        ("1234. On it", None),
        ("7.", None),
        ("", None),
    ],
)
def test_reference_starts(spark, text, kind):
    kinds = S.reference_start_kinds(F.col("text"))
    row = spark.createDataFrame([(text,)], "text string").select(*[k.alias(str(i + 1)) for i, k in enumerate(kinds)]).first()
    assert next((i + 1 for i, yes in enumerate(row) if yes), None) == kind


@pytest.mark.parametrize(
    "text, style, n",
    [
        ("as [1] and [2, 3; 4] say [x] [5 [6]", "NUMERICAL_BRACKETS", 5),
        ("as (1), (2,3) and (1999a)", "NUMERICAL_PARENS", 3),
        ("[Ab1] [Ab1, Cd22] [A1] [Ab] [12]", "ALPHA_NUMERIC_BRACKETS", 3),
        ("(Ab1; Cd2) (ab)", "ALPHA_NUMERIC_PARENS", 2),
        ("Low 1999, Low and Bee (1999), Low et al. 1999a, (Low et al 1999) (e.g. Low & Bee 1999) but Bee 1999, Low, 1999 and Low1999", "AUTHOR_LAST", 5),
    ],
)
def test_citation_counts(spark, text, style, n):
    found = {name: C.grouped_citations(F.col("t"), brackets, one) for name, brackets, one in C.STYLES}
    found["AUTHOR_LAST"] = C.years_by(F.col("t"), F.array(F.lit("Low"), F.lit("van Dyk")))
    assert spark.createDataFrame([(text,)], "t string").select(found[style].alias("n")).first()["n"] == n
