"""Scalar functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import scalar as S


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, plain",
    [("office", "oce"), ("ffl", "f"), ("field fluff", "eld u"), ("aeoe", ""), ("", ""), (None, None)],
)
def test_ligatures(spark, text, plain):
    assert value(spark, S.without_ligatures(F.lit(text).cast("string"))) == plain


@pytest.mark.parametrize("text, year", [("'97", "1997"), ("-03", "2003"), ("(1999)", "1999"), ("'07a", "2007a"), ("", "")])
def test_years(spark, text, year):
    assert value(spark, S.normalised_year(F.lit(text))) == year


@pytest.mark.parametrize(
    "text, parsed",
    [("12 May 1998", "year=1998%%month=May"), ("'98 Jan Feb", "year=1998%%month=Jan%%month=Feb"), ("1500, 1850", "year=1850"), ("no date", ""), ("marching", "month=Mar"), (None, None)],
)
def test_dates(spark, text, parsed):
    assert value(spark, S.parsed_date(F.lit(text).cast("string"), 2026)) == parsed


@pytest.mark.parametrize("host, letter", [("www.cs.mill.edu", "m"), ("www.ford.ac.uk", "f"), ("www.quarry.com", "q"), ("nohost", "?"), ("zz.uk", "z")])
def test_significant_letter(spark, host, letter):
    assert value(spark, S.significant_letter(F.lit(host))) == letter


@pytest.mark.parametrize("a, b, d", [("kitten", "sitting", 5), ("abc", "abc", 0), ("", "abc", 3), ("abc", "", 3), ("ab", "ba", 2)])
def test_indel_distance(spark, a, b, d):
    assert value(spark, S.indel_distance(F.lit(a), F.lit(b))) == d


def test_edges(spark):
    assert value(spark, S.trimmed_to_alphanumeric(F.lit("fl (abc-1) fl"))) == "abc-1"
    assert value(spark, S.without_edge_punctuation(F.lit("(ab)."))) == "(ab)"
    assert value(spark, S.without_edge_punctuation(F.lit(".ab)"))) == "ab)"
    assert value(spark, S.corpus_name(F.lit("/a/b/paper.v2.pdf.meta.xml"))) == "paper.v2"
    assert value(spark, S.full_name(F.lit("Ada"), F.lit(""), F.lit("Lovelace"), "reference")) == "Lovelace A. "
