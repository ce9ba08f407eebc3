"""Queries over lines and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import token_features as TF
from foliograph.operators import tokens as T
from foliograph.plans import views as V
from foliograph.plans.catalog import query

V.SQL["font_size"] = """
SELECT doc_id, arg_max(size, n * 1000 - size) AS normal, max(size) AS largest FROM (SELECT doc_id, ury - lly AS size, count(*) AS n FROM line GROUP BY ALL) GROUP BY doc_id"""
V.SQL["hf"] = r"""
SELECT *, count(*) OVER (PARTITION BY doc_id, regexp_replace(text, '[0-9\x09-\x0D\x20]+', '', 'g'), llx, lly, font) >= 3 AS is_header_footer FROM line"""


@query("font_sizes", V.with_sql("line", "font_size", then="SELECT * FROM font_size"))
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common and largest font size."""
    return T.font_sizes(V.line(spark, sf_dir))


@query("font_flags", V.with_sql("line", "font_size", then="SELECT doc_id, line_idx, size >= largest - 1 AND size > normal + 1 AS is_largest, size > normal + 1 AS is_large, size < normal - 1 AS is_small, coalesce(lag(size) OVER w <> size, false) AS new_size, coalesce(lag(font) OVER w <> font, false) AS new_font FROM (SELECT *, ury - lly AS size FROM line JOIN font_size USING (doc_id)) WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)"))
def font_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative font flags."""
    return T.with_font_flags(V.line(spark, sf_dir)).select("doc_id", "line_idx", "is_largest", "is_large", "is_small", "new_size", "new_font")


@query("header_footer_lines", V.with_sql("line", "hf", then="SELECT doc_id, line_idx, is_header_footer FROM hf"))
def header_footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeating header and footer lines."""
    return T.with_header_footer(V.line(spark, sf_dir)).select("doc_id", "line_idx", "is_header_footer")


@query("header_footer_boxes", V.with_sql("line", "hf", then="SELECT doc_id, page, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury FROM hf WHERE is_header_footer GROUP BY ALL"))
def header_footer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around repeated lines."""
    return T.header_footer_boxes(V.line(spark, sf_dir))


_LEXER = r"(``|''|“|”|\n|&amp;|[0-9]+(st|nd|rd|th)\b|[Pp]h\.?[Dd]\.?|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|[A-Z]\.|\+[A-Z]+\+|\p{L}+|[0-9]+|[[:punct:]]|\p{S})[\x09-\x0D\x20]*".replace("'", "''")


@query(
    "lexed_tokens",
    V.with_sql("line", then=rf"SELECT doc_id, line_idx, CAST(k - 1 AS BIGINT) AS pos, regexp_replace(rs[k], '[\x09-\x0D\x20]+$', '') AS token, length(rs[k]) - length(regexp_replace(rs[k], '[\x09-\x0D\x20]+$', '')) - 1 AS trailing FROM (SELECT doc_id, line_idx, rs, unnest(range(1, len(rs) + 1)) AS k FROM (SELECT doc_id, line_idx, regexp_extract_all(text, '{_LEXER}') AS rs FROM line))"),
)
def lexed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexer tokens of lines."""
    return T.lexed(V.line(spark, sf_dir)).select("doc_id", "line_idx", "pos", "token", "trailing")


@query("line_records", V.with_sql("line", "token", then="SELECT doc_id, line_idx, string_agg(token, ' ' ORDER BY tok_idx) AS text, min(page) AS page, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury, count(*) AS n_tokens FROM token WHERE line_idx <> 0 GROUP BY ALL"))
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line records from tokens."""
    return T.line_records(V.token(spark, sf_dir))


V.SQL["broken"] = """
SELECT doc_id, line_idx, pos, tok_idx, CASE WHEN pos = last_pos AND line_idx % 2 = 0 AND regexp_matches(token, '[A-Za-z]$') THEN token || '-' ELSE token END AS token FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id, line_idx) AS last_pos FROM token)"""


@query(
    "dehyphenation",
    V.with_sql(
        "line",
        "token",
        "broken",
        then="""SELECT b.doc_id, b.tok_idx, b.lhs, b.rhs, o.w IS NOT NULL OR k.w IS NOT NULL AS joined, CASE WHEN o.w IS NOT NULL OR k.w IS NOT NULL THEN lhs || rhs ELSE lhs || '-' || rhs END AS word
FROM (SELECT *, regexp_replace(token, '-$', '') AS lhs, regexp_replace(lower(regexp_replace(token, '-$', '') || rhs), '[^A-Za-z0-9_]', '', 'g') AS w FROM (SELECT *, lead(token) OVER w AS rhs, lead(line_idx) OVER w AS rhs_line FROM broken WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)) WHERE regexp_matches(token, '[A-Za-z]-$') AND rhs_line > line_idx) b
LEFT JOIN (SELECT DISTINCT doc_id, lower(token) AS w FROM broken) o ON b.doc_id = o.doc_id AND b.w = o.w LEFT JOIN (SELECT DISTINCT regexp_replace(lower(unnest(string_split(p_name, ' '))), '[^a-z]', '', 'g') AS w FROM part) k ON b.w = k.w""",
    ),
)
def dehyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined across line ends by dictionary or the document's own words."""
    from pyspark.sql import Window

    tokens = V.token(spark, sf_dir)
    last = F.max("pos").over(Window.partitionBy("doc_id", "line_idx"))
    cut = (F.col("pos") == last) & (F.col("line_idx") % 2 == 0) & F.col("token").rlike("[A-Za-z]$")
    broken = tokens.withColumn("_cut", cut).withColumn("token", F.when(F.col("_cut"), F.concat("token", F.lit("-"))).otherwise(F.col("token")))
    words = V.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.regexp_replace(F.lower("w"), "[^a-z]", "").alias("word"))
    return T.dehyphenated(broken, words)


@query("formatted_text", V.with_sql("line", then="SELECT doc_id, sha1(string_agg(text || chr(10), '' ORDER BY line_idx)) AS sha FROM line GROUP BY doc_id"))
def formatted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document text from lines."""
    return T.formatted_text(V.line(spark, sf_dir)).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha"))


@query("token_ranges", V.with_sql("line", "token", then="SELECT doc_id, tok_idx - 20 AS tok_idx, token FROM token WHERE tok_idx BETWEEN 20 AND 59"))
def token_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each document's tokens."""
    return T.token_range(V.token(spark, sf_dir), 20, 60).select("doc_id", "tok_idx", "token")


@query("pagination", V.with_sql("line", then="SELECT doc_id, line_idx FROM (SELECT *, lag(line_idx) OVER w IS NULL AS f, lead(line_idx) OVER w IS NULL AS l FROM line WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)) WHERE NOT (regexp_matches(text, '^.{0,60}$') AND (l OR f AND page > 0))"))
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without artefacts at page edges."""
    return T.without_pagination(V.line(spark, sf_dir), "^.{0,60}$").select("doc_id", "line_idx")


@query("thesis_flags", V.with_sql("line", "token", then="SELECT doc_id, count(*) AS n_tokens, coalesce(bool_or(lower(token) IN ('dissertation', 'thesis')), false) AS is_thesis FROM token GROUP BY doc_id"))
def thesis_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name themselves theses (F2)."""
    return TF.with_thesis(V.token(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("is_thesis").alias("is_thesis"))


@query("page_flags", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, max(lower(token) = 'the') OVER (PARTITION BY doc_id, page) AS page_has_word, CASE WHEN page < 4 THEN 'ONPAGE' || page END AS on_page FROM token"))
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page flags of tokens."""
    return TF.with_page_flags(V.token(spark, sf_dir), "the").select("doc_id", "tok_idx", "page_has_word", "on_page")


@query(
    "line_regions",
    V.with_sql("line", then="""SELECT doc_id, line_idx, region, count(*) OVER (PARTITION BY doc_id, page, region) AS region_size FROM (SELECT doc_id, page, line_idx, CAST(sum(CASE WHEN coalesce(distance > 15 OR abs(distance - before) > 2, false) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS region
FROM (SELECT *, lag(distance) OVER w AS before FROM (SELECT *, lag(lly) OVER w - lly AS distance FROM line WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)) WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)) WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx))"""),
)
def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of evenly spaced lines."""
    return TF.line_regions(V.line(spark, sf_dir)).select("doc_id", "line_idx", "region", "region_size")


@query("line_ends", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, lead(tok_idx) OVER w IS NULL AS is_last, first_value(font) OVER w <> font AS differs FROM token WINDOW w AS (PARTITION BY doc_id, line_idx ORDER BY tok_idx)"))
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-relative token flags."""
    return TF.with_line_fonts(V.token(spark, sf_dir)).select("doc_id", "tok_idx", "is_last", "differs")


@query(
    "last_format_tokens",
    V.with_sql("line", "token", then="""SELECT doc_id, tok_idx, last_format, CASE WHEN last_format IS NULL THEN NULL WHEN regexp_matches(last_format, '^[0-9]+$') THEN 'number' WHEN NOT regexp_matches(last_format, '^[A-Za-z]') THEN 'not_letter' ELSE 'word' END AS last_format_kind
FROM (SELECT doc_id, tok_idx, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_format FROM (SELECT *, CASE WHEN coalesce(font <> lag(font) OVER (PARTITION BY doc_id ORDER BY tok_idx), true) THEN token END AS mark FROM token))"""),
)
def last_format_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last token where the format changed."""
    return TF.with_last_format_token(V.token(spark, sf_dir)).select("doc_id", "tok_idx", "last_format", "last_format_kind")


@query("regex_features", V.with_sql("line", "token", then="SELECT token, n, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_full_match(token, '{p}') THEN '{n}' END" for n, p in TF.PATTERNS.items()) + "], lambda x: x IS NOT NULL)), ',') AS features FROM (SELECT token, count(*) AS n FROM token GROUP BY token)"))
def regex_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern features of the different tokens."""
    words = V.token(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return words.select("token", "n", F.array_join(TF.regex_features(F.col("token")), ",").alias("features"))


@query("lexicon_features", V.with_sql("line", "token", then="SELECT doc_id, count(*) AS n_tokens, CAST(sum(CASE WHEN l.w IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM token t LEFT JOIN (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS w FROM benchmark) l ON lower(t.token) = l.w GROUP BY doc_id"))
def lexicon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a lexicon has."""
    lexicon = V.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    flagged = TF.lexicon_features(V.token(spark, sf_dir), lexicon, "in_lexicon")
    return flagged.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("in_lexicon").cast("long")).alias("n_hits"))


@query("phrase_matches", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, p.n AS n, p.phrase AS phrase FROM (SELECT doc_id, tok_idx, unnest(list_filter([{'n': CAST(2 AS BIGINT), 'phrase': lower(token) || ' ' || lower(nx)}, {'n': CAST(1 AS BIGINT), 'phrase': lower(token)}], lambda x: x.phrase IN ('of the', 'in the', 'de la', 'and the', 'with'))) AS p FROM (SELECT doc_id, tok_idx, token, lead(token) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS nx FROM token))"))
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a lexicon in the tokens."""
    phrases = spark.createDataFrame([(x,) for x in ("of the", "in the", "de la", "and the", "with")], "phrase string")
    return TF.phrase_matches(V.token(spark, sf_dir), phrases, 2)


@query("page_ranges", V.with_sql("line", "token", then="SELECT doc_id, tok_idx FROM (SELECT *, (tok_idx % 50) || '-' || (doc_id % 60) AS r FROM token) WHERE tok_idx % 50 < doc_id % 60"))
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges among tokens."""
    ranges = V.token(spark, sf_dir).withColumn("token", F.concat(F.col("tok_idx") % 50, F.lit("-"), F.col("doc_id") % 60))
    return TF.with_page_ranges(ranges).filter("is_page_range").select("doc_id", "tok_idx")


@query("offset_features", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, concat_ws(',', f, lag(f) OVER w || '@-1', lead(f) OVER w || '@1') AS features FROM (SELECT doc_id, tok_idx, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'CAP' END AS f FROM token) WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)"))
def offset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of neighbours."""
    own = F.array_compact(F.array(F.when(F.col("token").rlike("^[A-Z]"), "CAP")))
    marked = TF.offset_features(V.token(spark, sf_dir).withColumn("features", own), "features", (-1, 1))
    return marked.select("doc_id", "tok_idx", F.array_join("features", ",").alias("features"))


V.SQL["hyphened"] = "SELECT doc_id, tok_idx, line_idx, CASE WHEN (lead(line_idx) OVER w IS NULL OR lead(line_idx) OVER w <> line_idx) AND line_idx % 3 = 1 OR tok_idx % 17 = 5 THEN '-' ELSE token END AS token FROM token WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)"


@query(
    "withheld_hyphens",
    V.with_sql(
        "line",
        "token",
        "hyphened",
        then="""SELECT doc_id, kept - 1 AS tok_idx, line_idx, token, kept > 1 AND bool_or(gone) OVER (PARTITION BY doc_id, kept) AS split_lhs FROM (SELECT *, CAST(sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS BIGINT) AS kept FROM (
SELECT *, token = '-' AND tok_idx = max(tok_idx) OVER (PARTITION BY doc_id, line_idx) AS gone FROM hyphened)) QUALIFY NOT gone""",
    ),
)
def withheld_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphens at line ends withheld from the tokens, across pages too (T6); every third line and some words are made to end in one."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    last = F.coalesce(F.lead("line_idx").over(order) != F.col("line_idx"), F.lit(True))
    hyphen = last & (F.col("line_idx") % 3 == 1) | (F.col("tok_idx") % 17 == 5)
    tokens = V.token(spark, sf_dir).select("doc_id", "tok_idx", "line_idx", F.when(hyphen, "-").otherwise(F.col("token")).alias("token"))
    return T.withheld_hyphens(tokens)
