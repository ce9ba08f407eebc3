"""Queries over line features, segmentation, body layout, grants and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import body as B
from foliograph.operators import evaluation as E
from foliograph.operators import grants as G
from foliograph.operators import line_features as L
from foliograph.operators import segmentation as S
from foliograph.plans import views as V
from foliograph.plans.catalog import query

_SQ = r"regexp_replace(text, '[\x09-\x0D\x20]', '', 'g')"
_FOUND = r"""CASE WHEN regexp_matches(sq, '^\[.+\]') OR regexp_matches(sq, '^\(.+\)') THEN 'beginBrackets' END, CASE WHEN regexp_matches(sq, '^[0-9]+\.?\p{Lu}') THEN 'beginsNumberCapital' END, CASE WHEN regexp_matches(sq, '[^\p{Ll}\p{Lu}]\p{Lu}\.$') THEN 'endsWithCapPeriod' END,
CASE WHEN regexp_matches(sq, '[0-9]+-(-)?[0-9]+') THEN 'containsPageRange' END, CASE WHEN regexp_matches(sq, '(19|20)[0-9][0-9]') THEN 'containsYear' END, CASE WHEN contains(lower(sq), 'appendix') THEN 'containsAppendix' END, CASE WHEN contains(lower(sq), 'received') THEN 'containsReceived' END, CASE WHEN contains(lower(sq), 'address') THEN 'containsAddress' END,
CASE WHEN regexp_matches(sq, '\w+@\w+\.\w+') THEN 'containsEmail' END, CASE WHEN regexp_matches(sq, '(ftp|http)://\w+\.\w+') THEN 'containsURL' END, CASE WHEN right(sq, 1) IN (',', ':', '-') THEN 'endsWithPunctNotPeriod' END, CASE WHEN regexp_matches(sq, '[0-9]') THEN 'containsDigit' END"""
V.SQL["lex"] = rf"""
SELECT *, list_sort(list_filter([CASE WHEN marks = 0 THEN 'noSpecialPuncts' WHEN marks > 3 THEN 'manySpecialPuncts' ELSE 'someSpecialPuncts' END, {_FOUND}, CASE WHEN NOT regexp_matches(sq, '\.$') THEN 'noEndingPeriod' END, CASE WHEN regexp_matches(text, 'et(\.)?\sal') THEN 'containsEtAl' END,
CASE WHEN regexp_matches(text, '^(\p{{Lu}}\.\s*)+\s+[\p{{Lu}}\p{{Ll}}]+') OR regexp_matches(sq, '^\p{{Lu}}[\p{{Lu}}\p{{Ll}}]+,\p{{Lu}}[.,]') THEN 'beginsCapitalInitials' END], lambda x: x IS NOT NULL)) AS features
FROM (SELECT *, {_SQ} AS sq, length(regexp_replace(text, '[^,.:]', '', 'g')) AS marks FROM line)"""


@query("line_lexical", V.with_sql("line", "lex", then="SELECT doc_id, line_idx, array_to_string(features, ',') AS features FROM lex"))
def line_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical features of lines (L1, L4)."""
    return L.with_lexical_features(V.line(spark, sf_dir)).select("doc_id", "line_idx", F.array_join("features", ",").alias("features"))


@query(
    "enumeration_styles",
    V.with_sql("line", "lex", then="""SELECT doc_id, brackets, numbers, initials, CASE WHEN brackets > numbers AND brackets > initials AND brackets > least THEN 'brackets' WHEN numbers > brackets AND numbers > initials AND numbers > least THEN 'numbers' WHEN initials > brackets AND initials > numbers AND initials > least THEN 'initials' ELSE 'none' END AS style
FROM (SELECT doc_id, count(*) FILTER (list_contains(features, 'beginBrackets')) AS brackets, count(*) FILTER (list_contains(features, 'beginsNumberCapital')) AS numbers, count(*) FILTER (list_contains(features, 'beginsCapitalInitials')) AS initials, CASE WHEN max(page) + 1 > 2 THEN 4 ELSE 1 END AS least FROM lex GROUP BY doc_id)"""),
)
def enumeration_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant enumeration style (L2)."""
    return L.enumeration_styles(V.line(spark, sf_dir))


@query(
    "line_layout",
    V.with_sql("line", then="""SELECT doc_id, line_idx, new_page, last_on_page, new_column, indented, untabbed, new_font, short_line, coalesce(gap - lag(gap) OVER w > 1, false) AS big_space_before FROM (
SELECT *, coalesce(lag(page) OVER w <> page, false) AS new_page, coalesce(lead(page) OVER w <> page, true) AS last_on_page, coalesce(lag(page) OVER w = page AND lly > lag(lly) OVER w, false) AS new_column, coalesce(lag(page) OVER w = page AND llx > lag(llx) OVER w, false) AS indented,
coalesce(lag(page) OVER w = page AND llx < lag(llx) OVER w, false) AS untabbed, coalesce(lag(font) OVER w <> font, false) AS new_font, length(text) <= 0.75 * floor(sum(length(text)) OVER (PARTITION BY doc_id) / count(*) OVER (PARTITION BY doc_id)) AS short_line, CASE WHEN lag(page) OVER w = page THEN lag(lly) OVER w - lly END AS gap
FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)) WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)"""),
)
def line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout features of lines (L3)."""
    return L.with_layout_features(V.line(spark, sf_dir)).select("doc_id", "line_idx", "new_page", "last_on_page", "new_column", "indented", "untabbed", "new_font", "short_line", "big_space_before")


@query(
    "reference_fonts",
    V.with_sql("line", "lex", then="SELECT doc_id, font FROM (SELECT doc_id, font, count(*) AS n FROM lex WHERE list_contains(features, 'beginBrackets') OR list_contains(features, 'beginsNumberCapital') OR list_contains(features, 'beginsCapitalInitials') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font) = 1"),
)
def reference_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common font of marked lines (L3)."""
    return L.reference_fonts(V.line(spark, sf_dir))


V.SQL["labelled"] = "SELECT *, CASE WHEN line_idx < doc_id % 4 THEN 'pre' WHEN line_idx % 9 = 8 THEN 'junk' WHEN doc_id % 7 = 0 AND line_idx = 6 THEN 'pre' ELSE 'biblio' END AS label, line_idx % 3 = doc_id % 3 AS new_ref FROM line"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("line_idx"), F.col("doc_id")
    label = F.when(i < d % 4, "pre").when(i % 9 == 8, "junk").when((d % 7 == 0) & (i == 6), "pre").otherwise("biblio")
    return V.line(spark, sf_dir).withColumn("label", label).withColumn("new_ref", i % 3 == d % 3)


@query(
    "bibliography_labels",
    V.with_sql("line", "labelled", then="SELECT doc_id, line_idx, CASE WHEN label = 'biblio' THEN CASE WHEN new_ref THEN 'biblio-B' ELSE 'biblio-I' END ELSE label END AS bio, bool_or(label = 'pre') OVER (PARTITION BY doc_id) AS broken FROM (SELECT *, min(CASE WHEN label <> 'pre' THEN line_idx END) OVER (PARTITION BY doc_id) AS f FROM labelled) WHERE line_idx >= f"),
)
def bibliography_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography lines with begin and inside labels."""
    return L.bibliography(_labelled(spark, sf_dir)).select("doc_id", "line_idx", "bio", "broken")


@query("duplicate_starts", V.with_sql("line", then="SELECT start, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha1(string_agg(text, chr(10) ORDER BY line_idx)) AS start FROM line WHERE line_idx < 10 GROUP BY doc_id) GROUP BY start HAVING count(*) > 1"))
def duplicate_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same first lines."""
    return L.duplicate_starts(V.line(spark, sf_dir))


# headings stand where a document's number puts them
V.SQL["paper"] = """
SELECT doc_id, line_idx, page, llx, CASE WHEN line_idx = doc_id % 5 AND doc_id % 3 <> 0 THEN 'Abstract' WHEN line_idx = doc_id % 5 + 3 AND doc_id % 4 <> 0 THEN '1. Introduction' WHEN line_idx % 11 = 10 AND doc_id % 6 <> 0 THEN CASE WHEN line_idx % 2 = 0 THEN '5 References' ELSE 'BIBLIOGRAPHY' END ELSE text END AS text FROM line"""


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("line_idx"), F.col("doc_id")
    text = F.when((i == d % 5) & (d % 3 != 0), "Abstract").when((i == d % 5 + 3) & (d % 4 != 0), "1. Introduction").when((i % 11 == 10) & (d % 6 != 0), F.when(i % 2 == 0, "5 References").otherwise("BIBLIOGRAPHY")).otherwise(F.col("text"))
    return V.line(spark, sf_dir).select("doc_id", "line_idx", "page", "llx", text.alias("text"))


# headings by string functions
_INTRO = "(strpos(lower({0}), 'introduction') > 0 AND substr({0}, strpos(lower({0}), 'introduction'), 1) = 'I' AND ltrim(left({0}, strpos(lower({0}), 'introduction') - 1), '#iIvVxX.0123456789 ') = '')"
_ABSTRACT = "(lower(trim({0})) LIKE 'abstract%' AND trim({0}) LIKE 'A%' OR trim({0}) = 'abstract')"
_BIBLIO = "(lower(trim(ltrim({0}, '#iIvVxX.0123456789 '))) IN ('references', 'bibliography', 'references and notes', 'literature cited', 'acknowledgements') AND left(ltrim({0}, '#iIvVxX.0123456789 '), 1) <> lower(left(ltrim({0}, '#iIvVxX.0123456789 '), 1)) AND length({0}) - length(ltrim({0}, '#iIvVxX.0123456789 ')) <= 5)"


@query(
    "paper_sections",
    V.with_sql(
        "line",
        "paper",
        then=f"""SELECT m.doc_id, CASE WHEN a IS NOT NULL THEN coalesce(least(coalesce(np, ni), coalesce(ni, np)), n_lines) WHEN i > 0 THEN i ELSE -1 END AS header_stop, CASE WHEN b > 0 THEN b ELSE -1 END AS body_stop, n_lines,
CASE WHEN a IS NULL AND NOT coalesce(i > 0, false) THEN 'header not found' WHEN NOT coalesce(b > 0, false) THEN 'references not found' END AS error FROM (
SELECT doc_id, CASE WHEN min(line_idx) FILTER ({_ABSTRACT.format('text')}) > 0 THEN min(line_idx) FILTER ({_ABSTRACT.format('text')}) END AS a, min(line_idx) FILTER ({_INTRO.format('text')}) AS i, max(line_idx) FILTER ({_BIBLIO.format('text')}) AS b, max(line_idx) + 1 AS n_lines FROM paper GROUP BY doc_id) m
LEFT JOIN (SELECT p.doc_id, min(p.line_idx) FILTER (p.page > q.page) AS np, min(p.line_idx) FILTER ({_INTRO.format('p.text')}) AS ni FROM paper p JOIN (SELECT doc_id, min(line_idx) AS at FROM paper WHERE {_ABSTRACT.format('text')} GROUP BY doc_id) x ON p.doc_id = x.doc_id AND p.line_idx > x.at JOIN paper q ON q.doc_id = x.doc_id AND q.line_idx = x.at WHERE x.at > 0 GROUP BY p.doc_id) s ON m.doc_id = s.doc_id""",
    ),
)
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, body and references of papers."""
    found = S.sections(_papers(spark, sf_dir))
    return found.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("header_stop", "body_stop")], "n_lines", "error")


@query("journal_abstracts", V.with_sql("line", then="SELECT doc_id, min(line_idx) AS line_idx FROM (SELECT *, avg(llx) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM line) WHERE line_idx > 10 AND llx < m - 10 GROUP BY doc_id"))
def journal_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstract start by running mean indent."""
    return S.journal_abstract(V.line(spark, sf_dir), indent=10)


V.SQL["ruled"] = r"SELECT *, CASE WHEN regexp_matches(upper(text), '^[^A-Z]*REFERENCES[^A-Z]*$') THEN 'biblioPrologue' WHEN llx = 99 THEN 'junk' WHEN llx = 72 THEN 'biblio-B' ELSE 'biblio-I' END AS label FROM paper"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rule_labels(_papers(spark, sf_dir).withColumn("possible_init", F.col("llx") == 72).withColumn("ignored", F.col("llx") == 99))


@query("rule_labels", V.with_sql("line", "paper", "ruled", then="SELECT doc_id, label, count(*) AS n FROM ruled GROUP BY ALL"))
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography labels by rule."""
    return _ruled(spark, sf_dir).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


V.SQL["ref_text"] = """
SELECT doc_id, ref_no, min(line_idx) AS first_line, max(line_idx) AS last_line, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM (SELECT *, CAST(sum(CASE WHEN label = 'biblio-B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS BIGINT) AS ref_no FROM ruled) WHERE label IN ('biblio-B', 'biblio-I') AND ref_no > 0 GROUP BY ALL"""


@query("reference_texts", V.with_sql("line", "paper", "ruled", "ref_text", then="SELECT doc_id, ref_no, first_line, last_line, sha1(text) AS sha FROM ref_text"))
def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from labelled lines."""
    return S.references(_ruled(spark, sf_dir)).select("doc_id", "ref_no", "first_line", "last_line", F.sha1(F.col("text").cast("binary")).alias("sha"))


@query("oversized_references", V.with_sql("line", "paper", "ruled", "ref_text", then="SELECT *, CASE WHEN n_long = 0 THEN 'ok' WHEN n_long = 1 THEN 'one too long' ELSE 'several too long' END AS verdict FROM (SELECT doc_id, count(*) AS n_refs, count(*) FILTER (length(text) > 3200) AS n_long FROM ref_text GROUP BY doc_id)"))
def oversized_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size validation of references."""
    return S.oversized(S.references(_ruled(spark, sf_dir)))


@query("page_boxes", V.with_sql("line", then="SELECT doc_id, page, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury, count(*) AS n_lines FROM line GROUP BY ALL"))
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page boxes (B1, A3)."""
    return B.page_boxes(V.line(spark, sf_dir))


V.SQL["spaced"] = "SELECT *, ury - lly AS height, urx - llx AS width, coalesce(lly - lead(lly) OVER (PARTITION BY doc_id, page ORDER BY line_idx), -1) AS distance, CASE WHEN length(text) > 0 THEN CAST(floor((urx - llx) / length(text) + 0.5) AS BIGINT) END AS per_char FROM line"
_MODE = "SELECT doc_id, {c} AS value, count(*) AS n FROM spaced WHERE {c} >= 0 GROUP BY doc_id, {c} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(line_idx)) = 1"


@query("height_modes", V.with_sql("line", "spaced", then=_MODE.format(c="height")))
def height_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common line height, the first seen of equals."""
    return B.modes(V.line(spark, sf_dir), F.col("ury") - F.col("lly"))


@query("line_spacing", V.with_sql("line", "spaced", then="SELECT doc_id, line_idx, height, width, distance, per_char FROM spaced"))
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line metrics."""
    return B.with_spacing(V.line(spark, sf_dir)).select("doc_id", "line_idx", "height", "width", "distance", "per_char")


@query(
    "body_flags",
    V.with_sql(
        "line",
        "spaced",
        then="SELECT s.doc_id, line_idx, coalesce(lag(page) OVER w <> page, false) AS new_page, coalesce(lly > lag(lly) OVER w, false) AS up, coalesce(lly > lag(lly) OVER w AND llx < lag(llx) OVER w, false) AS up_and_left, coalesce(llx > lag(llx) OVER w, false) AS right, coalesce(height > h.value + 2, false) AS taller, coalesce(width > wd.value + 10, false) AS wider, coalesce(distance > d.value + 2, false) AS more_space, ury > 700 AS near_top, lly < 300 AS near_bottom FROM spaced s"
        + f" LEFT JOIN ({_MODE.format(c='height')}) h USING (doc_id) LEFT JOIN ({_MODE.format(c='width')}) wd USING (doc_id) LEFT JOIN ({_MODE.format(c='distance')}) d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY line_idx)",
    ),
)
def body_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative layout flags of body lines."""
    return B.with_relative_flags(V.line(spark, sf_dir)).select("doc_id", "line_idx", "new_page", "up", "up_and_left", "right", "taller", "wider", "more_space", "near_top", "near_bottom")


@query("body_lexical", V.with_sql("line", then="SELECT doc_id, line_idx, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in B.PATTERNS.items()) + "], lambda x: x IS NOT NULL)), ',') AS flags FROM line"))
def body_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical flags of body lines."""
    return V.line(spark, sf_dir).select("doc_id", "line_idx", F.array_join(B.lexical_flags(F.col("text")), ",").alias("flags"))


@query("look_ahead", V.with_sql("line", then="SELECT doc_id, line_idx, sum(CASE WHEN length(text) < 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) >= 3 AS ahead FROM line"))
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in the lines ahead."""
    return B.ahead(V.line(spark, sf_dir), F.length("text") < 80, 3, 10).select("doc_id", "line_idx", "ahead")


@query("dictionary_words", V.with_sql("line", "token", then="SELECT doc_id, line_idx, count(*) AS n_tokens, count(DISTINCT CASE WHEN regexp_replace(lower(token), '[^a-z]', '', 'g') IN ('the', 'of', 'and', 'to', 'in', 'is') THEN regexp_replace(lower(token), '[^a-z]', '', 'g') END) AS n_words FROM token GROUP BY ALL HAVING count(*) >= 3"))
def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words of lines."""
    words = spark.createDataFrame([(x,) for x in ("the", "of", "and", "to", "in", "is")], "word string")
    return B.dictionary_words(V.token(spark, sf_dir), words)


# sentences about grants, one token to a row, made from parts
V.SQL["grant_token"] = """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS tok_idx, ts[i] AS token FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT p_partkey AS doc_id, string_split('We thank Dr . Smith . This ' || CASE WHEN p_partkey % 3 = 0 THEN 'work' ELSE 'thing' END || ' was ' || CASE WHEN p_partkey % 2 = 0 THEN 'supported' ELSE 'funded' END || ' by the National Science Foundation under grant IIS-' || (p_partkey * 7919) || ' and NSF . ' || CASE WHEN p_partkey % 5 = 0 THEN 'The' ELSE 'the' END || ' end', ' ') AS ts FROM part))"""


def _grant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.concat(F.lit("We thank Dr . Smith . This "), F.when(p % 3 == 0, "work").otherwise("thing"), F.lit(" was "), F.when(p % 2 == 0, "supported").otherwise("funded"), F.lit(" by the National Science Foundation under grant IIS-"), p * 7919, F.lit(" and NSF . "), F.when(p % 5 == 0, "The").otherwise("the"), F.lit(" end"))
    return V.table(spark, sf_dir, "part").select(p.alias("doc_id"), F.posexplode(F.split(text, " ")).alias("tok_idx", "token")).withColumn("tok_idx", F.col("tok_idx").cast("long"))


V.SQL["sentence"] = r"""
SELECT doc_id, tok_idx, token, CAST(coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM (SELECT *, max(CASE WHEN e = 1 THEN tok_idx END) OVER (PARTITION BY doc_id) AS closed FROM (
SELECT *, CASE WHEN token IN ('.', '?', '!') AND NOT coalesce(lower(lag(token) OVER w) IN ('dr', 'mr', 'mrs', 'ms', 'no', 'nos'), false) AND (regexp_matches(coalesce(lead(token) OVER w, ''), '^[\p{Lu}\p{Nd}]') OR coalesce(lead(token) OVER w, '') IN ('+', '?', 'x', 'y')) AND coalesce(lead(token, 2) OVER w, '') <> '.' THEN 1 ELSE 0 END AS e FROM grant_token WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx))) WHERE tok_idx <= closed"""


@query("grant_sentences", V.with_sql("grant_token", "sentence", then="SELECT * FROM sentence"))
def grant_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of token sequences."""
    return G.sentences(_grant_tokens(spark, sf_dir)).select("doc_id", "tok_idx", "token", "sentence")


@query("support_sentences", V.with_sql("grant_token", "sentence", then="SELECT doc_id, sentence, min(tok_idx) + 2 AS after FROM (SELECT *, max(CASE WHEN lower(token) IN ('work', 'project', 'research', 'author', 'authors', 'partially', 'paper', 'report') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sentence ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hint, lead(token) OVER (PARTITION BY doc_id, sentence ORDER BY tok_idx) AS nxt FROM sentence) WHERE hint = 1 AND lower(nxt) = 'by' AND lower(token) IN ('supported', 'funded', 'sponsored') GROUP BY ALL"))
def support_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that acknowledge support (R2)."""
    return G.support_sentences(G.sentences(_grant_tokens(spark, sf_dir)))


@query("grant_numbers", V.with_sql("grant_token", then=r"SELECT doc_id, tok_idx, token FROM (SELECT *, regexp_replace(regexp_replace(token, '^[(#]+', ''), '[.,)]+$', '') AS core FROM grant_token) WHERE regexp_matches(core, '^[A-Za-z0-9/.-]*$') AND (length(regexp_replace(core, '[^0-9]', '', 'g')) >= 5 OR length(regexp_replace(core, '[^0-9]', '', 'g')) >= 3 AND length(token) >= 5 AND length(regexp_replace(core, '[^0-9A-Z/.-]', '', 'g')) / length(token) > 0.5)"))
def grant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that look like grant numbers."""
    return _grant_tokens(spark, sf_dir).filter(G.is_grant_number(F.col("token")))


@query(
    "grant_labels",
    V.with_sql(
        "grant_token",
        then="SELECT p_partkey AS doc_id, CAST(1 AS BIGINT) AS sentence, 'the National Science Foundation under grant IIS-' || (p_partkey * 7919) || ' and NSF .' AS text, 'grant-background B-grant-institution I-grant-institution I-grant-institution grant-background grant-background ' || CASE WHEN p_partkey = 0 THEN 'grant-background' ELSE 'B-grant-number' END || ' grant-background B-grant-institution grant-background' AS labels FROM part WHERE p_partkey % 15 = 0",
    ),
)
def grant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution and number labels of support sentences."""
    found = G.sentences(_grant_tokens(spark, sf_dir))
    hits = found.join(G.support_sentences(found), ["doc_id", "sentence"]).filter(F.col("tok_idx") >= F.col("after"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"])
    each = hits.groupBy("doc_id", "sentence").agg(tokens.alias("tokens"))
    return each.select("doc_id", "sentence", F.array_join("tokens", " ").alias("text"), F.array_join(G.grant_labels(F.col("tokens")), " ").alias("labels"))


@query("award_numbers", "SELECT p_partkey, CASE WHEN length(CAST(p_partkey * 7919 AS VARCHAR)) = 7 THEN CAST(p_partkey * 7919 AS VARCHAR) END AS award FROM part")
def award_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean award numbers."""
    return V.table(spark, sf_dir, "part").select("p_partkey", G.nsf_number(F.concat(F.lit("IIS-"), F.col("p_partkey") * 7919)).alias("award"))


V.SQL["judged"] = "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 900 THEN 'good' WHEN n_chars > 300 THEN 'bad' ELSE 'short' END AS predicted, source FROM labels JOIN documents USING (doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    both = V.table(spark, sf_dir, "labels").join(V.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return both.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(n > 900, "good").when(n > 300, "bad").otherwise("short").alias("predicted"), "source")


@query("confusion", V.with_sql("judged", then="SELECT truth, predicted, count(*) AS n FROM judged GROUP BY ALL"))
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix (M8, A10)."""
    return E.confusion(_judged(spark, sf_dir))


@query(
    "label_scores",
    V.with_sql("judged", then="""SELECT label, n_true, n_found, hit, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (SELECT *, CASE WHEN n_found = 0 THEN 1.0 ELSE hit / n_found END AS p, CASE WHEN n_true = 0 THEN 1.0 ELSE hit / n_true END AS r FROM (
SELECT label, (SELECT count(*) FROM judged WHERE truth = label) AS n_true, (SELECT count(*) FROM judged WHERE predicted = label) AS n_found, (SELECT count(*) FROM judged WHERE truth = label AND predicted = label) AS hit FROM (SELECT DISTINCT unnest([truth, predicted]) AS label FROM judged)))"""),
)
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by label (M8)."""
    scored = E.label_scores(_judged(spark, sf_dir))
    return scored.select("label", "n_true", "n_found", "hit", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "truth_comparison",
    V.with_sql("author", then="""SELECT coalesce(t.author_id, f.author_id) AS author_id, expected, actual, CASE WHEN f.author_id IS NULL THEN 'missed' WHEN t.author_id IS NULL THEN 'extra' WHEN expected = actual THEN 'right' ELSE 'wrong' END AS verdict
FROM (SELECT author_id, lower(last) AS expected FROM author WHERE author_id % 5 <> 0) t FULL OUTER JOIN (SELECT author_id, CASE WHEN author_id % 4 = 0 THEN lower(first) ELSE lower(last) END AS actual FROM author WHERE author_id % 7 <> 0) f ON t.author_id = f.author_id"""),
)
def truth_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth against found rows."""
    a = V.author(spark, sf_dir)
    truth = a.filter(F.col("author_id") % 5 != 0).select("author_id", F.lower("last").alias("email"))
    found = a.filter(F.col("author_id") % 7 != 0).select("author_id", F.when(F.col("author_id") % 4 == 0, F.lower("first")).otherwise(F.lower("last")).alias("email"))
    return E.compared(truth, found, ["author_id"], "email")


@query("tallies", V.with_sql("judged", then="SELECT coalesce(source, 'all files') AS file, count(*) AS n, count(*) FILTER (truth = predicted) AS n_right, round(count(*) FILTER (truth = predicted) / count(*), 9) AS share FROM judged GROUP BY ROLLUP (source)"))
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares by file and for all."""
    rows = _judged(spark, sf_dir).withColumn("verdict", F.when(F.col("truth") == F.col("predicted"), "right").otherwise("wrong"))
    return E.tallies(rows, "source", "verdict").select(F.coalesce("source", F.lit("all files")).alias("file"), "n", "n_right", F.round("share", 9).alias("share"))


@query(
    "run_lengths",
    "SELECT user_id, event_type, min(event_id) AS start, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, run, event_type",
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal events."""
    return E.run_lengths(V.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("message_shares", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY event_type")
def message_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message counts with their share."""
    return E.message_shares(V.table(spark, sf_dir, "events"), "event_type").select("event_type", "n", F.round("share", 9).alias("share"))


@query("mention_counts", "SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a three-way dimension join."""
    orders, customer, nation = (V.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"))


@query("width_ranks", V.with_sql("line", "spaced", then="SELECT doc_id, width, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, width) AS rank FROM spaced GROUP BY doc_id, width QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, width) <= 3"))
def width_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most common line widths of each document."""
    counts = B.with_spacing(V.line(spark, sf_dir)).groupBy("doc_id", "width").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "width"))).filter("rank <= 3")


@query("grant_records", V.with_sql("grant_token", then="SELECT p_partkey AS doc_id, CAST(1 AS BIGINT) AS sentence, r AS record, CASE WHEN r = 1 THEN 'National Science Foundation' ELSE 'NSF' END AS institution, CASE WHEN r = 1 AND p_partkey > 0 THEN 'IIS-' || (p_partkey * 7919) ELSE '' END AS numbers FROM part, (SELECT CAST(unnest([1, 2]) AS BIGINT) AS r) WHERE p_partkey % 15 = 0"))
def grant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions with their grant numbers."""
    found = G.sentences(_grant_tokens(spark, sf_dir))
    hits = found.join(G.support_sentences(found), ["doc_id", "sentence"]).filter(F.col("tok_idx") >= F.col("after"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"])
    each = hits.groupBy("doc_id", "sentence").agg(tokens.alias("tokens"))
    return G.grant_records(each.withColumn("labels", G.grant_labels(F.col("tokens"))))
