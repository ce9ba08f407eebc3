"""Queries over spans, nested elements, selections, combinations and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import alignment as A
from foliograph.operators import spans as P
from foliograph.operators.elements import elements
from foliograph.plans import views as V
from foliograph.plans.catalog import query

# tokens with character places as if single blanks stood between
V.SQL["placed"] = "SELECT doc_id, tok_idx, token, llx, lly, urx, ury, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM token"
V.SQL["marked"] = "SELECT doc_id, span_id, label, start, stop FROM (SELECT DISTINCT doc_id FROM placed), LATERAL (VALUES (1, 'authors', doc_id % 7, 60), (2, 'name', doc_id % 7, 20 + doc_id % 5), (3, 'note', 30, 44), (4, 'none', 90, 80)) AS s(span_id, label, start, stop)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)).cast("long")
    return V.token(spark, sf_dir).select("doc_id", "tok_idx", "token", "llx", "lly", "urx", "ury", start.alias("start"))


def _marked(placed: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    span = lambda k, label, start, stop: F.struct(F.lit(k).alias("span_id"), F.lit(label).alias("label"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    spans = F.array(span(1, "authors", d % 7, F.lit(60)), span(2, "name", d % 7, 20 + d % 5), span(3, "note", F.lit(30), F.lit(44)), span(4, "none", F.lit(90), F.lit(80)))
    return placed.select("doc_id").distinct().select("doc_id", F.inline(spans))


_LABELS = "SELECT p.doc_id, p.tok_idx, coalesce(string_agg(m.label, ':' ORDER BY m.start, m.stop DESC, m.label), 'O') AS label FROM placed p LEFT JOIN marked m ON p.doc_id = m.doc_id AND m.start <= p.start AND p.start <= m.stop GROUP BY p.doc_id, p.tok_idx"
V.SQL["active"] = _LABELS


@query("token_labels", V.with_sql("line", "token", "placed", "marked", then=_LABELS))
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active labels of tokens."""
    placed = _placed(spark, sf_dir)
    return P.token_labels(placed, _marked(placed)).select("doc_id", "tok_idx", "label")


@query("span_tokens", V.with_sql("line", "token", "placed", "marked", then="SELECT m.doc_id, m.span_id, min(p.tok_idx) AS first_token, max(p.tok_idx) AS last_token, string_agg(p.token, ' ' ORDER BY p.tok_idx) AS text FROM marked m LEFT JOIN placed p ON p.doc_id = m.doc_id AND m.start <= p.start AND p.start <= m.stop GROUP BY m.doc_id, m.span_id"))
def span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token bounds of spans and their text."""
    placed = _placed(spark, sf_dir)
    return P.span_tokens(placed, _marked(placed)).select("doc_id", "span_id", "first_token", "last_token", "text")


# paths of two levels; a caret every fourth token
V.SQL["pathed"] = "SELECT doc_id, tok_idx, token, llx, lly, urx, ury, tok_idx // 12 % 3 AS a, tok_idx // 4 % 2 AS b, tok_idx % 8 = 6 AS caret FROM token"


@query(
    "nested_elements",
    V.with_sql(
        "line",
        "token",
        "pathed",
        then="""SELECT doc_id, level, path, min(tok_idx) AS first_token, max(tok_idx) AS last_token, string_agg(token, ' ' ORDER BY tok_idx) AS text, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury FROM (
SELECT *, sum(CASE WHEN caret OR coalesce(prev, '') <> path THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, level ORDER BY tok_idx) AS element FROM (SELECT *, lag(path) OVER (PARTITION BY doc_id, level ORDER BY tok_idx) AS prev FROM (
SELECT doc_id, tok_idx, token, llx, lly, urx, ury, CAST(1 AS INTEGER) AS level, 'x' || a AS path, false AS caret FROM pathed UNION ALL SELECT doc_id, tok_idx, token, llx, lly, urx, ury, 2, 'x' || a || ':y' || b, caret FROM pathed))) GROUP BY doc_id, level, path, element""",
    ),
)
def nested_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label paths as nested elements with their boxes (M4, M5)."""
    t = F.col("tok_idx")
    label = F.concat(F.lit("x"), F.floor(t / 12) % 3, F.lit(":"), F.when(t % 8 == 6, "^").otherwise(""), F.lit("y"), F.floor(t / 4) % 2)
    return elements(V.token(spark, sf_dir).withColumn("label", label)).drop("element")


V.SQL["bio"] = "SELECT doc_id, tok_idx, CASE tok_idx % 10 WHEN 0 THEN 'B-title' WHEN 1 THEN 'I-title' WHEN 4 THEN 'B-date' WHEN 5 THEN 'I-date' ELSE 'O' END AS label FROM token"


def _bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("tok_idx") % 10
    label = F.when(k == 0, "B-title").when(k == 1, "I-title").when(k == 4, "B-date").when(k == 5, "I-date").otherwise("O")
    return V.token(spark, sf_dir).select("doc_id", "tok_idx", label.alias("label"))


@query("bio_paths", V.with_sql("line", "token", "bio", then="SELECT doc_id, tok_idx, CASE WHEN starts_with(label, 'B-') THEN '^' || substr(label, 3) WHEN starts_with(label, 'I-') THEN substr(label, 3) ELSE label END AS label FROM bio"))
def bio_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin and inside labels as paths (M5)."""
    return P.bio_paths(_bio(spark, sf_dir))


@query("reopened_fields", V.with_sql("line", "token", "bio", then="SELECT doc_id, label AS field, count(*) AS runs FROM (SELECT *, coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY tok_idx) <> label, true) AS new FROM bio) WHERE new AND label IN ('B-title', 'I-date') GROUP BY ALL HAVING count(*) > 1"))
def reopened_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields opened more than once (M2)."""
    return P.reopened_fields(_bio(spark, sf_dir), ("B-title", "I-date"))


@query("rectangle_mentions", V.with_sql("line", then="SELECT doc_id, page, rect_id, line_idx, CAST(sum(CASE WHEN llx - x0 <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, rect_id ORDER BY line_idx) AS BIGINT) AS mention FROM line, (VALUES (1, 70, 400, 600, 720), (2, 80, 100, 900, 500)) AS r(rect_id, x0, y0, x1, y1) WHERE llx >= x0 AND urx <= x1 AND lly >= y0 AND ury <= y1"))
def rectangle_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in rectangles, in mentions by indent."""
    lines = V.line(spark, sf_dir)
    rectangles = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rect_id", "x0", "y0", "x1", "y1"), row)]) for row in ((1, 70, 400, 600, 720), (2, 80, 100, 900, 500))])))
    return P.in_rectangles(lines, rectangles).select("doc_id", "page", "rect_id", "line_idx", "mention")


@query("event_trigrams", "SELECT user_id, event_id, a || '>' || b || '>' || c AS trigram FROM (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_id, 2) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE last IS NOT NULL")
def event_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring values in threes."""
    return P.contiguous(V.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 3).select("user_id", "event_id", F.array_join("values", ">").alias("trigram"))


@query("author_pairs", V.with_sql("author", then="SELECT x.doc_id, x.last AS a, y.last AS b FROM (SELECT DISTINCT doc_id, last FROM author) x JOIN (SELECT DISTINCT doc_id, last FROM author) y ON x.doc_id = y.doc_id AND x.last < y.last"))
def author_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two authors of a paper."""
    return P.combinations(V.author(spark, sf_dir), "doc_id", "last")


@query("citation_union", V.with_sql("reference", "cited", then="SELECT doc_id, ref_no, text FROM cited WHERE ref_no % 2 = 0 UNION ALL SELECT doc_id, ref_no, text FROM cited WHERE ref_no % 3 = 0"))
def citation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of abstract and body together."""
    cited = V.cited(spark, sf_dir).select("doc_id", "ref_no", "text")
    return cited.filter("ref_no % 2 = 0").unionByName(cited.filter("ref_no % 3 = 0"))


@query("common_words", V.with_sql("line", "token", then="SELECT lower(token) AS word FROM token WHERE doc_id % 2 = 0 INTERSECT SELECT lower(token) FROM token WHERE doc_id % 2 = 1"))
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that both halves of the papers have."""
    words = V.word(spark, sf_dir).select("doc_id", F.lower("token").alias("word"))
    return P.in_all(words, "word", F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1)


@query("seeded_split", "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('1868:' || doc_id), 1, 8) AS BIGINT) < 3221225472 THEN 'train' ELSE 'test' END AS part FROM documents")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split three to one by a seed."""
    return P.seeded_split(V.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.75, 1868)


@query("open_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def open_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not done yet."""
    return P.not_done(V.table(spark, sf_dir, "documents").select("doc_id", "source"), V.table(spark, sf_dir, "labels"), "doc_id")


@query("event_attributes", "SELECT user_id, count(DISTINCT event_type) AS n_names, count(DISTINCT (event_type, CAST(value AS INTEGER) % 5)) AS n_values, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM (SELECT user_id, event_type, floor(value) AS value FROM events) GROUP BY user_id")
def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-valued attributes: names and numbers of values."""
    pairs = V.table(spark, sf_dir, "events").select("user_id", "event_type", (F.floor("value").cast("int") % 5).cast("string").alias("v"))
    held = P.attributes(pairs, "user_id", "event_type", "v")
    n = F.aggregate(F.map_values("attributes"), F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    return held.select("user_id", F.size("attributes").cast("long").alias("n_names"), n.alias("n_values"), F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("names"))


@query("normalised_texts", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'), ' ')) AS sum FROM documents")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with single blanks."""
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(P.normalised(F.col("text")).cast("binary")).alias("sum"))


@query("aligned_spans")
def aligned_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of the turns of conversations found again in another reading of the text, with a note in front and letters misread."""
    turns = V.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    texts = turns.select("doc_id", F.col("text").alias("old"), F.concat(F.lit("Turn: "), F.regexp_replace(F.regexp_replace("text", "ti", "fi"), "ff|nn", "n")).alias("new"))
    n, half = F.length("text"), F.floor(F.length("text") / 2)
    marks = turns.select("doc_id", F.explode(F.array(F.struct(F.lit("first").alias("label"), F.lit(0).cast("long").alias("start"), half.alias("stop")), F.struct(F.lit("second").alias("label"), half.alias("start"), n.cast("long").alias("stop")))).alias("m"))
    return A.aligned_spans(texts, marks.select("doc_id", "m.*"))


@query("author_triples", V.with_sql("author", then="SELECT x.doc_id, x.last || ',' || y.last || ',' || z.last AS names FROM (SELECT DISTINCT doc_id, last FROM author) x JOIN (SELECT DISTINCT doc_id, last FROM author) y ON x.doc_id = y.doc_id AND x.last < y.last JOIN (SELECT DISTINCT doc_id, last FROM author) z ON y.doc_id = z.doc_id AND y.last < z.last"))
def author_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three authors of a paper."""
    return P.combinations(V.author(spark, sf_dir), "doc_id", "last", 3).select("doc_id", F.array_join("values", ",").alias("names"))


V.SQL["authored"] = "SELECT doc_id, tok_idx, replace(label, 'authors', 'author') AS label FROM active"


@query(
    "target_labels",
    V.with_sql(
        "line", "token", "placed", "marked", "active", "authored",
        then="""SELECT doc_id, tok_idx, CASE WHEN label LIKE '%note:%' AND inner_ <> 'note' THEN 'note|' ELSE '' END || CASE WHEN label LIKE '%author:%' AND inner_ <> 'author' THEN CASE WHEN lag(held) OVER (PARTITION BY doc_id ORDER BY tok_idx) THEN 'author-inside|' ELSE 'author-begin|' END ELSE '' END || inner_ AS target
FROM (SELECT *, split_part(label, ':', -1) AS inner_, label LIKE '%author%' AS held FROM authored)""",
    ),
)
def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of tokens from the spans around them."""
    placed = _placed(spark, sf_dir)
    labelled = P.token_labels(placed, _marked(placed)).withColumn("label", F.regexp_replace("label", "authors", "author"))
    return P.target_labels(labelled).select("doc_id", "tok_idx", "target")


@query("lead_markers", V.with_sql("reference", then="SELECT doc_id, ref_id, CASE WHEN ref_no % 3 = 0 THEN '<b> ' || '[' || ref_no || ']' || '  ' WHEN ref_no % 3 = 1 THEN ' ' || ref_no || '. ' ELSE '' END AS marker, last1 || ' ' || year AS rest FROM reference"))
def lead_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References cut behind their marker (M3)."""
    n = F.col("ref_no")
    marker = F.when(n % 3 == 0, F.concat(F.lit("<b> ["), n, F.lit("]  "))).when(n % 3 == 1, F.concat(F.lit(" "), n, F.lit(". "))).otherwise("")
    texts = V.reference(spark, sf_dir).select("doc_id", "ref_id", F.concat(marker, "last1", F.lit(" "), "year").alias("text"))
    size = P.lead_marker(F.col("text"))
    return texts.select("doc_id", "ref_id", F.substring("text", F.lit(1), size).alias("marker"), F.substring("text", size + 1, F.length("text")).alias("rest"))
