"""Queries over the labels of body lines. Their SQL goes through each document line by line, with what is remembered as columns of a recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import body as B
from foliograph.operators import body_labels as BL
from foliograph.plans import views as V
from foliograph.plans.catalog import query

#: Frequent words of the tables' languages.
_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "les", "un", "der", "die", "und", "el", "que", "en")
_USUAL = ("height", "width", "distance", "rise", "per_char", "n_words")

# papers in two columns with uneven gaps, whose headings, captions and notes stand where numbers put them
V.SQL["set_line"] = rf"""
SELECT *, ury - lly AS height, urx - llx AS width, coalesce(lly - lead(lly) OVER w, -1) AS distance, coalesce(ury - lead(ury) OVER w, -1) AS rise, CASE WHEN length(text) > 0 THEN CAST(floor((urx - llx) / length(text) + 0.5) AS BIGINT) END AS per_char,
CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x IN ({", ".join(f"'{w}'" for w in _WORDS)})))) AS BIGINT) AS n_words FROM (
SELECT doc_id, line_idx, page, lly + 10 + CASE WHEN k = 2 THEN 3 WHEN k = 7 THEN -1 ELSE 0 END AS ury, lly, llx, llx + least(5 * length(text), 240 + 8 * (k % 3)) AS urx, text FROM (
SELECT doc_id, line_idx, page, (doc_id + 3 * line_idx) % 13 AS k, 72 + CASE WHEN line_idx % 40 >= 25 THEN 250 ELSE 0 END + 9 * CASE WHEN (doc_id + line_idx) % 4 = 1 THEN 1 ELSE 0 END AS llx,
720 - CASE WHEN doc_id % 2 = 0 THEN 26 ELSE 13 END * (line_idx % 40 % 25) - 2 * ((line_idx * line_idx + doc_id) % 5) AS lly,
CASE (doc_id + 3 * line_idx) % 13 WHEN 0 THEN 'Table ' || line_idx || '. Values' WHEN 1 THEN 'Figure ' || line_idx || ' shows it' WHEN 2 THEN line_idx || '.1 Some Heading' WHEN 3 THEN 'RESULTS' WHEN 4 THEN substr(text, 1, 20) WHEN 5 THEN '1.5 2.5 3.5' WHEN 6 THEN substr(text, 1, 12) || ':' WHEN 7 THEN '1 ' || substr(text, 1, 30) WHEN 8 THEN 'Methods ..... 12' ELSE text END AS text FROM line)) WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)"""


def set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i, text = F.col("doc_id"), F.col("line_idx"), F.col("text")
    k = (d + 3 * i) % 13
    llx = 72 + F.when(i % 40 >= 25, 250).otherwise(0) + 9 * F.when((d + i) % 4 == 1, 1).otherwise(0)
    lly = 720 - F.when(d % 2 == 0, 26).otherwise(13) * (i % 40 % 25) - 2 * ((i * i + d) % 5)
    cut = lambda n: F.substring(text, 1, n)
    shown = (
        F.when(k == 0, F.concat(F.lit("Table "), i, F.lit(". Values")))
        .when(k == 1, F.concat(F.lit("Figure "), i, F.lit(" shows it")))
        .when(k == 2, F.concat(i, F.lit(".1 Some Heading")))
        .when(k == 3, "RESULTS")
        .when(k == 4, cut(20))
        .when(k == 5, "1.5 2.5 3.5")
        .when(k == 6, F.concat(cut(12), F.lit(":")))
        .when(k == 7, F.concat(F.lit("1 "), cut(30)))
        .when(k == 8, "Methods ..... 12")
        .otherwise(text)
    )
    lines = V.line(spark, sf_dir).select("doc_id", "line_idx", "page", lly.alias("lly"), llx.alias("llx"), shown.alias("text"), k.alias("k"))
    lines = lines.withColumn("ury", F.col("lly") + 10 + F.when(F.col("k") == 2, 3).when(F.col("k") == 7, -1).otherwise(0)).withColumn("urx", F.col("llx") + F.least(5 * F.length("text"), 240 + 8 * (F.col("k") % 3)))
    page = Window.partitionBy("doc_id", "page").orderBy("line_idx")
    rise = F.coalesce(F.col("ury") - F.lead("ury").over(page), F.lit(-1))
    words = F.size(F.array_intersect(F.split(F.lower("text"), "[^a-z]+"), F.array(*map(F.lit, _WORDS))))
    return B.with_spacing(lines.drop("k")).withColumns({"rise": rise, "n_words": words})


_MODE = "LEFT JOIN (SELECT doc_id, {0} AS value FROM set_line WHERE {0} >= 0 GROUP BY doc_id, {0} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(line_idx)) = 1) m_{0} USING (doc_id)"
_FOUND = ("starts_table", "starts_figure", "ends_in_dot", "ends_in_dot_and_number", "ends_in_colon", "is_index_line", "starts_cap", "no_alphabetic")
# a page's columns start at its left edge and 250 further, and are as wide as most lines
V.SQL["flagged"] = rf"""
SELECT *, ({" OR ".join(f"regexp_matches(text, '{B.PATTERNS[n]}')" for n in ("first_level", "second_level", "third_level"))}) AS numbered,
regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AS all_caps, {", ".join(f"regexp_matches(text, '{B.PATTERNS[n]}') AS {n}" for n in _FOUND)},
regexp_matches(text, '[A-Za-z]{{3}}') AS word_form, regexp_matches(text, '^\(?[0-9]{{1,2}}[).]?\s') AS starts_enum, n_words = 0 AS no_words, n_words = 1 AS one_word, usual_n_words > n_words + 2 AS few_words, l IS NULL AS no_column,
coalesce(lag(page) OVER w = page AND (lag(l) OVER w <> l OR lag(r) OVER w <> r), false) AS layout_change, coalesce(llx - l > 5 AND abs((llx - l) - (r - urx)) <= 4, false) AS centered, coalesce(r - urx > 10, false) AS ends_left, coalesce(llx - l > 2 AND llx - l < 30, false) AS tabbed,
coalesce(lag(page) OVER w <> page, false) AS new_page, coalesce(lag(page) OVER w = page AND lly > lag(lly) OVER w AND llx > lag(urx) OVER w, false) AS new_column, coalesce(lly > lag(lly) OVER w, false) AS up, coalesce(lly > lag(lly) OVER w + 20, false) AS up20,
coalesce(lly > lag(lly) OVER w AND llx < lag(llx) OVER w, false) AS up_and_left, coalesce(llx > lag(llx) OVER w, false) AS "right", ury > 642 AS near_top, lly < 100 AS near_bottom, coalesce(height < usual_height, false) AS lower1, coalesce(width > usual_width + 10, false) AS wider10, coalesce(width < usual_width - 20, false) AS narrower20,
coalesce(per_char > usual_per_char + 1, false) AS sparse2, per_char IS NULL AS no_per_char, {", ".join(f"coalesce(distance > usual_distance + {n - 1}, false) AS space{n}" for n in (2, 4, 12, 100))}, {", ".join(f"coalesce(rise > usual_rise + {n - 1}, false) AS rise{n}" for n in (2, 4))}, {", ".join(f"coalesce(height > usual_height + {n - 1}, false) AS taller{n}" for n in (2, 10, 30))}
FROM (SELECT *, CASE WHEN urx <= edge + usual_width + 10 THEN edge END AS l, CASE WHEN urx <= edge + usual_width + 10 THEN edge + usual_width END AS r FROM (
SELECT s.*, CASE WHEN llx >= 322 THEN 322 ELSE 72 END AS edge, {", ".join(f"m_{n}.value AS usual_{n}" for n in _USUAL)} FROM set_line s {" ".join(_MODE.format(n) for n in _USUAL)})) WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with all flags of theirs; a figure is ahead where the line ends early and a gap or the end follows."""
    lines = set_lines(spark, sf_dir)
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).cast("long").alias("value")) for n in _USUAL]))
    counts = lines.select("doc_id", "line_idx", values.alias("v")).select("doc_id", "line_idx", "v.*").filter("value >= 0").groupBy("doc_id", "what", "value").agg(F.struct(F.count("*").alias("n"), (-F.min("line_idx")).alias("first")).alias("rank"))
    usual = counts.groupBy("doc_id").agg(*[F.max_by(F.when(F.col("what") == n, F.col("value")), F.when(F.col("what") == n, F.col("rank"))).alias(f"usual_{n}") for n in _USUAL])
    edge = F.when(F.col("llx") >= 322, 322).otherwise(72)
    stop = edge + F.col("usual_width")
    inside = F.col("urx") <= stop + 10
    lines = BL.with_line_flags(lines.join(usual, "doc_id", "left").withColumns({"left": F.when(inside, edge), "right": F.when(inside, stop)}))
    closing = lambda of: F.max(F.col("ends_left") & F.col("space2")).over(Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(0, of - 1))
    return lines.withColumns({"figure_near": closing(6), "figure_far": closing(15)})


_AHEAD = "SELECT *, " + ", ".join(f"bool_or(ends_left AND space2) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS {c}" for c, n in (("figure_near", 6), ("figure_far", 15)))
V.SQL["ahead"] = f"""
{_AHEAD}, sum(CASE WHEN sparse2 OR no_words OR one_word THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) >= 3 AS table_ahead,
(numbered OR all_caps OR centered OR ends_left) AND NOT ends_in_dot AND NOT no_alphabetic AS titled FROM flagged"""
V.SQL["titles"] = """
SELECT a.doc_id, a.line_idx, coalesce(CASE WHEN a.layout_change THEN true WHEN NOT (a.titled AND a.space2 AND a.rise2) THEN false END, CASE WHEN b.line_idx IS NULL OR b.new_page OR b.new_column THEN false WHEN b.layout_change THEN true WHEN NOT (b.titled AND (b.space2 AND b.rise2 OR a.space4)) THEN false END,
c.line_idx IS NOT NULL AND NOT c.new_page AND NOT c.new_column AND c.layout_change) AS title_ahead FROM ahead a LEFT JOIN ahead b ON a.doc_id = b.doc_id AND b.line_idx = a.line_idx + 1 LEFT JOIN ahead c ON a.doc_id = c.doc_id AND c.line_idx = a.line_idx + 2"""
V.SQL["walked"] = """
SELECT x.*, y.title_ahead, coalesce(p.space2, false) AS p_space2, coalesce(p.space4, false) AS p_space4, coalesce(p.space12, false) AS p_space12, coalesce(p.space100, false) AS p_space100, coalesce(p.rise2, false) AS p_rise2, coalesce(p.rise4, false) AS p_rise4, coalesce(p.no_column, false) AS p_no_column, coalesce(p.ends_left, false) AS p_ends_left, x.no_words AND NOT x.word_form AS formula
FROM ahead x JOIN titles y USING (doc_id, line_idx) LEFT JOIN ahead p ON p.doc_id = x.doc_id AND p.line_idx = x.line_idx - 1"""

# one step for each line: o is the state before it, x the line
_STEPS = (
    ("cut1", "CASE WHEN o.caption = 'table' AND (x.up20 OR x.new_page OR x.p_space2 AND x.p_rise2 AND NOT x.sparse2 AND NOT x.no_per_char AND NOT x.no_words AND NOT x.few_words AND NOT x.lower1 AND NOT (x.ends_left AND NOT x.ends_in_dot)) THEN '' WHEN o.caption = 'figure' AND (x.up20 OR x.new_page OR x.taller10 OR x.p_space2 AND x.p_rise2 AND NOT (x.ends_left AND NOT x.ends_in_dot)) THEN '' ELSE o.caption END"),
    ("is_table", "x.starts_table AND (x.up_and_left OR x.up AND x.table_ahead OR x.up AND NOT x.near_top OR x.\"right\" AND NOT x.near_top OR x.p_space100 AND NOT x.near_top AND NOT x.new_page OR x.p_space2 AND x.table_ahead AND NOT x.new_page)"),
    ("is_figure", "x.starts_figure AND (x.up_and_left OR x.up AND NOT x.near_top OR x.\"right\" AND NOT x.near_top OR x.p_space100 AND NOT x.near_top OR CASE WHEN x.narrower20 THEN x.figure_far ELSE x.figure_near END OR o.caption = 'figure' AND cut1 = '' AND x.narrower20 AND x.p_space12)"),
    ("caption", "CASE WHEN is_figure THEN 'figure' WHEN is_table THEN 'table' ELSE cut1 END"),
    ("said", "CASE WHEN is_figure THEN 'figure-marker-begin' WHEN is_table THEN 'table-marker-begin' WHEN cut1 <> '' THEN cut1 || '-marker-inside' ELSE '' END"),
    ("foot_text", "x.is_index_line OR o.footer AND NOT x.up OR NOT o.footer AND x.p_rise4 AND x.starts_enum AND x.near_bottom AND x.lower1"),
    ("footer", "CASE WHEN x.is_index_line THEN o.footer WHEN o.footer THEN NOT x.up ELSE x.p_rise4 AND x.starts_enum AND x.near_bottom AND x.lower1 END"),
    ("may", "(x.numbered OR x.all_caps OR x.centered OR x.ends_left AND x.starts_cap AND NOT x.tabbed AND NOT x.ends_in_dot_and_number OR o.marker AND x.ends_left) AND (NOT x.no_column OR x.title_ahead) AND (x.space2 AND x.rise2 OR x.p_space4 OR x.taller2 AND x.ends_left) AND (o.marker OR x.new_column OR x.no_column OR x.p_space2 AND x.p_rise2) AND NOT x.wider10"),
    ("section", "(may OR o.marker AND x.space2 AND x.rise2) AND NOT x.no_alphabetic AND x.word_form AND NOT x.ends_in_dot"),
    ("first_said", "CASE WHEN section THEN CASE WHEN x.numbered OR o.marker AND x.p_ends_left AND x.p_space2 AND x.p_rise2 THEN 'section-marker-begin' ELSE 'section-marker-inside' END WHEN x.layout_change THEN 'text' WHEN x.no_column AND (x.line_idx = 0 OR x.new_page OR x.new_column OR x.up_and_left OR x.p_space2 OR x.p_no_column OR x.taller30 OR x.up) THEN 'notext' ELSE 'text' END"),
    ("was", "CASE WHEN foot_text THEN 'notext' WHEN said <> '' THEN said ELSE first_said END"),
    ("par", "was = 'text' OR starts_with(was, 'section') AND NOT x.ends_left AND NOT (x.space2 AND x.rise2)"),
    ("opens", "x.tabbed AND x.starts_cap AND (o.q.formula IS NULL OR o.q.dot) OR x.new_column OR x.new_page OR x.up_and_left OR coalesce(o.q.ends_left AND (o.q.dot OR o.q.dotted), false) OR coalesce(o.q.colon, false) AND x.no_words OR coalesce(o.q.no_words AND o.q.space2 AND o.q.rise2, false) OR o.marker"),
    ("goes", "(x.new_column OR x.new_page OR x.up_and_left) AND (NOT coalesce(o.q.dot, false) OR NOT coalesce(o.q.cap, false) AND NOT coalesce(o.q.ends_left, false) AND NOT x.tabbed)"),
    ("formulas", "coalesce(o.q.formula, false) AND x.formula"),
    ("breaks", "coalesce(o.q.formula AND (o.q.space2 OR o.q.rise2), false) AND NOT x.formula"),
    ("begins", "CASE WHEN opens THEN NOT formulas ELSE breaks OR NOT o.par AND x.line_idx > 0 END"),
    ("number", "o.number + CASE WHEN par AND CASE WHEN opens THEN NOT formulas AND NOT goes ELSE breaks END THEN 1 ELSE 0 END"),
    ("label", "CASE WHEN NOT par THEN was WHEN begins THEN 'paragraph-begin--_--id=' || number ELSE 'paragraph-inside' END"),
    ("marker", "NOT par AND starts_with(was, 'section')"),
)


def _walk() -> str:
    """A recursion whose steps are nested, so that each may use those before it."""
    body = "SELECT o AS o, x AS x FROM walk o JOIN walked x ON x.doc_id = o.doc_id AND x.line_idx = o.line_idx + 1"
    for name, how in _STEPS:
        body = f"SELECT *, {how} AS {name} FROM ({body})"
    seen = "struct_pack(dot := x.ends_in_dot, dotted := x.ends_in_dot_and_number, colon := x.ends_in_colon, cap := x.starts_cap, ends_left := x.ends_left, no_words := x.no_words, space2 := x.space2, rise2 := x.rise2, formula := x.formula)"
    kind = "STRUCT(dot BOOLEAN, dotted BOOLEAN, colon BOOLEAN, cap BOOLEAN, ends_left BOOLEAN, no_words BOOLEAN, space2 BOOLEAN, rise2 BOOLEAN, formula BOOLEAN)"
    names = ("caption", "footer", "marker", "par", "number", "label")
    step = f"SELECT x.doc_id AS doc_id, x.line_idx AS line_idx, {', '.join(f'{n}::{t} AS {n}' for n, t in zip(names, ('VARCHAR', 'BOOLEAN', 'BOOLEAN', 'BOOLEAN', 'BIGINT', 'VARCHAR')))}, CASE WHEN par THEN {seen} ELSE o.q END AS q FROM ({body})"
    start = f"SELECT doc_id, CAST(-1 AS BIGINT) AS line_idx, '' AS caption, false AS footer, false AS marker, false AS par, CAST(0 AS BIGINT) AS number, '' AS label, CAST(NULL AS {kind}) AS q FROM (SELECT DISTINCT doc_id FROM walked)"
    return f"{start} UNION ALL {step}"


@query("body_labels", V.with_sql("line", "set_line", "flagged", "ahead", "titles", then=f", walked AS MATERIALIZED ({V.SQL['walked']}), walk AS ({_walk()}) SELECT doc_id, line_idx, label, CASE WHEN par THEN number END AS paragraph FROM walk WHERE line_idx >= 0").replace("WITH ", "WITH RECURSIVE ", 1))
def body_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of body lines."""
    return BL.body_labels(flagged(spark, sf_dir)).select("doc_id", "line_idx", "label", "paragraph")


@query("titles_ahead", V.with_sql("line", "set_line", "flagged", "ahead", "titles", then="SELECT doc_id, line_idx, title_ahead FROM titles"))
def titles_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that lead to a change of columns."""
    return BL.with_title_ahead(flagged(spark, sf_dir)).select("doc_id", "line_idx", "title_ahead")
