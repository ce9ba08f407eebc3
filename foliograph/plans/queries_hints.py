"""Queries over hints of references, on bibliographies set from orders: indented, bracketed, spaced or sorted by name, in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import ignored_lines as I
from foliograph.operators import line_features as L
from foliograph.operators import reference_hints as H
from foliograph.operators import segmentation as S
from foliograph.plans import views as V
from foliograph.plans.catalog import query

V.SQL["entry_line"] = """
SELECT doc_id, line_idx, line_idx // 40 AS page, 72 + CASE WHEN doc_id % 4 IN (0, 3) AND k > 0 THEN 18 + doc_id % 3 ELSE 0 END AS llx, 720 - CAST(sum(CASE WHEN line_idx % 40 = 0 THEN 0 ELSE gap END) OVER (PARTITION BY doc_id, line_idx // 40 ORDER BY line_idx) AS BIGINT) AS lly, text FROM (
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, ref_no, k) - 1 AS line_idx, k, 12 + CASE WHEN k = 0 AND doc_id % 4 = 2 THEN 7 WHEN k = 9 THEN 40 ELSE 0 END AS gap,
CASE WHEN k = 9 THEN 'Notes of the editors on all that stands above' WHEN k > 0 THEN 'of the work on ' || ref_id || ' and what came of it ' || k ELSE CASE WHEN doc_id % 4 = 1 THEN '[' || ref_no || '] ' ELSE '' END || last1 || ', A. and ' || last2 || ', B. The study ' || year END AS text
FROM (SELECT *, CASE WHEN doc_id % 4 = 3 THEN last1 ELSE '' END AS place, unnest(CASE WHEN doc_id % 5 = 0 AND ref_no = max(ref_no) OVER (PARTITION BY doc_id) AND doc_id % 4 < 3 THEN [0, 1, 9] WHEN ref_no % 3 = 0 THEN [0, 1, 2] WHEN ref_no % 3 = 1 THEN [0, 1] ELSE [0] END) AS k FROM reference))"""


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n, k = F.col("doc_id"), F.col("ref_no"), F.col("k")
    numbers = lambda *x: F.array(*map(F.lit, x))
    last = n == F.max("ref_no").over(Window.partitionBy("doc_id"))
    ks = F.when((d % 5 == 0) & last & (d % 4 < 3), numbers(0, 1, 9)).when(n % 3 == 0, numbers(0, 1, 2)).when(n % 3 == 1, numbers(0, 1)).otherwise(numbers(0))
    place = F.when(d % 4 == 3, F.col("last1")).otherwise("")
    rows = V.reference(spark, sf_dir).withColumn("ks", ks).withColumn("place", place).withColumn("k", F.explode("ks"))
    begin = F.concat(F.when(d % 4 == 1, F.concat(F.lit("["), n, F.lit("] "))).otherwise(""), "last1", F.lit(", A. and "), "last2", F.lit(", B. The study "), "year")
    text = F.when(k == 9, "Notes of the editors on all that stands above").when(k > 0, F.concat(F.lit("of the work on "), "ref_id", F.lit(" and what came of it "), k)).otherwise(begin)
    at = (F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "ref_no", "k")) - 1).cast("long")
    gap = 12 + F.when((k == 0) & (d % 4 == 2), 7).when(k == 9, 40).otherwise(0)
    rows = rows.select("doc_id", at.alias("line_idx"), "k", gap.alias("gap"), text.alias("text")).withColumn("page", F.floor(F.col("line_idx") / 40))
    down = F.sum(F.when(F.col("line_idx") % 40 == 0, 0).otherwise(F.col("gap"))).over(Window.partitionBy("doc_id", "page").orderBy("line_idx"))
    return rows.select("doc_id", "line_idx", "page", (72 + F.when((d % 4).isin(0, 3) & (k > 0), 18 + d % 3).otherwise(0)).alias("llx"), (720 - down).alias("lly"), "text")


V.SQL["gap"] = "SELECT *, CAST(lag(lly) OVER w - lly AS DOUBLE) AS gap, CAST(lly - lead(lly) OVER w AS DOUBLE) AS ahead, max(line_idx) OVER (PARTITION BY doc_id) AS last FROM entry_line WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)"
# the gaps of a document one after the other: smallest, largest, whether they part references
_OUT = "(CASE WHEN {0} = 0 THEN {1} > 0 ELSE ({1} - {0}) / {0} >= 0.15 END)"
V.SQL["kinds"] = """
SELECT doc_id, least, most, varied FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM seek) WHERE r = 1"""
_SEEK = f"""SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS least, CAST(0 AS DOUBLE) AS most, false AS varied FROM entry_line
UNION ALL SELECT doc_id, n, least, CASE WHEN same THEN greatest(g, most) WHEN g > most AND NOT {_OUT.format("least", "most")} THEN g ELSE most END, CASE WHEN same THEN {_OUT.format("least", "greatest(g, most)")} ELSE g > most AND {_OUT.format("least", "most")} END
FROM (SELECT s.doc_id, x.n, least(s.least, x.gap) AS least, s.most, x.gap AS g, s.most > 0 AND abs(x.gap - s.most) / s.most <= 0.09 AS same FROM seek s JOIN first_gap x ON x.doc_id = s.doc_id AND x.n = s.n + 1 WHERE NOT s.varied)"""
_MARKED = """SELECT *, CASE WHEN line_idx = 0 THEN CASE WHEN varied THEN 'begins' END WHEN gap < 0 AND NOT fits THEN 'ends' WHEN gap < 0 AND NOT varied THEN NULL
WHEN varied AND (seen > most AND (seen - (most + 2)) / most <= 0.09 OR seen <= most AND most - seen < seen - least) THEN 'begins' WHEN varied AND seen > most OR NOT varied AND (seen - (least + 2)) / least >= 0.15 THEN 'ends' END AS kind FROM (
SELECT *, CASE WHEN gap < 0 AND varied THEN most ELSE gap END AS seen, coalesce((abs(ahead - least) - 2) / least < 0.09, false) OR coalesce((abs(ahead - most) - 2) / most < 0.09, false) OR coalesce(ahead BETWEEN least AND most, false) AS fits FROM gap JOIN kinds USING (doc_id))"""
V.SQL["gap_hint"] = """
SELECT doc_id, line_idx, false AS ends FROM marked JOIN (SELECT doc_id, coalesce(min(CASE WHEN kind = 'ends' THEN line_idx END), max(last) + 1) AS stop FROM marked GROUP BY doc_id) USING (doc_id) WHERE kind = 'begins' AND line_idx < stop
UNION ALL SELECT doc_id, coalesce(min(CASE WHEN kind = 'ends' THEN line_idx END), max(last) + 1), true FROM marked GROUP BY doc_id"""
_FIRST = "SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS n FROM gap WHERE line_idx < 23 AND gap >= 0"
_GAPS = f"WITH RECURSIVE reference AS ({V.SQL['reference']}), entry_line AS MATERIALIZED ({V.SQL['entry_line']}), gap AS MATERIALIZED ({V.SQL['gap']}), first_gap AS MATERIALIZED ({_FIRST}), seek AS ({_SEEK}), kinds AS ({V.SQL['kinds']}), marked AS MATERIALIZED ({_MARKED})"


@query("gap_kinds", f"{_GAPS} SELECT doc_id, least, most, varied FROM kinds")
def gap_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between lines and between references."""
    return H.gap_kinds(entry_lines(spark, sf_dir))


@query("gap_hints", f"{_GAPS} {V.SQL['gap_hint']}")
def gap_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by gaps."""
    return H.gap_hints(entry_lines(spark, sf_dir))


# the run that ends at each line, in turn: its length and the line before; then back from the longest
_RISE = r"""WITH RECURSIVE reference AS ({reference}), entry_line AS MATERIALIZED ({entry_line}),
word AS (SELECT *, CASE WHEN w[1] IN ('van', 'von', 'de') THEN upper(w[1][1]) || substr(w[1], 2) ELSE w[1] END AS word FROM (SELECT doc_id, line_idx, text, regexp_split_to_array(trim(regexp_replace(text, '\s', ' ', 'g')), ' +') AS w FROM entry_line)),
able AS MATERIALIZED (SELECT doc_id, line_idx, word, len(w) >= 5 AND regexp_matches(word, '^\p{{Lu}}') AND (ends_with(word, ',') OR coalesce(w[2] IN (',', 'et', 'ET', 'et.', 'ET.', 'and', 'AND'), false) OR regexp_matches(text, '(19|20)[0-9]{{2}}')) AS able FROM word),
named AS MATERIALIZED (SELECT doc_id, list(CASE WHEN length(word) >= 3 THEN substr(word, 1, 2) ELSE word END ORDER BY line_idx) AS pre FROM able WHERE doc_id IN (SELECT doc_id FROM entry_line WHERE line_idx = 0 AND regexp_matches(text, '^\p{{Lu}}(\p{{L}}.|.\p{{L}})')) GROUP BY doc_id),
run AS (SELECT doc_id, CAST(-1 AS BIGINT) AS line_idx, CAST([] AS BIGINT[]) AS n, CAST([] AS BIGINT[]) AS came FROM named
UNION ALL SELECT doc_id, line_idx, list_append(n, CASE WHEN able THEN coalesce(best // 1000000, 0) + 1 ELSE 0 END), list_append(came, CASE WHEN able THEN coalesce(999999 - best % 1000000, -1) ELSE -1 END) FROM (
SELECT r.doc_id, a.line_idx, r.n, r.came, a.able, list_max([r.n[i + 1] * 1000000 + 999999 - i for i in range(greatest(0, a.line_idx - 20), a.line_idx) if r.n[i + 1] > 0 and p.pre[i + 1] <= a.word]) AS best FROM run r JOIN able a ON a.doc_id = r.doc_id AND a.line_idx = r.line_idx + 1 JOIN named p ON p.doc_id = r.doc_id)),
whole AS MATERIALIZED (SELECT doc_id, n, came FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_idx DESC) = 1),
back AS (SELECT doc_id, list_position(n, list_max(n)) - 1 AS line_idx, came FROM whole WHERE list_max(n) > 0 UNION ALL SELECT doc_id, came[line_idx + 1], came FROM back WHERE came[line_idx + 1] >= 0)
SELECT doc_id, CAST(line_idx AS BIGINT) AS line_idx, false AS ends FROM back""".format(reference=V.SQL["reference"], entry_line=V.SQL["entry_line"])


@query("alphabet_hints", _RISE)
def alphabet_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the order of names."""
    return H.alphabet_hints(entry_lines(spark, sf_dir))


@query("indent_hints")
def indent_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by indents."""
    return H.indent_hints(entry_lines(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = entry_lines(spark, sf_dir)
    return H.fused(H.all_hints(lines, S.reference_starts(lines)))


@query("fused_hints")
def fused_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hints that count for each bibliography."""
    return _fused(spark, sf_dir)


@query("fused_references")
def fused_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographies cut at the hints that count."""
    return H.parted(entry_lines(spark, sf_dir), _fused(spark, sf_dir)).select("doc_id", "line_idx", "part", "ref_no")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographies under a title, with boxes as wide as their text."""
    lines = entry_lines(spark, sf_dir)
    title = lines.filter("line_idx = 0").withColumns({"line_idx": F.lit(-1).cast("long"), "text": F.lit("References"), "lly": F.col("lly") + 30, "llx": F.lit(72).cast("long")})
    rows = lines.unionByName(title).withColumn("line_idx", F.col("line_idx") + 1)
    return rows.withColumns({"urx": F.col("llx") + 5 * F.length("text"), "ury": F.col("lly") + 10, "font": F.lit(1)})


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_ignored(L.with_layout_features_v2(L.with_lexical_features_v2(_listed(spark, sf_dir))))


@query("page_margins")
def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second indents of each page's columns."""
    found = I.page_margins(_listed(spark, sf_dir))
    return found.select("doc_id", "page", "left", "right", "bottom", "height", F.posexplode_outer("margins").alias("side", "m")).select("doc_id", "page", "left", "right", "bottom", "height", "side", F.col("m.left").alias("first_left"), F.col("m.right").alias("first_right"), F.col("m.left2").alias("second_left"), F.col("m.right2").alias("second_right"))


@query("ignored_lines")
def ignored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to ignore and possible beginnings of references."""
    return _walked(spark, sf_dir).select("doc_id", "line_idx", "ignored", "possible_init")


@query("ruled_references")
def ruled_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by rule, from what is ignored and what may begin one."""
    return S.references(S.rule_labels(_walked(spark, sf_dir))).select("doc_id", "ref_no", "first_line", "last_line", F.sha1(F.col("text").cast("binary")).alias("sha"))
