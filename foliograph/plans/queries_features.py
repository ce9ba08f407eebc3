"""Queries over token features, older segmentation, look-ahead, accuracies and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import body as B
from foliograph.operators import evaluation as E
from foliograph.operators import segmentation as S
from foliograph.operators import token_features as TF
from foliograph.operators import tokens as T
from foliograph.plans import queries_layout, steps
from foliograph.plans import views as V
from foliograph.plans.catalog import query

V.SQL["sized"] = "SELECT *, ury - lly AS size FROM line"
V.SQL["fonted"] = """
SELECT s.*, size >= largest - 1 AND size > normal + 1 AS is_largest, size > normal + 1 AS is_large, size < normal - 1 AS is_small FROM sized s JOIN (SELECT doc_id, max(size) AS largest FROM sized GROUP BY doc_id) USING (doc_id)
JOIN (SELECT doc_id, size AS normal FROM sized GROUP BY doc_id, size QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) = 1) USING (doc_id)"""
# a bigger box on some lines, so that fonts differ
_TALL = "SELECT * REPLACE (ury + CASE WHEN line_idx % 6 = 0 AND doc_id % 2 = 0 THEN 4 WHEN line_idx % 5 = 0 THEN 3 WHEN line_idx % 7 = 3 THEN -6 ELSE 0 END AS ury) FROM line0"


def _tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("line_idx"), F.col("doc_id")
    more = F.when((i % 6 == 0) & (d % 2 == 0), 4).when(i % 5 == 0, 3).when(i % 7 == 3, -6).otherwise(0)
    return V.line(spark, sf_dir).withColumn("ury", F.col("ury") + more)


def _over_tall(then: str, *names: str) -> str:
    return "WITH line0 AS (" + V.SQL["line"] + "),\nline AS (" + _TALL + "),\n" + ",\n".join(f"{n} AS ({V.SQL[n]})" for n in names) + "\n" + then


@query(
    "font_features",
    _over_tall(
        """SELECT doc_id, line_idx, concat_ws(',', CASE WHEN is_small THEN 'SMALLFONT' END, CASE WHEN is_large AND has THEN 'LARGEFONT' END, CASE WHEN lg THEN 'LARGESTFONT' END, CASE WHEN lg AND region_size <= 3 THEN 'LARGESTFONT-AND-IN' || region_size || 'LINETEXTREGION' END) AS features
FROM (SELECT *, is_largest OR is_large AND NOT has AS lg, 1 + line_idx % 4 AS region_size FROM (SELECT *, bool_or(is_largest) OVER (PARTITION BY doc_id) AS has FROM fonted))""",
        "sized",
        "fonted",
    ),
)
def font_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font features with promotion and conjunctions."""
    lines = T.with_font_flags(_tall(spark, sf_dir)).withColumn("region_size", 1 + F.col("line_idx") % 4)
    return TF.font_features(lines).select("doc_id", "line_idx", F.array_join("features", ",").alias("features"))


@query("font_changes", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, coalesce(lag(font) OVER w <> font, false) AS font_change, ury - lly >= greatest(max(ury - lly) OVER (PARTITION BY doc_id), 11) AS biggest_font, coalesce(lag(line_idx) OVER w <> line_idx, true) AS line_break FROM token WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)"))
def font_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font change, biggest font and line break."""
    return TF.with_font_changes(V.token(spark, sf_dir), 11).select("doc_id", "tok_idx", "font_change", "biggest_font", "line_break")


@query("predicted_features", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, CASE WHEN tok_idx % 3 = 0 THEN 'PRED1=b,PRED2=a' WHEN tok_idx % 3 = 1 THEN 'PRED1=c' ELSE '' END AS predicted FROM token"))
def predicted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best predictions of each token as features."""
    tokens = V.token(spark, sf_dir).select("doc_id", "tok_idx")
    one = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
    some = F.when(F.col("tok_idx") % 3 == 0, F.array(one("a", 0.5), one("b", 0.6), one("c", 0.5))).when(F.col("tok_idx") % 3 == 1, F.array(one("c", 0.1)))
    found = TF.with_predictions(tokens, tokens.select("doc_id", "tok_idx", F.inline(some)), 2)
    return found.select("doc_id", "tok_idx", F.array_join("predicted", ",").alias("predicted"))


@query("word_features", "SELECT item_id AS doc_id, CAST(i - 1 AS BIGINT) AS tok_idx, ws[i] AS token, text AS source, ws[i] AS features FROM (SELECT item_id, text, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM benchmark)")
def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an array as feature tokens, and what they came from."""
    items = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.split("text", " ").alias("words"))
    return TF.as_features(items, "words").withColumn("features", F.array_join("features", ","))


@query("featured_documents", V.with_sql("line", "token", then="SELECT doc_id, coalesce(bool_or(regexp_matches(token, '^[A-Z]+$')), false) AS \"any\" FROM token GROUP BY doc_id"))
def featured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which any token has features."""
    return TF.any_features(V.token(spark, sf_dir).withColumn("features", F.array_compact(F.array(F.when(F.col("token").rlike("^[A-Z]+$"), "ALLCAPS")))))


V.SQL["older"] = r"""
SELECT m.doc_id, header_stop, is_lenient, body_stop, CASE WHEN header_stop IS NULL THEN 'introduction not found' WHEN body_stop IS NULL THEN 'references not found' END AS error FROM (
SELECT doc_id, coalesce(st, le) AS header_stop, st IS NULL AND le IS NOT NULL AS is_lenient FROM (SELECT doc_id, min(line_idx) FILTER (lower(ltrim(text)) LIKE 'introduction%' OR lower(ltrim(text)) LIKE 'background%' OR (rtrim(split_part(ltrim(upper(text)), ' ', 1), '.') IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') OR split_part(ltrim(upper(text)), ' ', 1) LIKE '_.0' AND left(ltrim(upper(text)), 1) BETWEEN '0' AND '9' OR rtrim(split_part(ltrim(upper(text)), ' ', 1), '.') <> '' AND replace(rtrim(split_part(ltrim(upper(text)), ' ', 1), '.'), 'I', '') = '') AND (lower(ltrim(substr(ltrim(text), strpos(ltrim(text) || ' ', ' ')))) LIKE 'introduction%' OR lower(ltrim(substr(ltrim(text), strpos(ltrim(text) || ' ', ' ')))) LIKE 'background%')) AS st, min(line_idx) FILTER ((rtrim(split_part(ltrim(text), ' ', 1), '.') IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') OR split_part(ltrim(text), ' ', 1) LIKE '_.0' AND left(ltrim(text), 1) BETWEEN '0' AND '9' OR rtrim(split_part(ltrim(text), ' ', 1), '.') <> '' AND replace(rtrim(split_part(ltrim(text), ' ', 1), '.'), 'I', '') = '') AND regexp_matches(ltrim(substr(ltrim(text), strpos(ltrim(text) || ' ', ' '))), '^[A-Z][a-z]')) AS le FROM paper GROUP BY doc_id)) m
LEFT JOIN LATERAL (SELECT min(line_idx) AS body_stop FROM paper p WHERE p.doc_id = m.doc_id AND p.line_idx >= m.header_stop AND (trim(p.text) LIKE '%References' OR trim(p.text) LIKE '%REFERENCES' OR trim(p.text) LIKE '%Bibliography' OR trim(p.text) LIKE '%BIBLIOGRAPHY')) ON true"""


@query("older_sections", V.with_sql("line", "paper", "older", then="SELECT * FROM older"))
def older_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and body by strict and lenient headings."""
    return S.older_sections(queries_layout._papers(spark, sf_dir))


@query(
    "abstract_lines",
    V.with_sql("line", "paper", then="SELECT p.doc_id, p.line_idx FROM paper p JOIN (SELECT s.doc_id, a, min(q.line_idx) AS b FROM (SELECT doc_id, min(line_idx) AS a FROM paper WHERE text = 'Abstract' GROUP BY doc_id) s JOIN paper q ON q.doc_id = s.doc_id AND q.line_idx > a AND q.line_idx <= a + 20 AND q.text = '1. Introduction' GROUP BY s.doc_id, a) r ON p.doc_id = r.doc_id AND p.line_idx >= a AND p.line_idx < b"),
)
def abstract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from one heading to another (G1)."""
    return S.matching_lines(queries_layout._papers(spark, sf_dir), "^Abstract$", "^1[.] Introduction$", 20).select("doc_id", "line_idx")


V.SQL["tagged"] = "SELECT *, CASE WHEN line_idx < doc_id % 3 THEN 'biblioPrologue' WHEN doc_id % 2 = 0 AND line_idx = 15 THEN 'post' WHEN line_idx % 11 > 3 + doc_id % 4 THEN 'junk' WHEN line_idx % 4 = 1 THEN 'biblio-B' ELSE 'biblio-I' END AS label FROM line"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("line_idx"), F.col("doc_id")
    label = F.when(i < d % 3, "biblioPrologue").when((d % 2 == 0) & (i == 15), "post").when(i % 11 > 3 + d % 4, "junk").when(i % 4 == 1, "biblio-B").otherwise("biblio-I")
    return V.line(spark, sf_dir).withColumn("label", label)


@query(
    "bibliography_parts",
    V.with_sql("line", "tagged", then="SELECT doc_id, line_idx, part, CASE WHEN part = 'reference' THEN n END AS ref_no FROM (SELECT *, CASE WHEN af THEN 'epilogue' WHEN label = 'biblioPrologue' THEN 'prologue' WHEN label IN ('biblio-B', 'biblio-I') AND n > 0 THEN 'reference' END AS part FROM (SELECT *, CAST(sum(CASE WHEN label = 'biblio-B' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n, bool_or(label = 'post') OVER w AS af FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx))) WHERE part IS NOT NULL"),
)
def bibliography_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prologue, references and epilogue."""
    return S.bibliography_parts(_tagged(spark, sf_dir)).select("doc_id", "line_idx", "part", "ref_no")


@query(
    "reference_statistics",
    V.with_sql(
        "line",
        "tagged",
        then="""SELECT doc_id, ref_no, coalesce(min(step) <> max(step), false) AS mixed, max(junk) > 5 AS much_junk, CAST(sum(moved) AS BIGINT) AS margin_changes FROM (SELECT *, count(*) FILTER (label = 'junk') OVER (PARTITION BY doc_id, ref_no, run) AS junk FROM (
SELECT *, CASE WHEN label = 'biblio-I' THEN sign(llx - first_value(llx) OVER r) END AS step, CASE WHEN label <> 'junk' AND lag(llx) OVER r <> llx THEN 1 ELSE 0 END AS moved, sum(CASE WHEN label <> 'junk' THEN 1 ELSE 0 END) OVER r AS run FROM (
SELECT *, CAST(sum(CASE WHEN label = 'biblio-B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS BIGINT) AS ref_no FROM tagged) WHERE ref_no > 0 WINDOW r AS (PARTITION BY doc_id, ref_no ORDER BY line_idx))) GROUP BY doc_id, ref_no""",
    ),
)
def reference_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious references."""
    return S.reference_statistics(_tagged(spark, sf_dir))


@query("cut_references", V.with_sql("line", then="SELECT doc_id, ref_no, count(*) AS n_lines, min(line_idx) AS first_line FROM (SELECT *, CAST(sum(CASE WHEN llx = 72 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS BIGINT) AS ref_no FROM line) WHERE ref_no > 0 GROUP BY ALL"))
def cut_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References cut at hints."""
    return S.cut_at(V.line(spark, sf_dir), F.col("llx") == 72).groupBy("doc_id", "ref_no").agg(F.count("*").alias("n_lines"), F.min("line_idx").alias("first_line"))


@query("oversized_headers", V.with_sql("line", "paper", "older", then="SELECT p.doc_id, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM paper p JOIN older o ON p.doc_id = o.doc_id AND p.line_idx < o.header_stop GROUP BY p.doc_id HAVING sum(length(text) + 1) > 150"))
def oversized_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that are too long."""
    lines = queries_layout._papers(spark, sf_dir)
    return S.oversized_headers(lines, S.older_sections(lines), 150)


@query("body_numbers", V.with_sql("line", then="SELECT doc_id, line_idx, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS body_idx FROM line WHERE line_idx % 40 NOT IN (0, 39)"))
def body_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered without headers and footers."""
    return B.numbered_without(V.line(spark, sf_dir).withColumn("furniture", (F.col("line_idx") % 40).isin(0, 39)), "furniture").select("doc_id", "line_idx", "body_idx")


@query(
    "figures_ahead",
    V.with_sql(
        "line",
        then="""SELECT doc_id, line_idx, ends_left AND (last OR breaks) OR coalesce(first_value(decided IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS figure_ahead FROM (SELECT *, CASE WHEN NOT shorter AND NOT last AND breaks THEN false WHEN same_left AND shorter AND (last OR breaks) THEN true END AS decided FROM (
SELECT *, lead(line_idx) OVER w IS NULL AS last, coalesce(lead(up) OVER w OR lead(rgt) OVER w, false) OR more_space AS breaks FROM (SELECT *, urx < 200 AS ends_left, coalesce(urx < lag(urx) OVER w, false) AS shorter, coalesce(llx = lag(llx) OVER w, false) AS same_left, (ury - lly) % 3 = 0 AS more_space, coalesce(lly > lag(lly) OVER w, false) AS up, coalesce(llx > lag(llx) OVER w + 9, false) AS rgt
FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)) WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)))""",
    ),
)
def figures_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that end in the lines ahead."""
    back = lambda c: F.lag(c).over(Window.partitionBy("doc_id").orderBy("line_idx"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    lines = V.line(spark, sf_dir)
    flags = {"ends_left": F.col("urx") < 200, "shorter": flag(F.col("urx") < back("urx")), "same_left": flag(F.col("llx") == back("llx")), "more_space": (F.col("ury") - F.col("lly")) % 3 == 0, "up": flag(F.col("lly") > back("lly")), "right": flag(F.col("llx") > back("llx") + 9)}
    return B.figure_ahead(lines.withColumns(flags)).select("doc_id", "line_idx", "figure_ahead")


@query("ordered_lines", V.with_sql("line", then="SELECT doc_id, line_idx, coalesce(lower(substr(text, 1, 2)) >= max(lower(substr(text, 1, 2))) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), true) AS in_order FROM line"))
def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin no earlier in the alphabet than the twenty before."""
    return B.above_before(V.line(spark, sf_dir), F.lower(F.substring("text", 1, 2))).select("doc_id", "line_idx", "in_order")


@query("label_accuracy", V.with_sql("judged", then="SELECT *, round(n_right / n_tokens, 9) AS token_accuracy, round(n_whole / n_instances, 9) AS instance_accuracy FROM (SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(hit) AS BIGINT) AS n_right, count(*) AS n_instances, count(*) FILTER (n = hit) AS n_whole FROM (SELECT doc_id % 40 AS instance, count(*) AS n, count(*) FILTER (truth = predicted) AS hit FROM judged GROUP BY 1))"))
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and whole-instance accuracy (M8)."""
    found = E.accuracies(queries_layout._judged(spark, sf_dir).withColumn("instance", F.col("doc_id") % 40), "instance")
    return found.withColumns({c: F.round(c, 9) for c in ("token_accuracy", "instance_accuracy")})


@query("prediction_differences", V.with_sql("judged", then="SELECT doc_id, truth, predicted FROM judged j WHERE EXISTS (SELECT 1 FROM judged k WHERE k.source = j.source AND k.doc_id % 9 = j.doc_id % 9 AND k.truth <> k.predicted)"))
def prediction_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the instances that are not all right."""
    rows = queries_layout._judged(spark, sf_dir).withColumn("instance", F.concat_ws(":", "source", F.col("doc_id") % 9))
    return E.differing(rows, "instance").select("doc_id", "truth", "predicted")


@query("token_lines", V.with_sql("line", "token", then="SELECT *, coalesce(lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) <> page, false) AS is_page_break FROM (SELECT doc_id, line_no, min(tok_idx) AS first_token, max(tok_idx) AS last_token, arg_min(llx, tok_idx) AS llx, arg_min(lly, tok_idx) AS lly, arg_min(page, tok_idx) AS page, string_agg(token, ' ' ORDER BY tok_idx) AS text FROM (SELECT *, CAST(sum(CASE WHEN pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS BIGINT) AS line_no FROM token) GROUP BY doc_id, line_no)"))
def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a token run with page boundaries."""
    return T.text_lines(V.token(spark, sf_dir).withColumn("newline", F.col("pos") == 0))


@query("repaired_diacritics", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ó \"x\" ü' WHEN 1 THEN 'è' ELSE 'q´ plain' END || doc_id || ' ' || regexp_replace(text, '[^A-Za-z ]', '', 'g') AS text FROM documents")
def repaired_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone diacritics joined to their letters (T5)."""
    broken = F.when(F.col("doc_id") % 5 == 0, 'o´ ``x"  u¨'.replace("  ", " ")).when(F.col("doc_id") % 5 == 1, "e`").otherwise("q´ plain")
    return V.table(spark, sf_dir, "documents").select("doc_id", T.repaired_diacritics(F.concat(broken, "doc_id", F.lit(" "), F.regexp_replace("text", "[^A-Za-z ]", ""))).alias("text"))


@query("harvested_papers", V.with_sql("author", then="SELECT doc_id, author FROM (SELECT doc_id, nation AS author, row_number() OVER (PARTITION BY nation ORDER BY doc_id) AS n FROM (SELECT DISTINCT doc_id, nation FROM author) WHERE doc_id % 4 <> 1) WHERE n <= 3"))
def harvested_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three papers of an author, without long abstracts."""
    papers = V.author(spark, sf_dir).select("doc_id", F.col("nation").alias("author")).distinct().withColumn("abstract", F.when(F.col("doc_id") % 4 == 1, F.repeat(F.lit("x"), 1001)).otherwise("short"))
    return T.harvested(papers, 3, 1000).select("doc_id", "author")


@query("phantom_tokens", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, CASE WHEN doc_id % 2 = 0 AND tok_idx = 3 THEN token || 'tail' ELSE token END AS token, false AS phantom FROM token WHERE NOT (doc_id % 2 = 0 AND tok_idx = 4) UNION ALL SELECT doc_id, tok_idx, '' AS token, true FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line_idx) AS n FROM token) WHERE doc_id % 2 = 0 AND tok_idx = 4 AND n = 1"))
def phantom_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined words and the phantoms of their rests."""
    tokens = V.token(spark, sf_dir)
    joined = tokens.filter("doc_id % 2 = 0 and tok_idx = 3").select("doc_id", "tok_idx", F.lit(True).alias("joined"), F.concat("token", F.lit("tail")).alias("word"))
    return T.with_phantoms(tokens, joined).select("doc_id", "tok_idx", "token", "phantom")


@query("document_steps", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'abort' WHEN lang <> 'en' THEN 'warning' ELSE 'ok' END AS status, concat_ws('; ', CASE WHEN n_chars > 5000 THEN 'too long' END, CASE WHEN n_chars <= 5000 AND lang <> 'en' THEN 'other language' END) AS messages, CASE WHEN n_chars > 5000 THEN 'error' ELSE 'standard' END AS branch, true AS closed FROM documents")
def document_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through standard, error and epilogue steps (§2.13)."""
    found = steps.run(
        V.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"),
        [lambda d: steps.failed(d, F.col("n_chars") > 5000, "too long"), lambda d: steps.warned(d, F.col("lang") != "en", "other language"), lambda d: d.withColumn("branch", F.lit("standard"))],
        [lambda d: d.withColumn("branch", F.lit("error"))],
        [lambda d: d.withColumn("closed", F.lit(True))],
    )
    return found.select("doc_id", "status", F.array_join("messages", "; ").alias("messages"), "branch", "closed")


V.SQL["worded"] = r"SELECT item_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark"
V.SQL["lexicon"] = """
SELECT 'BENCHMARK' AS name, unnest(ws) AS entry, true AS ignore_case FROM worded UNION SELECT 'START', ws[1], false FROM worded UNION SELECT 'PAIR', array_to_string(ws[1:2], ' '), true FROM worded WHERE len(ws) > 1
UNION SELECT 'LINESTART', token, false FROM token WHERE pos = 0 AND line_idx = 0 UNION SELECT 'TRIPLE', array_to_string(ws[2:4], ' '), false FROM worded WHERE len(ws) > 3"""


@query(
    "lexicon_names",
    V.with_sql(
        "line",
        "token",
        "worded",
        "lexicon",
        then="""SELECT t.doc_id, t.tok_idx, coalesce(names, '') AS names FROM token t LEFT JOIN (SELECT doc_id, place AS tok_idx, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (
SELECT doc_id, unnest(range(tok_idx, tok_idx + n)) AS place, name FROM (SELECT doc_id, tok_idx, 1 AS n, token AS text FROM token
UNION ALL SELECT doc_id, tok_idx, 2, token || ' ' || lead(token) OVER w FROM token WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)
UNION ALL SELECT doc_id, tok_idx, 3, token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w FROM token WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)) r
JOIN lexicon l ON lower(r.text) = lower(l.entry) AND (ignore_case OR r.text = l.entry)) GROUP BY doc_id, place) f ON t.doc_id = f.doc_id AND t.tok_idx = f.tok_idx""",
    ),
)
def lexicon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lexicons of words and phrases at once."""
    tokens = V.token(spark, sf_dir)
    items = V.table(spark, sf_dir, "benchmark").select(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("ws"))
    named = lambda rows, name, entry, ignore_case: rows.select(F.lit(name).alias("name"), entry.alias("entry"), F.lit(ignore_case).alias("ignore_case"))
    some = lambda first, n: F.array_join(F.slice("ws", first, n), " ")
    lexicons = (
        named(items, "BENCHMARK", F.explode("ws"), True)
        .union(named(items, "START", F.get("ws", F.lit(0)), False))
        .union(named(items.filter(F.size("ws") > 1), "PAIR", some(1, 2), True))
        .union(named(items.filter(F.size("ws") > 3), "TRIPLE", some(2, 3), False))
        .union(named(tokens.filter("pos = 0 and line_idx = 0"), "LINESTART", F.col("token"), False))
    )
    return TF.lexicon_names(tokens, lexicons, 3).select("doc_id", "tok_idx", F.array_join("lexicons", ",").alias("names"))
