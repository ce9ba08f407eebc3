"""Queries that write a table in one of the text formats, read it again and sum up what came back; author strings and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import body as B
from foliograph.operators import linking as L
from foliograph.operators import markup as M
from foliograph.operators import segmentation as S
from foliograph.plans import queries_layout, queries_streaming
from foliograph.plans import views as V
from foliograph.plans.catalog import query
from foliograph.sources import readers as R
from foliograph.sources import writers as W


def _saved(spark: SparkSession, rows: DataFrame, key: str, *order: str) -> str:
    """The column ``value`` as text files in the shared folder: the rows of a key are together and in order."""
    path = queries_streaming._folder(spark)
    rows.repartition(key).sortWithinPartitions(key, *order).select("value").write.text(path)
    return path


@query("labelled_line_files", V.with_sql("line", "labelled", then="SELECT label, page, new_ref, count(*) AS n, CAST(sum(llx) AS BIGINT) AS llx, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM labelled GROUP BY label, page, new_ref"))
def labelled_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines written as records and read again."""
    lines = queries_layout._labelled(spark, sf_dir)
    record = F.concat(F.regexp_replace("text", r"[\r\n]", " "), F.lit("@"), F.concat_ws(",", "page", "llx", "lly", "urx", "ury", "font", F.lit("false"), "new_ref", "label"))
    ends = lines.select("doc_id").distinct().select("doc_id", F.lit(1 << 40).alias("line_idx"), F.lit("").alias("value"))
    path = _saved(spark, lines.select("doc_id", "line_idx", record.alias("value")).unionByName(ends), "doc_id", "line_idx")
    return R.labelled_lines(spark, path).groupBy("label", F.col("page").cast("long").alias("page"), "new_ref").agg(F.count("*").alias("n"), F.sum("llx").alias("llx"), F.sum(F.length("text")).alias("n_chars"))


@query("feature_line_files", "SELECT event_type AS label, count(*) AS n, CAST(sum(1 + user_id % 3) AS BIGINT) AS n_features FROM events GROUP BY event_type")
def feature_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature lines written and read again."""
    events = V.table(spark, sf_dir, "events")
    value = F.concat(F.array_join(F.array_repeat(F.lit("f"), (1 + F.col("user_id") % 3).cast("int")), " "), F.lit(" "), "event_type")
    path = _saved(spark, events.select("user_id", "event_id", value.alias("value")), "user_id", "event_id")
    return R.feature_lines(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("features")).alias("n_features"))


@query("record_files", "SELECT item_id % 5 AS k, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM benchmark GROUP BY 1")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records between separators written and read again."""
    value = F.concat((F.col("item_id") % 5).cast("string"), F.lit(" "), F.col("text"), F.lit("<NEWREFERENCE>"))
    path = _saved(spark, V.table(spark, sf_dir, "benchmark").select("item_id", value.alias("value")), "item_id")
    back = R.records(spark, path, "<NEWREFERENCE>")
    return back.groupBy(F.substring_index("text", " ", 1).cast("long").alias("k")).agg(F.count("*").alias("n"), F.sum(F.length("text") - 2).alias("n_chars"))


@query("dictionary_files", "SELECT 'n' || n_nationkey || '.edu' AS domain, n_name AS name, 'Earth ' || n_regionkey AS address FROM nation WHERE n_nationkey % 5 <> 2")
def dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An institution dictionary written and read again."""
    n = F.col("n_nationkey")
    domain = F.concat(F.when(n % 2 == 0, "www.").otherwise(""), F.lit("n"), n, F.lit(".edu"))
    value = F.when(n % 5 == 2, F.concat(F.lit("# "), domain)).otherwise(F.concat_ws(";;", domain, "n_name", F.concat(F.lit("Earth "), "n_regionkey")))
    return R.institutions(spark, _saved(spark, V.table(spark, sf_dir, "nation").select(n, value.alias("value")), "n_nationkey"))


@query("truth_files", V.with_sql("author", then="SELECT 'p' || doc_id AS filename, doc_id % 2 = 0 AS applicable, last || ', ' || first AS author, lower(last) || '@x.edu' AS email, 'Inst, ' || nation AS institute FROM author"))
def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth file of authors written and read again."""
    a = V.author(spark, sf_dir)
    triple = F.concat_ws(",", F.concat("last", F.lit("; "), "first"), F.concat(F.lower("last"), F.lit("@x.edu")), F.concat(F.lit("Inst; "), "nation"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("author_id", triple.alias("t")))), lambda x: x["t"]), ",")
    lines = a.groupBy("doc_id").agg(cells.alias("cells")).select((F.col("doc_id") % 4).alias("part"), "doc_id", F.concat_ws(",", F.concat(F.lit("p"), "doc_id"), (F.col("doc_id") % 2 == 0).cast("string"), "cells").alias("value"))
    heads = spark.range(4).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("doc_id"), F.lit("Filename,applicable").alias("value"))
    return R.truth(spark, _saved(spark, lines.unionByName(heads), "part", "doc_id"))


@query("sidecar_files", 'SELECT c_mktsegment AS "key", count(*) AS n, min(c_name) AS first FROM customer GROUP BY c_mktsegment')
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value lines written and read again."""
    lines = V.table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" = "), "c_name").alias("value"))
    return R.sidecar(spark, _saved(spark, lines, "c_custkey")).groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("first"))


_BIO = "SELECT doc_id, tok_idx, token, CASE WHEN tok_idx % 10 < 4 THEN 'title' ELSE 'O' END AS label FROM token"


def _labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.token(spark, sf_dir).select("doc_id", "tok_idx", "token", F.when(F.col("tok_idx") % 10 < 4, "title").otherwise("O").alias("label"))


@query("word_lines", V.with_sql("line", "token", then=f"SELECT doc_id, string_agg(token || ': ' || label, chr(10) ORDER BY tok_idx) AS text FROM ({_BIO}) GROUP BY doc_id"))
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as lines of word and label (K5)."""
    return W.word_lines(_labelled_tokens(spark, sf_dir))


@query("field_runs", V.with_sql("line", "token", then=f"SELECT doc_id, label, min(tok_idx) AS first, string_agg(token, ' ' ORDER BY tok_idx) AS text FROM (SELECT *, CASE WHEN label = 'title' THEN tok_idx // 10 ELSE (tok_idx - 4) // 10 END AS run FROM ({_BIO})) GROUP BY doc_id, label, run"))
def field_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels as fields (K4)."""
    return W.fields(_labelled_tokens(spark, sf_dir)).select("doc_id", "label", "first", "text")


@query("spread_labels", V.with_sql("line", "token", then="SELECT doc_id, tok_idx, CASE WHEN row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY tok_idx) = 1 THEN CASE line_idx % 3 WHEN 0 THEN 'paragraph-begin--_--id=' || line_idx WHEN 1 THEN 'section-marker-begin' ELSE 'notext' END ELSE CASE line_idx % 3 WHEN 0 THEN 'paragraph-inside' WHEN 1 THEN 'section-marker-inside' ELSE 'notext' END END AS label FROM token"))
def spread_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line labels on tokens."""
    i = F.col("line_idx")
    label = F.when(i % 3 == 0, F.concat(F.lit("paragraph-begin--_--id="), i)).when(i % 3 == 1, "section-marker-begin").otherwise("notext")
    return B.token_body_labels(V.token(spark, sf_dir).select("doc_id", "tok_idx", "line_idx"), V.line(spark, sf_dir).withColumn("label", label)).select("doc_id", "tok_idx", "label")


# five styles of references, one a document, numbered with gaps
V.SQL["begun"] = """
SELECT doc_id, line_idx, CASE WHEN line_idx % 3 <> 0 THEN 'and so on ' || text ELSE CASE doc_id % 6 WHEN 0 THEN '[' || line_idx || '] ' WHEN 1 THEN 'Smith A., Jones B. C., 1999 ' WHEN 2 THEN 'A. Smith, and Bob Jones. 1984. ' WHEN 3 THEN 'Smith, A. B., Jones, C. & Low, D. (1991). ' WHEN 4 THEN line_idx || ') The ' ELSE (line_idx // 3 + CASE WHEN line_idx % 21 = 12 THEN 7 ELSE 0 END) || '. The ' END || text END AS text FROM line"""
_STARTS = [
    "text LIKE '[%' AND strpos(text, ']') > 2",
    "text LIKE 'Smith A., Jones B. C., 1999%'",
    "text LIKE 'A. Smith, and Bob Jones. 1984.%'",
    "text LIKE 'Smith, A. B., Jones, C. & Low, D. (1991%'",
    "regexp_matches(split_part(text, ')', 1), '^[0-9]+$') AND regexp_matches(substr(text, strpos(text, ')') + 1), '^ +[A-Z]')",
    "regexp_matches(split_part(text, '.', 1), '^[0-9]{1,3}$') AND strpos(text, '.') < length(text)",
]


@query(
    "reference_starts",
    "WITH RECURSIVE line AS (" + V.SQL["line"] + "),\nbegun AS (" + V.SQL["begun"] + r"""),
hits AS (SELECT b.doc_id, line_idx, style, place, CASE WHEN style = 6 THEN TRY_CAST(regexp_extract(text, '^\s*(\d{1,3})\.', 1) AS INTEGER) END AS num, row_number() OVER (PARTITION BY b.doc_id ORDER BY line_idx) AS k FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM begun) b
JOIN (SELECT doc_id, CASE """
    + " ".join(f"WHEN {p} THEN {k + 1}" for k, p in enumerate(_STARTS))
    + " END AS style FROM begun WHERE line_idx = 0) s ON s.doc_id = b.doc_id WHERE CASE style "
    + " ".join(f"WHEN {k + 1} THEN {p}" for k, p in enumerate(_STARTS))
    + """ END),
walk AS (SELECT doc_id, line_idx, style, place, num AS last, true AS taken, k FROM hits WHERE k = 1 UNION ALL SELECT h.doc_id, h.line_idx, h.style, h.place, CASE WHEN h.num IS NULL OR h.num - w.last BETWEEN 1 AND 3 THEN h.num ELSE w.last END, h.num IS NULL OR h.num - w.last BETWEEN 1 AND 3, h.k FROM walk w JOIN hits h ON h.doc_id = w.doc_id AND h.k = w.k + 1)
SELECT doc_id, line_idx, style FROM (SELECT *, max(CAST(coalesce(late, false) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_idx) AS ended FROM (SELECT *, place - lag(place) OVER (PARTITION BY doc_id ORDER BY line_idx) > 3200 AS late FROM walk WHERE taken)) WHERE ended = 0""",
)
def reference_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of references by pattern."""
    i, d = F.col("line_idx"), F.col("doc_id") % 6
    number = F.floor(i / 3) + F.when(i % 21 == 12, 7).otherwise(0)
    begin = F.when(d == 0, F.concat(F.lit("["), i, F.lit("] "))).when(d == 1, "Smith A., Jones B. C., 1999 ").when(d == 2, "A. Smith, and Bob Jones. 1984. ").when(d == 3, "Smith, A. B., Jones, C. & Low, D. (1991). ").when(d == 4, F.concat(i, F.lit(") The "))).otherwise(F.concat(number, F.lit(". The ")))
    lines = V.line(spark, sf_dir).select("doc_id", "line_idx", F.when(i % 3 != 0, F.concat(F.lit("and so on "), "text")).otherwise(F.concat(begin, "text")).alias("text"))
    return S.reference_starts(lines).select("doc_id", "line_idx", "style")


@query("author_splits", V.with_sql("author", then="SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN string_agg(last || ', ' || substr(first, 1, 1), '|' ORDER BY author_id) ELSE string_agg(substr(first, 1, 1) || '. ' || last, '|' ORDER BY author_id) END AS names FROM author GROUP BY doc_id"))
def author_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author strings cut into names."""
    d, one = F.col("doc_id") % 2, F.substring("first", 1, 1)
    part = F.when(d == 0, F.concat("last", F.lit(", "), one, F.lit("."))).otherwise(F.concat(one, F.lit(". "), "last"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("author_id", part.alias("p")))), lambda x: x["p"]), ", ")
    return V.author(spark, sf_dir).groupBy("doc_id").agg(joined.alias("s")).select("doc_id", F.array_join(L.split_authors(F.col("s")), "|").alias("names"))


@query("parsed_references", V.with_sql("reference", then="SELECT doc_id, ref_id, marker AS ref_marker, 'On ' || ref_no AS title, '' AS conference, 'J' || n_authors AS journal, '' AS volume, CAST(ref_no AS VARCHAR) AS number, '' AS pages, last1 || CASE WHEN n_authors > 1 THEN ',' || last2 ELSE '' END AS authors, year || ',' || year AS dates FROM reference"))
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of tagged XML."""
    author = lambda c: F.concat(F.lit("<author><author-last>"), c, F.lit("</author-last></author>"))
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    xml = F.concat(F.lit('<reference refID="'), "ref_id", F.lit('">'), tag("ref-marker", "marker"), tag("authors", F.concat(author("last1"), F.when(F.col("n_authors") > 1, author("last2")).otherwise(""))), tag("title", F.concat(F.lit("On "), "ref_no")), tag("journal", F.concat(F.lit("J"), "n_authors")), tag("number", "ref_no"), tag("date", "year"), tag("date", "year"), F.lit("</reference>"))
    found = L.parsed_references(V.reference(spark, sf_dir).select("doc_id", xml.alias("xml")))
    return found.withColumns({c: F.array_join(c, ",") for c in ("authors", "dates")})


@query("flat_tags", "SELECT c_custkey AS doc_id, CAST(run AS BIGINT) AS run, label, CAST(pos AS INTEGER) AS pos, token FROM (SELECT c_custkey, lower(c_mktsegment) AS seg FROM customer), LATERAL (VALUES (0, 'O', 0, 'by'), (2, 'name', 0, 'x'), (2, 'name', 1, seg), (4, 'O', 0, 'and'), (6, 'date', 0, '1999'), (6, 'date', 1, '.')) AS t(run, label, pos, token)")
def flat_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of flat mark-up with their tag."""
    text = F.concat(F.lit("by <name a='b'>x "), F.lower("c_mktsegment"), F.lit("</name> and <DATE>1999."))
    return M.flat_tokens(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
