"""Queries that apply the scalar text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import scalar as S
from foliograph.plans import views as V
from foliograph.plans.catalog import query

_line = V.with_sql


@query("ligatures", V.with_sql("line", then="SELECT doc_id, line_idx, replace(replace(replace(replace(replace(replace(replace(replace(text, 'ffi', '@~@'), 'fi', '@~@'), 'fl', '@~@'), 'ff', '@~@'), 'ae', '@~@'), 'oe', '@~@'), 'll', '@~@'), '@~@', '') AS plain FROM line"))
def ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without ligature groups."""
    return V.line(spark, sf_dir).select("doc_id", "line_idx", S.without_ligatures(F.col("text")).alias("plain"))


@query("trimmed_lines", V.with_sql("line", then="SELECT doc_id, line_idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^fl ', '   '), ' fl$', '   '), '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') AS trimmed, regexp_replace(CASE WHEN starts_with(text, '(') THEN text ELSE regexp_replace(text, '^[[:punct:]]', '') END, CASE WHEN ends_with(CASE WHEN starts_with(text, '(') THEN text ELSE regexp_replace(text, '^[[:punct:]]', '') END, ')') THEN '@@@never' ELSE '[[:punct:]]$' END, '') AS unpunctuated FROM line"))
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines trimmed to letters and digits, and without edge punctuation."""
    text = F.col("text")
    return V.line(spark, sf_dir).select("doc_id", "line_idx", S.trimmed_to_alphanumeric(text).alias("trimmed"), S.without_edge_punctuation(text).alias("unpunctuated"))


@query("years", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN substr(y, 3, 1) = '0' THEN '20' ELSE '19' END || substr(y, 3, 2) ELSE y END AS year FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years written in full or with an apostrophe."""
    o, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    written = F.when(o % 3 == 0, F.concat(F.lit("'"), F.substring(y, 3, 2))).when(o % 3 == 1, F.concat(F.lit("(c) "), y)).otherwise(y)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", S.normalised_year(written).alias("year"))


@query("dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'month=' || strftime(o_orderdate, '%b') ELSE 'year=' || year(o_orderdate) || '%%month=' || strftime(o_orderdate, '%b') END AS parsed FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text (X7); a year beyond this one is not a year."""
    o, d = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(o % 4 == 3, F.concat(F.date_format(d, "MMMM"), F.lit(" 2999"))).otherwise(F.date_format(d, "d MMMM yyyy"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", S.parsed_date(written, 2030).alias("parsed"))


@query("digests", "SELECT doc_id, upper(sha1(text)) AS sha FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-1 of documents."""
    return V.table(spark, sf_dir, "documents").select("doc_id", S.sha1_hex(F.col("text")).alias("sha"))


@query("mangled_urls", r"SELECT page_id, substr(string_split(h, '.')[len(string_split(h, '.')) - 1], 1, 1) || '/' || h || '/' || replace(url, '/', '\') AS path, url AS back FROM (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS h FROM pages)")
def mangled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as file paths and back."""
    pages = V.table(spark, sf_dir, "pages").select("page_id", S.mangled_url(F.col("url")).alias("path"))
    return pages.withColumn("back", S.demangled_url(F.col("path")))


@query("corpus_names", r"SELECT p_partkey, regexp_replace(p_brand || '.pdf', '(\.(xml|refs|gz|pdf|ps|meta|tagged|txt|html))+$', '') AS name FROM part")
def corpus_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names without known extensions (X11)."""
    path = F.concat(F.lit("/corpus/"), F.col("p_size"), F.lit("/"), F.col("p_brand"), F.lit(".pdf.meta.xml"))
    return V.table(spark, sf_dir, "part").select("p_partkey", S.corpus_name(path).alias("name"))


@query("names", V.with_sql("author", then="SELECT author_id, trim(regexp_extract(first || '3' || last, '[a-zA-Z. -]+')) AS clean, first || ' ' || middle || CASE WHEN middle <> '' THEN ' ' ELSE '' END || last AS header_name, last || ' ' || substr(first, 1, 1) || '. ' || CASE WHEN middle <> '' THEN substr(middle, 1, 1) || '.' ELSE '' END AS reference_name FROM author"))
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and composed author names."""
    parts = [F.col(c) for c in ("first", "middle", "last")]
    return V.author(spark, sf_dir).select("author_id", S.clean_name(F.concat("first", F.lit("3"), "last")).alias("clean"), S.full_name(*parts).alias("header_name"), S.full_name(*parts, style="reference").alias("reference_name"))


@query("email_parts", V.with_sql("author", "raw_email", then=r"SELECT email_ref, split_part(raw, '@', 1) AS usr, split_part(raw, '@', 2) AS domain, regexp_replace(regexp_replace('[' || raw || ');', '^[,;. \t\r\n()\[\]]+', ''), '[,;. \t\r\n()\[\]]+$', '') AS stripped FROM raw_email WHERE contains(raw, '@')"))
def email_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and domain of e-mail strings; edge junk cut."""
    raw = F.col("raw")
    return V.raw_email(spark, sf_dir).filter(F.contains(raw, F.lit("@"))).select("email_ref", S.email_user(raw).alias("usr"), S.email_domain(raw).alias("domain"), S.stripped(F.concat(F.lit("["), raw, F.lit(");"))).alias("stripped"))


@query("edit_distances", "SELECT c_custkey, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS distance FROM customer")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-cost edit distance."""
    return V.table(spark, sf_dir, "customer").select("c_custkey", F.levenshtein("c_name", "c_mktsegment").cast("long").alias("distance"))


@query("indel_distances")
def indel_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance with substitutions at cost two."""
    return V.table(spark, sf_dir, "customer").select("c_custkey", S.indel_distance(F.col("c_mktsegment"), F.substring("c_name", 1, 8)).cast("long").alias("distance"))


@query("elapsed_times", "SELECT event_id, CAST(ms // 3600000 AS VARCHAR) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS took FROM (SELECT event_id, event_id * 7919 AS ms FROM events)")
def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as text."""
    return V.table(spark, sf_dir, "events").select("event_id", S.elapsed(F.col("event_id") * 7919).alias("took"))


@query("skipped_headers", V.with_sql("line", then="SELECT doc_id, line_idx, CASE WHEN regexp_matches(text, '[.|]') THEN substr(text, length(regexp_extract(text, '^[^.|]*')) + 1) ELSE '' END AS rest, TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT) IS NOT NULL AS has_number FROM line"))
def skipped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text from a mark on; safe number casts."""
    number = F.regexp_replace("text", "[^0-9]", "").try_cast("long")
    return V.line(spark, sf_dir).select("doc_id", "line_idx", S.text_after(F.col("text"), "[.|]").alias("rest"), number.isNotNull().alias("has_number"))
