"""Queries over authors, e-mails, institutions, references and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import linking as L
from foliograph.operators import name_matching as N
from foliograph.plans import queries_streaming
from foliograph.plans import views as V
from foliograph.plans.catalog import query
from foliograph.sources import readers as R
from foliograph.sources import writers as W

_ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
V.SQL["email"] = rf"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY email_ref, k) - 1 AS email_id, email_ref, email FROM (
SELECT doc_id, email_ref, k, trim(u) || '@' || trim(split_part(raw, '@', 2)) AS email FROM (
SELECT doc_id, email_ref, raw, unnest(us) AS u, unnest(range(len(us))) AS k FROM (
SELECT doc_id, email_ref, raw, CASE WHEN regexp_matches(n, '^[f{{][^,]+(,[^,]+)+[g}}]$') THEN string_split(substr(n, 2, length(n) - 2), ',')
WHEN regexp_matches(n, '^[^f][^,]+(,[^,]+)+[^g]$') THEN string_split(n, ',') ELSE string_split(n, '|') END AS us
FROM (SELECT *, split_part(raw, '@', 1) AS n FROM raw_email WHERE contains(raw, '@')))))
WHERE regexp_matches(email, '{_ADDRESS}')"""
V.SQL["dict_hit"] = """
SELECT doc_id, email_id, email, arg_min(name, n) AS dict_name FROM (
SELECT doc_id, email_id, email, n, array_to_string(ls[len(ls) - n + 1 : len(ls)], '.') AS domain FROM (
SELECT doc_id, email_id, email, ls, unnest(range(2, len(ls) + 1)) AS n FROM (SELECT *, string_split(split_part(email, '@', 2), '.') AS ls FROM email))) JOIN dictionary USING (domain) GROUP BY ALL"""
V.SQL["email_inst"] = """
SELECT doc_id, email_id, email, min(inst_id) AS inst_id FROM dict_hit JOIN institution USING (doc_id)
WHERE contains(lower(name), lower(dict_name)) OR contains(lower(dict_name), lower(name)) GROUP BY ALL"""
V.SQL["pair"] = """
SELECT a.doc_id, author_id, email_id, email, CAST(CAST(list_max(list_transform(vs, lambda v: greatest(CASE WHEN v = letters THEN length(v) ELSE 0 END, length(usr) - levenshtein(usr, v)))) AS FLOAT) / CAST(length(usr) AS FLOAT) AS FLOAT) AS score FROM (
SELECT *, list_transform([last, first, substr(first, 1, 1) || last, last || substr(first, 1, 1), first, first || last, last || first, first || middle || last, first || substr(middle, 1, 1) || last], lambda x: lower(x)) AS vs FROM author) a
JOIN (SELECT *, lower(split_part(email, '@', 1)) AS usr, regexp_replace(lower(split_part(email, '@', 1)), '[^A-Za-z |^]', '', 'g') AS letters FROM email) e USING (doc_id)"""
V.SQL["link"] = """
SELECT doc_id, author_id, email_id, email, score FROM pair WHERE CAST(score AS DOUBLE) > 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, author_id ORDER BY score DESC, email_id DESC) = 1"""


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.emails(V.raw_email(spark, sf_dir))


@query("email_explode", V.with_sql("author", "raw_email", "email", then="SELECT * FROM email"))
def email_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in e-mail strings, numbered through each paper."""
    return _emails(spark, sf_dir)


@query("domain_lookup", V.with_sql("author", "raw_email", "email", "dictionary", "dict_hit", then="SELECT * FROM dict_hit"))
def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary name by shortest domain suffix."""
    return L.domain_institutions(_emails(spark, sf_dir), V.dictionary(spark, sf_dir))


@query("email_institutions", V.with_sql("author", "raw_email", "email", "dictionary", "dict_hit", "institution", "email_inst", then="SELECT * FROM email_inst"))
def email_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution of the paper for each e-mail."""
    return L.email_institutions(_emails(spark, sf_dir), V.dictionary(spark, sf_dir), V.institution(spark, sf_dir))


@query(
    "author_email_links",
    V.with_sql("author", "raw_email", "email", "dictionary", "dict_hit", "institution", "email_inst", "pair", "link", then="SELECT a.doc_id, a.author_id, a.first, a.last, k.email, round(CAST(k.score AS DOUBLE), 4) AS score, coalesce(i.inst_id, -1) AS inst_id FROM author a LEFT JOIN link k USING (doc_id, author_id) LEFT JOIN email_inst i USING (doc_id, email_id)"),
)
def author_email_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with their best e-mail and its institution."""
    authors, found = V.author(spark, sf_dir), _emails(spark, sf_dir)
    links = L.author_emails(authors, found).select("doc_id", "author_id", "email_id", "email", "score")
    places = L.email_institutions(found, V.dictionary(spark, sf_dir), V.institution(spark, sf_dir)).drop("email")
    out = authors.join(links, ["doc_id", "author_id"], "left").join(places, ["doc_id", "email_id"], "left")
    return out.select("doc_id", "author_id", "first", "last", "email", F.round(F.col("score").cast("double"), 4).alias("score"), F.coalesce("inst_id", F.lit(-1)).alias("inst_id"))


@query(
    "linked_header_files",
    V.with_sql("author", "raw_email", "email", "dictionary", "dict_hit", "institution", "email_inst", "pair", "link", then="""SELECT a.doc_id, a.author_id, a.first, a.last, k.email, CASE WHEN k.email IS NULL THEN NULL WHEN k.score >= 1 THEN 'whole' ELSE 'part' END AS how, i.inst_id, n.name AS institution
FROM author a LEFT JOIN link k USING (doc_id, author_id) LEFT JOIN email_inst i USING (doc_id, email_id) LEFT JOIN institution n ON n.doc_id = a.doc_id AND n.inst_id = i.inst_id"""),
)
def linked_header_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written as XML with links as attributes, and read again."""
    authors, found, institutions = V.author(spark, sf_dir), _emails(spark, sf_dir), V.institution(spark, sf_dir)
    links = L.author_emails(authors, found).select("doc_id", "author_id", "email_id", F.when(F.col("score") >= 1, "whole").otherwise("part").alias("how"))
    places = L.email_institutions(found, V.dictionary(spark, sf_dir), institutions).drop("email")
    linked = authors.join(links, ["doc_id", "author_id"], "left").join(places, ["doc_id", "email_id"], "left")
    path = queries_streaming._folder(spark)
    W.annotated_xml(W.linked_headers(linked, found, institutions), path)
    return R.linked_authors(spark, path)


V.SQL["ref_key"] = r"""
SELECT doc_id, key, arg_max(ref_id, ref_no) AS ref_id FROM (SELECT doc_id, ref_no, ref_id, regexp_replace(CASE WHEN marker <> '' THEN marker WHEN n_authors = 1 THEN last1 || ' ' || year WHEN n_authors = 2 THEN last1 || ' ' || last2 || ' ' || year ELSE last1 || ' et al ' || year END, '[(),.;\[\]]', '', 'g') AS key FROM reference)
GROUP BY doc_id, key"""


@query("reference_keys", V.with_sql("reference", "ref_key", then="SELECT * FROM ref_key"))
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation keys of references."""
    return L.reference_keys(V.reference(spark, sf_dir))


V.SQL["body"] = "SELECT doc_id, 'Seen ' || string_agg(text, ' and ' ORDER BY ref_no) AS text FROM cited GROUP BY doc_id"


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ref_no", "text"))), lambda x: x["text"])
    return V.cited(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit("Seen "), F.array_join(parts, " and ")).alias("text"))




# one letter for each style, by the paper's number
V.SQL["styled"] = r"""
SELECT doc_id, string_agg(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '(' || ref_no || ')' WHEN 2 THEN '[Ab' || ref_no || ']' WHEN 3 THEN '(Xy' || ref_no || '; Zz' || ref_no || ')' ELSE last1 || CASE ref_no % 3 WHEN 0 THEN ' et al. ' WHEN 1 THEN ' and Bee ' ELSE ' ' END || '(' || year || ')' END, ' so ' ORDER BY ref_no) AS text FROM (SELECT r.*, c.text FROM reference r JOIN cited c USING (doc_id, ref_no)) GROUP BY doc_id"""
V.SQL["style_count"] = r"""
SELECT s.doc_id, n_refs, [{'style': 'NUMERICAL_BRACKETS', 'n': CASE WHEN s.doc_id % 5 = 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(text, '\[[0-9 ,;]+\]'), lambda g: len(regexp_extract_all(g, '[0-9]+')))), 0) ELSE 0 END}, {'style': 'NUMERICAL_PARENS', 'n': CASE WHEN s.doc_id % 5 = 1 THEN len(regexp_extract_all(text, '\([0-9]{1,3}\)')) ELSE 0 END}, {'style': 'ALPHA_NUMERIC_BRACKETS', 'n': CASE WHEN s.doc_id % 5 = 2 THEN len(regexp_extract_all(text, '\[Ab')) ELSE 0 END},
{'style': 'ALPHA_NUMERIC_PARENS', 'n': CASE WHEN s.doc_id % 5 = 3 THEN len(regexp_extract_all(text, '(Xy|Zz)')) ELSE 0 END}, {'style': 'AUTHOR_LAST', 'n': len(regexp_extract_all(text, '(' || names || ') (and [a-zA-Z-]+|et al\.?)? ?\(?[0-9]{4}'))}] AS found
FROM styled s JOIN (SELECT doc_id, count(*) AS n_refs, string_agg(DISTINCT last1, '|') AS names FROM reference GROUP BY doc_id) USING (doc_id)"""
_FITS = "list_filter(found, lambda x: x.n - n_refs >= -10 AND abs(x.n - n_refs) < 1000 AND x.n * 100.0 / n_refs > 50 AND x.n * 100.0 / n_refs <= 250)"


@query("citation_styles", V.with_sql("reference", "cited", "styled", "style_count", then=f"SELECT doc_id, n_refs, {_FITS}[1].style AS style FROM style_count"))
def citation_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation style of each paper (J9): a fifth of the papers each in brackets, parentheses, letters in both, and author names."""
    refs = V.reference(spark, sf_dir)
    n, d = F.col("ref_no"), F.col("doc_id") % 5
    word = F.when(n % 3 == 0, " et al. ").when(n % 3 == 1, " and Bee ").otherwise(" ")
    text = (
        F.when(d == 0, F.col("text"))
        .when(d == 1, F.concat(F.lit("("), n, F.lit(")")))
        .when(d == 2, F.concat(F.lit("[Ab"), n, F.lit("]")))
        .when(d == 3, F.concat(F.lit("(Xy"), n, F.lit("; Zz"), n, F.lit(")")))
        .otherwise(F.concat(F.col("last1"), word, F.lit("("), F.col("year"), F.lit(")")))
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ref_no", text.alias("text")))), lambda x: x["text"])
    texts = refs.join(V.cited(spark, sf_dir), ["doc_id", "ref_no"]).groupBy("doc_id").agg(F.array_join(parts, " so ").alias("text"))
    return L.citation_styles(texts, refs)


@query(
    "citation_split",
    V.with_sql("reference", "cited", then=r"""SELECT doc_id, ref_no, cs[k] AS citation, CAST(CASE WHEN len(cs) = 1 THEN -1 ELSE k - 1 END AS BIGINT) AS place, len(cs) > 1 AND k = len(cs) AS is_last
FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS k FROM (SELECT doc_id, ref_no, regexp_extract_all(text, '[0-9]{1,3}') AS cs FROM cited WHERE starts_with(text, '[')))"""),
)
def citation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single citations of bracketed groups."""
    groups = V.cited(spark, sf_dir).filter(F.startswith("text", F.lit("[")))
    return L.split_citations(groups, "[0-9]{1,3}").select("doc_id", "ref_no", "citation", "place", "is_last")


@query(
    "citation_links",
    V.with_sql(
        "reference",
        "cited",
        "ref_key",
        then="""SELECT c.doc_id, c.ref_no, c.citation, coalesce(k.ref_id, '-1') AS ref_id FROM (SELECT doc_id, ref_no, unnest(regexp_extract_all(text, '[0-9]{1,3}')) AS citation FROM cited WHERE starts_with(text, '[')) c LEFT JOIN ref_key k ON c.doc_id = k.doc_id AND c.citation = k.key
UNION ALL SELECT c.doc_id, c.ref_no, c.text AS citation, coalesce(k.ref_id, j.ref_id, '-1') FROM (SELECT *, split_part(text, ' ', 1) || ' ' || regexp_extract(text, '[0-9]{4}') AS second, CASE WHEN contains(text, ' and ') THEN replace(text, ' and ', ' and ') WHEN contains(text, 'et al.') THEN replace(text, 'et al.', 'et al') ELSE text END AS key FROM (SELECT doc_id, ref_no, text FROM cited WHERE NOT starts_with(text, '['))) c
LEFT JOIN ref_key k ON c.doc_id = k.doc_id AND replace(c.key, ' and ', ' ') = k.key LEFT JOIN ref_key j ON c.doc_id = j.doc_id AND c.second = j.key""",
    ),
)
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that citations mean, numbered and by author."""
    cited, keys = V.cited(spark, sf_dir), L.reference_keys(V.reference(spark, sf_dir))
    numbered = L.split_citations(cited.filter(F.startswith("text", F.lit("["))), "[0-9]{1,3}").select("doc_id", "ref_no", "citation")
    named = cited.filter(~F.startswith("text", F.lit("["))).withColumnRenamed("text", "citation")
    columns = ("doc_id", "ref_no", "citation", "ref_id")
    return L.citation_references(numbered, keys, False).select(*columns).unionByName(L.citation_references(named, keys, True).select(*columns))


@query(
    "cited_references",
    V.with_sql("reference", "cited", then="SELECT r.doc_id, count(*) AS n_refs, count(c.ref_no) AS n_cited, count(*) - count(c.ref_no) AS n_uncited FROM reference r LEFT JOIN (SELECT DISTINCT doc_id, ref_no FROM cited) c USING (doc_id, ref_no) GROUP BY r.doc_id"),
)
def cited_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited and uncited references of each paper."""
    refs, hits = V.reference(spark, sf_dir).select("doc_id", "ref_no"), V.cited(spark, sf_dir).select("doc_id", "ref_no").distinct()
    yes = refs.join(hits, ["doc_id", "ref_no"], "left_semi").select("doc_id", F.lit(1).alias("hit"))
    no = refs.join(hits, ["doc_id", "ref_no"], "left_anti").select("doc_id", F.lit(0).alias("hit"))
    return yes.unionByName(no).groupBy("doc_id").agg(F.count("*").alias("n_refs"), F.sum("hit").alias("n_cited"), F.sum(1 - F.col("hit")).alias("n_uncited"))


@query(
    "citation_contexts",
    V.with_sql(
        "reference",
        "cited",
        "body",
        then=r"""SELECT doc_id, ref_no, style, unnest(regexp_extract_all(text, '(?s).{0,200}?' || core || '.{0,200}')) AS context FROM (
SELECT doc_id, ref_no, 'DATE' AS style, last1 || '[^.\[\]]{0,40}' || year AS core FROM reference UNION ALL
SELECT doc_id, ref_no, 'TAG', '\[(?:[\w\s,;.\-]+[\s,;])?' || regexp_extract(marker, '[0-9]+') || '(?:[\s,;][\w\s,;.\-]*)?\]' FROM reference WHERE marker <> '' UNION ALL
SELECT doc_id, ref_no, 'WEAK_TAG', '#(?:[\w.]+\s*,\s*)*' || regexp_extract(marker, '[0-9]+') || '(?:\s*,\s*[\w.]+)*#' FROM reference WHERE marker <> '' UNION ALL
SELECT doc_id, ref_no, 'NUMBER', '\[(?:[0-9]+\s*,\s*)*' || ref_no || '(?:\s*,\s*[0-9]+)*\]' FROM reference)
JOIN (SELECT doc_id, text || ' also #7, 2# and #' || doc_id % 9 || '#' AS text FROM body) USING (doc_id) WHERE regexp_matches(text, core)""",
    ),
)
def citation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text around citations of each reference."""
    bodies = _bodies(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" also #7, 2# and #"), F.col("doc_id") % 9, F.lit("#")))
    return L.citation_contexts(V.reference(spark, sf_dir), bodies)


@query(
    "spliced_citations",
    V.with_sql("reference", "cited", then="SELECT doc_id, ref_no, CASE WHEN length(text) > 3 THEN substr(text, 1, 1) || '<citation refID=\"r' || ref_no || '\">' || substr(text, 4, length(text) - 4) || '</citation>' ELSE text END AS text FROM cited"),
)
def spliced_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation tags spliced into text."""
    n = F.length("text")
    span = lambda a, b, tag: F.struct(a.alias("start"), b.alias("stop"), tag.alias("tag"))
    spans = F.array(span(F.lit(1), F.lit(3), F.concat(F.lit('<citation refID="r'), "ref_no", F.lit('">'))), span(n - 1, n, F.lit("</citation>")))
    return V.cited(spark, sf_dir).select("doc_id", "ref_no", F.when(n > 3, L.spliced(F.col("text"), spans)).otherwise(F.col("text")).alias("text"))


def _printed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Authors with their place in the paper, and their e-mails as printed; some with words in front, some with brackets misread."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("author_id")) - 1
    authors = V.author(spark, sf_dir).withColumn("author_no", place.cast("long"))
    raw = F.when(F.col("email_ref") % 3 == 0, F.concat(F.lit("E-mail: "), "raw")).otherwise(F.regexp_replace(F.regexp_replace("raw", r"^\{", "f"), r"\}@", "g@"))
    return authors, V.raw_email(spark, sf_dir).withColumn("raw", raw)


@query("segmented_emails")
def segmented_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses cut from e-mail strings, with misread brackets mended."""
    authors, raw = _printed(spark, sf_dir)
    return N.segmented(raw, authors)


@query("name_matches")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors and addresses that match by some rung."""
    authors, raw = _printed(spark, sf_dir)
    return N.matches(authors, N.segmented(raw, authors))
