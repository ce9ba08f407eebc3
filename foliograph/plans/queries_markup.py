"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import markup as M
from foliograph.operators.by_document import dealt
from foliograph.plans import views as V
from foliograph.plans.catalog import query


@query("tagged_tokens")
def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pages with their tag paths."""
    pages = V.table(spark, sf_dir, "pages").select("page_id", M.without_scripts(F.col("html")).alias("text"))
    return M.tagged_tokens(pages, key="page_id")


V.SQL["word_line"] = "SELECT doc_id, line_idx, font, list_filter(string_split(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM line"


@query(
    "layout_tokens",
    V.with_sql(
        "line",
        "word_line",
        then="""SELECT doc_id, tok_idx, token, CASE WHEN line_idx = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'title' END WHEN line_idx % 4 = 1 THEN 'note' ELSE 'O' END AS label, 'F' || font AS font, p = 1 AS line_start, p > 1 AND NOT (p = n AND ends) AS line_in, p = n AND ends AS line_end FROM (
SELECT doc_id, line_idx, font, before + p - 1 AS tok_idx, ws[p] AS token, p, n, ends FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM (SELECT *, bool_or(line_idx % 5 <> 0) OVER (PARTITION BY doc_id, g) AS ends FROM (
SELECT *, len(ws) AS n, CAST(coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, sum(CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS g FROM word_line))))""",
    ),
)
def layout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents in mark-up with fonts and line ends."""
    i = F.col("line_idx")
    words = F.regexp_replace("text", "[^A-Za-z]", " ")
    bold = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<b>"), words, F.lit("</b>"))).otherwise(words)
    body = F.when(i == 0, F.concat(F.lit("<title>"), bold, F.lit("</title>"))).when(i % 4 == 1, F.concat(F.lit("<note k='1'>"), words, F.lit("</note>"))).otherwise(words)
    # no text stands before the position tag in every fifth line
    end = F.when(i % 5 == 0, "<phantom/><position x='1'/>").otherwise(" <position x='1'/>")
    piece = F.concat(F.lit('<line><font name="F'), "font", F.lit('"/>'), body, F.lit("</line>"), end)
    lines = dealt(V.line(spark, sf_dir), "doc_id").select("doc_id", F.struct("line_idx", piece.alias("piece")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "")
    texts = lines.groupBy("doc_id").agg(F.concat(F.lit("<doc source='d'><page>"), joined, F.lit("</page></doc>")).alias("text"))
    return M.layout_tokens(texts)


@query("page_titles", r"SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS title, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1) AS heading FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages."""
    html = F.col("html")
    return V.table(spark, sf_dir, "pages").select("page_id", M.field(html, "title").alias("title"), M.field(html, "h1").alias("heading"))


@query("page_scripts", r"SELECT page_id, sha1(regexp_replace(html, '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g')) AS sha FROM pages")
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts."""
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha1(M.without_scripts(F.col("html")).cast("binary")).alias("sha"))


@query(
    "homepage_features",
    """SELECT c_custkey AS page_id, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'contactinfo' END, CASE WHEN c_custkey % 3 = 0 THEN 'hometitle' END, CASE WHEN c_custkey % 7 IN (0, 1) THEN 'possibleroot' END, CASE WHEN c_custkey % 5 = 0 THEN 'publicationheading' END, CASE WHEN c_custkey % 4 = 1 THEN 'publicationlink' END,
CASE WHEN c_custkey % 5 = 2 THEN 'researchheading' END, CASE WHEN c_custkey % 4 = 2 THEN 'researchlink' END, CASE WHEN c_custkey % 4 = 3 THEN 'resumelink' END) AS features FROM customer""",
)
def homepage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home-page traits (F18), over pages made from customers."""
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "Home Page of ").otherwise("On homes, by ")
    heading = F.when(k % 5 == 0, "<h2>My Publications</h2>").when(k % 5 == 2, "<h3 class=x>Research</h3>").otherwise("<h4>Research papers</h4>")
    link = F.when(k % 4 == 1, "<a href=p>Papers</a>").when(k % 4 == 2, "<a href=r>our research</a>").when(k % 4 == 3, "<a href=c>Short CV</a>").otherwise("<a href=research>else</a>")
    body = F.when(k % 2 == 0, "<p>E-mail: me</p>").otherwise("<script>var email = 1</script><!-- phone --><p>emails</p>")
    html = F.concat(F.lit("<html><title>"), title, "c_name", F.lit("</title>"), heading, link, body, F.lit("</html>"))
    url = F.concat(F.lit("http://h.example"), F.when(k % 7 == 0, "/~me/").when(k % 7 == 1, "/index.html?x").otherwise("/~me/papers/"))
    pages = V.table(spark, sf_dir, "customer").select(k.alias("page_id"), html.alias("html"), url.alias("url"))
    return pages.select("page_id", F.array_join(M.homepage_features(pages), ",").alias("features"))


def _traits_sql() -> str:
    link = lambda words: rf"regexp_matches(body, '(?s)<a\b[^>]*>[^<]*\b(?:{words})')"
    heading = lambda words: rf"regexp_matches(body, '(?s)<h[1-3]\b[^>]*>[^<]*\b(?:{words})')"
    traits = {
        "contactinfo": r"regexp_matches(body, '\b(?:e-?mail|phone|fax|office|address)\b')",
        "hometitle": r"regexp_matches(title, '\bhome\s*page\b')",
        "possibleroot": r"regexp_matches(path, '^/?(?:~[^/]+/?)?(?:index\.[a-z]+)?$')",
        "publicationheading": heading("publications?|papers?"),
        "publicationlink": link("publications?|papers?"),
        "researchheading": heading("research"),
        "researchlink": link("research"),
        "resumelink": link("resume|cv|vita"),
    }
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in traits.items())
    return (
        rf"SELECT page_id, concat_ws(',', {names}) AS features FROM (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '') AS path, lower(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)) AS title, "
        r"lower(regexp_replace(html, '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g')) AS body FROM pages)"
    )


@query("homepage_pages", _traits_sql())
def homepage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home-page traits of the web pages themselves."""
    pages = V.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(M.homepage_features(pages), ",").alias("features"))
