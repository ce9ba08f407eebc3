"""Input frames made from the star-schema tables by arithmetic that any SQL engine repeats exactly.

Each view has a DataFrame form and, under the same name in ``SQL``, the text of a common
table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators.by_document import dealt, partitions_of

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*names: str, then: str) -> str:
    """A statement with the named views in front."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + then


SQL["line"] = """
SELECT doc_id, CAST(i AS BIGINT) AS line_idx, t AS text, CAST(i // 40 AS BIGINT) AS page, CAST(72 + 9 * (length(t) % 4) AS BIGINT) AS llx,
CAST(720 - 12 * (i % 40) AS BIGINT) AS lly, CAST(72 + 9 * (length(t) % 4) + 5 * length(t) AS BIGINT) AS urx,
CAST(720 - 12 * (i % 40) + 10 + (doc_id + i) % 3 AS BIGINT) AS ury, CAST(CASE WHEN i % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS font
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with a page, a box and a font, from documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    i, n = F.col("i").cast("long"), F.length("text").cast("long")
    llx, lly = 72 + 9 * (n % 4), 720 - 12 * (i % 40)
    return rows.select(
        "doc_id",
        i.alias("line_idx"),
        "text",
        F.floor(i / 40).alias("page"),
        llx.alias("llx"),
        lly.alias("lly"),
        (llx + 5 * n).alias("urx"),
        (lly + 10 + (F.col("doc_id") + i) % 3).alias("ury"),
        F.when(i % 7 == 0, 2).otherwise(1).cast("long").alias("font"),
    )


SQL["token"] = r"""
SELECT doc_id, line_idx, page, llx, lly, urx, ury, font, CAST(j AS BIGINT) AS pos, w AS token, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, j) - 1 AS tok_idx
FROM (SELECT l.*, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w, unnest(range(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')))) AS j FROM line l)"""


def word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines without numbers, as they are read: (doc_id, token)."""
    trimmed = line(spark, sf_dir).select("doc_id", F.trim("text", F.lit(" \t\n\x0b\f\r")).alias("text")).filter("text <> ''")
    return trimmed.select("doc_id", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("token"))


def token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines, numbered through each document.

    Lines are dealt by document and numbered by the words before them, and become words only then, so no word is shuffled or
    sorted here. The shuffle has as many partitions as the texts fill, and keeps them, as words take far more room than the lines
    that it sees: what a task sorts behind this does not grow with the table.
    """
    white = r"[\x20\x09-\x0D]"
    trimmed = F.trim("text", F.lit(" \t\n\x0b\f\r"))
    least = partitions_of(table(spark, sf_dir, "documents"))
    lines = dealt(line(spark, sf_dir), "doc_id", least=least).withColumn("text", trimmed).filter("text <> ''")
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    before = F.sum(n).over(Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("_before", F.coalesce(before, F.lit(0))).select("*", F.posexplode(F.split("text", f"{white}+")).alias("pos", "token")).drop("text")
    return rows.withColumn("pos", F.col("pos").cast("long")).withColumn("tok_idx", F.col("_before") + F.col("pos")).drop("_before")


SQL["author"] = """
SELECT c_custkey // 8 AS doc_id, c_custkey AS author_id, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || substr('aeioulnrst', CAST(c_custkey % 7 + 1 AS INTEGER), 3) AS first,
CASE WHEN c_custkey % 3 = 0 THEN chr(CAST(65 + c_custkey % 20 AS INTEGER)) ELSE '' END AS middle,
chr(CAST(65 + (c_custkey * 7) % 26 AS INTEGER)) || substr('bcdfghklmnprst', CAST(c_custkey % 9 + 1 AS INTEGER), 4) || substr('aeiou', CAST(c_custkey % 5 + 1 AS INTEGER), 1) AS last,
c_nationkey AS nation FROM customer"""


def author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of papers, eight to a paper, from customers."""
    c = F.col("c_custkey")
    letter = lambda x: F.chr((65 + x).cast("int"))
    some = lambda text, at, n: F.substring(F.lit(text), (at + 1).cast("int"), F.lit(n))
    return table(spark, sf_dir, "customer").select(
        F.floor(c / 8).alias("doc_id"),
        c.alias("author_id"),
        F.concat(letter(c % 26), some("aeioulnrst", c % 7, 3)).alias("first"),
        F.when(c % 3 == 0, letter(c % 20)).otherwise("").alias("middle"),
        F.concat(letter((c * 7) % 26), some("bcdfghklmnprst", c % 9, 4), some("aeiou", c % 5, 1)).alias("last"),
        F.col("c_nationkey").alias("nation"),
    )


SQL["raw_email"] = """
SELECT doc_id, author_id AS email_ref, CASE WHEN author_id % 11 = 0 THEN '{' || lower(first) || ',' || lower(last) || '}' WHEN author_id % 11 = 1 THEN lower(first) || '|' || lower(last)
WHEN author_id % 5 = 0 THEN lower(first || '.' || last) WHEN author_id % 5 = 1 THEN lower(last) WHEN author_id % 5 = 2 THEN lower(substr(first, 1, 1) || last) WHEN author_id % 5 = 3 THEN lower(first || last) || '1' ELSE 'zz' || author_id END
|| CASE WHEN author_id % 29 = 0 THEN '' ELSE '@cs.n' || nation || '.edu' END AS raw FROM author"""


def raw_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail strings as papers print them, one for each author."""
    a, first, last = F.col("author_id"), F.col("first"), F.col("last")
    user = (
        F.when(a % 11 == 0, F.concat(F.lit("{"), F.lower(first), F.lit(","), F.lower(last), F.lit("}")))
        .when(a % 11 == 1, F.concat(F.lower(first), F.lit("|"), F.lower(last)))
        .when(a % 5 == 0, F.lower(F.concat(first, F.lit("."), last)))
        .when(a % 5 == 1, F.lower(last))
        .when(a % 5 == 2, F.lower(F.concat(F.substring(first, 1, 1), last)))
        .when(a % 5 == 3, F.concat(F.lower(F.concat(first, last)), F.lit("1")))
        .otherwise(F.concat(F.lit("zz"), a))
    )
    domain = F.when(a % 29 == 0, "").otherwise(F.concat(F.lit("@cs.n"), F.col("nation"), F.lit(".edu")))
    return author(spark, sf_dir).select("doc_id", a.alias("email_ref"), F.concat(user, domain).alias("raw"))


SQL["dictionary"] = "SELECT 'n' || n_nationkey || '.edu' AS domain, 'University of ' || n_name AS name FROM nation WHERE n_nationkey % 4 <> 3"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions by domain, from nations."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter(n % 4 != 3).select(F.concat(F.lit("n"), n, F.lit(".edu")).alias("domain"), F.concat(F.lit("University of "), F.col("n_name")).alias("name"))


SQL["institution"] = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n_nationkey) - 1 AS inst_id, CASE WHEN n_nationkey % 2 = 0 THEN 'university of ' || lower(n_name) ELSE 'Dept, University of ' || n_name || ', Earth' END AS name
FROM (SELECT DISTINCT doc_id, nation FROM author) JOIN nation ON nation = n_nationkey"""


def institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions that a paper lists."""
    of_doc = author(spark, sf_dir).select("doc_id", "nation").distinct().join(table(spark, sf_dir, "nation"), F.col("nation") == F.col("n_nationkey"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("university of "), F.lower("n_name"))).otherwise(F.concat(F.lit("Dept, University of "), F.col("n_name"), F.lit(", Earth")))
    return of_doc.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n_nationkey")) - 1).cast("long").alias("inst_id"), name.alias("name"))


SQL["reference"] = """
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ref_no, 'r' || o_orderkey AS ref_id,
CASE WHEN o_custkey % 3 < 2 THEN '[' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || ']' ELSE '' END AS marker,
1 + o_orderkey % 3 AS n_authors, chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || 'ason' AS last1, chr(CAST(65 + (o_orderkey * 3) % 26 AS INTEGER)) || 'elby' AS last2, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of papers, from orders."""
    o = F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        number.cast("long").alias("ref_no"),
        F.concat(F.lit("r"), o).alias("ref_id"),
        F.when(F.col("o_custkey") % 3 < 2, F.concat(F.lit("["), number, F.lit("]"))).otherwise("").alias("marker"),
        (1 + o % 3).alias("n_authors"),
        F.concat(F.chr((65 + o % 26).cast("int")), F.lit("ason")).alias("last1"),
        F.concat(F.chr((65 + (o * 3) % 26).cast("int")), F.lit("elby")).alias("last2"),
        F.year("o_orderdate").cast("string").alias("year"),
    )


SQL["cited"] = """
SELECT r.doc_id, r.ref_no, CASE WHEN r.marker <> '' THEN CASE WHEN r.ref_no % 4 = 0 THEN '[' || r.ref_no || ', ' || (r.ref_no + 1) || '; 99]' ELSE '[' || r.ref_no || ']' END
WHEN n_authors = 1 THEN last1 || ' ' || year WHEN n_authors = 2 THEN last1 || ' and ' || last2 || ' ' || year ELSE last1 || ' et al. ' || year END AS text FROM reference r WHERE r.ref_no % 5 <> 1"""


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation groups in running text."""
    n = F.col("ref_no")
    numbered = F.when(n % 4 == 0, F.concat(F.lit("["), n, F.lit(", "), n + 1, F.lit("; 99]"))).otherwise(F.concat(F.lit("["), n, F.lit("]")))
    text = (
        F.when(F.col("marker") != "", numbered)
        .when(F.col("n_authors") == 1, F.concat_ws(" ", "last1", "year"))
        .when(F.col("n_authors") == 2, F.concat_ws(" ", "last1", F.lit("and"), "last2", "year"))
        .otherwise(F.concat_ws(" ", "last1", F.lit("et al."), "year"))
    )
    return reference(spark, sf_dir).filter(n % 5 != 1).select("doc_id", "ref_no", text.alias("text"))
