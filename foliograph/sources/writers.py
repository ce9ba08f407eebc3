"""Sinks: annotated XML, segmented text, logs by level, spans, summary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Line prefix of each section kind.
PREFIXES = {"header": "h", "body": "b", "prologue": "p", "reference": "r", "epilogue": "e"}


def annotated_xml(documents: DataFrame, path: str, row: str = "document") -> None:
    """Nested documents as XML."""
    documents.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", "documents").save(path)


def linked_headers(authors: DataFrame, emails: DataFrame, institutions: DataFrame) -> DataFrame:
    """Headers for ``annotated_xml``: each author with the numbers of their e-mail and institution as attributes.

    ``authors`` has doc_id, author_id, first, last, email_id, inst_id (null: no link, no attribute) and how,
    which stands behind the e-mail's number after a hyphen unless it is null; ``emails`` has doc_id, email_id, email, ``institutions``
    doc_id, inst_id, name. A document in any of them has a row; elements are in the order of their numbers.
    """
    listed = lambda rows, name, *item: rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*item))).alias(name))
    mail = F.when(F.col("email_id").isNotNull(), F.concat_ws("-", "email_id", "how"))
    author = listed(authors, "author", F.col("author_id").alias("_id"), mail.alias("_email"), F.col("inst_id").alias("_institution"), "first", "last")
    email = listed(emails, "email", F.col("email_id").alias("_id"), F.col("email").alias("address"))
    institution = listed(institutions, "institution", F.col("inst_id").alias("_id"), "name")
    whole = author.join(email, "doc_id", "full").join(institution, "doc_id", "full")
    return whole.select(F.col("doc_id").alias("_id"), "author", "email", "institution")


def segmented_text(lines: DataFrame, path: str) -> None:
    """Section lines as ``prefix: text``, references with their number. ``lines`` has doc_id, kind, ref_no, line_idx and text."""
    prefix = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[F.col("kind")]
    number = F.when(F.col("kind") == "reference", F.col("ref_no").cast("string")).otherwise("")
    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_idx")
    ordered.select(F.concat(prefix, number, F.lit(": "), F.col("text")).alias("value")).write.mode("overwrite").text(path)


def fields(tokens: DataFrame) -> DataFrame:
    """Runs of equally labelled tokens as fields: doc_id, the first token, label and text. ``tokens`` has doc_id, tok_idx, token and label."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    run = F.sum(F.coalesce(F.lag("label").over(order) != F.col("label"), F.lit(True)).cast("int")).over(order)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]), " ")
    return tokens.withColumn("_run", run).groupBy("doc_id", "_run", "label").agg(F.min("tok_idx").alias("first"), text.alias("text")).drop("_run")


def inline_tags(tokens: DataFrame) -> DataFrame:
    """The text of each document with its fields in tags."""
    tagged = fields(tokens).withColumn("_piece", F.concat(F.lit("<"), "label", F.lit("> "), "text", F.lit(" </"), "label", F.lit(">")))
    return tagged.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "_piece"))), lambda x: x["_piece"]), "\n").alias("text"))


def log(messages: DataFrame, path: str) -> None:
    """Document messages appended below their level. The message stays a column: texts are too many for folders."""
    messages.select("doc_id", "level", "message").write.mode("append").partitionBy("level").parquet(path)


def spans(found: DataFrame, path: str) -> None:
    """Label spans as tab-separated lines, ordered by start within each document."""
    found.repartition("doc_id").sortWithinPartitions("doc_id", "start").write.mode("overwrite").option("sep", "\t").csv(path)


def summary(rows: DataFrame, path: str) -> None:
    """Summary lines appended with semicolons between the fields."""
    rows.write.mode("append").option("sep", ";").csv(path)


def word_lines(tokens: DataFrame) -> DataFrame:
    """Each document's tokens as lines ``word: label``."""
    line = F.concat_ws(": ", "token", "label")
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
