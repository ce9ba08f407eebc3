"""Grant acknowledgements: sentences, support sentences, grant numbers and institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words before a full stop that do not end a sentence.
NOT_ENDING = ("dr", "mr", "mrs", "ms", "no", "nos")
EVIDENCE = ("work", "project", "research", "author", "authors", "partially", "paper", "report")
#: Words that may stand inside an institution's name.
CONNECTING = ("and", "of", "for", "the", "in", "at", "on", "und", "fur", "de", "la", "di", "y")


def sentences(tokens: DataFrame) -> DataFrame:
    """Tokens with their sentence's number. Tokens after the last sentence end belong to no sentence and are left out."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    before, one, two = F.lag("token").over(order), F.coalesce(F.lead("token", 1).over(order), F.lit("")), F.coalesce(F.lead("token", 2).over(order), F.lit(""))
    starts = one.rlike(r"^[\p{Lu}\p{Nd}]") | one.isin("+", "?", "x", "y")
    ends = F.col("token").isin(".", "?", "!") & ~F.coalesce(F.lower(before).isin(*NOT_ENDING), F.lit(False)) & starts & (two != ".")
    marked = tokens.withColumn("_end", ends)
    number = F.coalesce(F.sum(F.col("_end").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    closed = F.max(F.when(F.col("_end"), F.col("tok_idx"))).over(Window.partitionBy("doc_id"))
    return marked.withColumn("sentence", number).withColumn("_closed", closed).filter(F.col("tok_idx") <= F.col("_closed")).drop("_end", "_closed")


def support_sentences(found: DataFrame) -> DataFrame:
    """Sentences that say supported, funded or sponsored by, after a word of evidence; and the token behind it."""
    order = Window.partitionBy("doc_id", "sentence").orderBy("tok_idx")
    word = F.lower("token")
    hint = F.max(word.isin(*EVIDENCE)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    by = F.lower(F.lead("token").over(order)) == "by"
    hits = found.withColumn("_hit", hint & by & word.isin("supported", "funded", "sponsored")).filter("_hit")
    return hits.groupBy("doc_id", "sentence").agg((F.min("tok_idx") + 2).alias("after"))


def is_grant_number(token: Column) -> Column:
    """Enough digits among letters, digits, hyphens, slashes and dots, edges cut; the share is of the uncut token."""
    core = F.regexp_replace(F.regexp_replace(token, "^[(#]+", ""), "[.,)]+$", "")
    count = lambda chars: F.length(F.regexp_replace(core, f"[^{chars}]", ""))
    digits = count("0-9")
    share = (digits + count(r"\p{Lu}") + count("/.-")) / F.length(token)
    return core.rlike(r"^[\p{L}0-9/.-]*$") & ((digits >= 5) | (digits >= 3) & (F.length(token) >= 5) & (share > 0.5))


def grant_labels(tokens: Column) -> Column:
    """Labels of a sentence's tokens: a fold whose state is whether an institution's name is open and whether the token before was ``and``."""
    label = "array<string>"
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("was_and"), F.array().cast(label).alias("out"))

    def step(s: Column, t: Column) -> Column:
        low = F.lower(t)
        caps, connects, digit = t.rlike(r"^(\p{Lu}|[(\[]\p{Lu})"), low.isin(*CONNECTING), t.rlike("[0-9]")
        open_end = t.rlike(r"[\p{L}\p{N}]$")
        number = is_grant_number(t)
        begins = ~s["inside"] & caps & ~digit & ~connects & (F.length(t) > 1)
        goes_on = s["inside"] & (connects | caps) & ~digit
        splits = goes_on & s["was_and"] & (low == "the")
        closes = ~open_end & (F.length(t) > 2) & ~F.endswith(t, F.lit(")"))
        name = F.when(number, "B-grant-number").when(begins, "B-grant-institution").when(goes_on & ~splits, "I-grant-institution").otherwise("grant-background")
        inside = F.when(number, False).when(begins, open_end).when(splits, s["inside"]).when(goes_on, s["inside"] & ~closes).otherwise(False)
        before = F.when(~number & ~begins & splits, F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.lit("grant-background")))).otherwise(s["out"])
        return F.struct(inside.alias("inside"), (low == "and").alias("was_and"), F.concat(before, F.array(name)).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def nsf_number(text: Column) -> Column:
    """The seven digits of an award number, or null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits.rlike("^[0-9]{7}$"), digits)


def grant_records(labelled: DataFrame) -> DataFrame:
    """Institutions with the grant numbers that follow them; numbers before any institution are a record of their own.

    ``labelled`` has doc_id, sentence, and the arrays tokens and labels.
    """
    each = labelled.select("doc_id", "sentence", F.posexplode(F.arrays_zip("tokens", "labels")).alias("pos", "x")).select("doc_id", "sentence", "pos", F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"))
    order = Window.partitionBy("doc_id", "sentence").orderBy("pos")
    record = F.sum((F.col("label") == "B-grant-institution").cast("long")).over(order)
    part = lambda wanted: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", "token")))), lambda x: x["token"]), " ")
    grouped = each.withColumn("record", record).groupBy("doc_id", "sentence", "record")
    rows = grouped.agg(part(F.col("label").endswith("grant-institution")).alias("institution"), part(F.col("label") == "B-grant-number").alias("numbers"))
    return rows.filter("institution <> '' or numbers <> ''")
