"""Secret scans: multipart credential linking.

Three strong patterns report on their own: assignments to names such as ``token``, access
key identifiers, long lower-case hexadecimal runs. Weak candidates (identifiers, opaque
strings, endpoints) are everywhere, so they are reported only where complementary parts
co-occur: within ``scope`` code points of each other, an identifier with a secret, an
endpoint with both an identifier and a secret. Strong matches count as parts too.

The co-occurrence is an interval join done as a sweep: the parts of a text are put in order,
and running maxima and minima give the nearest part of each class on either side. It makes
one row for each part and never pairs them. All of it is DataFrame functions.

A null text counts as empty; an empty one has no spans. Rows are kept as they come, repeated
ones too; columns ``spans`` and ``base`` are replaced, names of helpers (``_row``, ``_sum`` and the like) are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm import spans as S
from foliograph.llm.shared import written

STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "opaque", "endpoint")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)$"""
#: Runs short of the least length cannot match, nor can they hide a match: they are maximal.
_ACCESS = r"AKIA[A-Z0-9]{12,}+"
_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_IDENTIFIER = r"""(?i:access_?key_?id|access_?id|client_?id|account_?id|key_?id|user_?name|user_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
_OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
_ENDPOINT = r"""(?<![A-Za-z])(?i:https?|ftps?|sftp|ssh|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]++)://[^\x00-\x20"'<>|]{3,}+"""


def strong_spans(text: Column) -> Column:
    """Spans of the three strong kinds, by start and then kind."""
    value = lambda x: F.regexp_extract(x["body"], _VALUE, 1)
    assign = F.filter(S.matches(text, _ASSIGN, "assign"), lambda x: F.length(value(x)) >= 8)
    found = F.concat(assign, S.matches(text, _ACCESS, "access", F.contains(text, F.lit("AKIA"))), S.matches(text, _HEX, "hex"))
    return S.ordered(found, STRONG, by_start=True)


def with_secrets(documents: DataFrame, *, text: str = "text", scope: int = 400) -> DataFrame:
    """The documents with ``base`` (strong spans) and ``spans`` (those and the linked weak ones).

    A span is a struct of kind, start, stop (code points) and body.
    """
    names = [c for c in documents.columns if c not in ("spans", "base", "_weak", "_row", "_sum", "_row2", "_sum2", "_linked")]
    columns = [documents[f"`{c}`"] for c in names]
    body = F.coalesce(documents[text], F.lit(""))
    linkable = F.contains(body, F.lit("://")) | body.rlike("(?i:id|name|login)[\"']?\\x20*[:=]") | F.contains(body, F.lit("AKIA"))
    weak = F.concat(S.matches(body, _IDENTIFIER, "identifier"), S.matches(body, _OPAQUE, "opaque"), S.matches(body, _ENDPOINT, "endpoint", F.contains(body, F.lit("://"))))
    # a part inside a strong span of the same text adds nothing
    told = (F.xxhash64(documents[text]).alias("_row"), F.md5(documents[text].cast("binary")).alias("_sum"))
    scanned = documents.select(*told, strong_spans(body).alias("base"), F.when(linkable, weak).otherwise(F.array().cast(f"array<{S.SPAN}>")).alias("_weak"))
    parts = (
        scanned.filter(F.size("_weak") > 0)
        .dropDuplicates(["_row", "_sum"])
        .select("_row", "_sum", F.explode(F.concat("base", F.filter("_weak", lambda w: ~F.exists("base", lambda b: (w["start"] < b["stop"]) & (b["start"] < w["stop"]))))).alias("part"))
    )
    # a table, so that its size is known: a small one goes to the documents, for a large one keys are shuffled (and texts only where they are asked for)
    linked = written(_linked(parts, scope), "linked").withColumnsRenamed({"_row": "_row2", "_sum": "_sum2"})
    base = documents.select(*columns, *told, strong_spans(body).alias("base"))
    out = base.join(linked, (F.col("_row") == F.col("_row2")) & (F.col("_sum") == F.col("_sum2")), "left")
    spans = S.ordered(F.concat("base", F.coalesce("_linked", F.array().cast(f"array<{S.SPAN}>"))), (*STRONG, *WEAK), by_start=True)
    return out.select(*[F.col(f"`{c}`") for c in names], "base", spans.alias("spans"))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts of each text that have their complement within ``scope``."""
    kind, start, stop = F.col("part.kind"), F.col("part.start"), F.col("part.stop")
    classes = {"identifier": kind.isin("identifier", "access"), "secret": kind.isin("opaque", "assign", "hex")}
    order = Window.partitionBy("_row", "_sum").orderBy(start, stop, kind)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for name, is_class in classes.items():
        behind = start - F.max(F.when(is_class, stop)).over(before)
        ahead = F.min(F.when(is_class, start)).over(after) - stop
        near[name] = (F.coalesce(behind <= scope, F.lit(False))) | (F.coalesce(ahead <= scope, F.lit(False)))
    swept = parts.select("_row", "_sum", "part", near["identifier"].alias("by_identifier"), near["secret"].alias("by_secret"))
    keep = (
        F.when(kind == "identifier", F.col("by_secret"))
        .when(kind == "opaque", F.col("by_identifier"))
        .when(kind == "endpoint", F.col("by_identifier") & F.col("by_secret"))
        .otherwise(False)
    )
    return swept.filter(keep).groupBy("_row", "_sum").agg(F.collect_list("part").alias("_linked"))


def redacted(documents: DataFrame, *, text: str = "text", scope: int = 400, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported span of the text replaced by ``mark``; null texts stay null. No other column is touched."""
    # the other columns as one, so that none of them clashes; the text once, should the rows be shuffled
    others = [F.col(f"`{c}`") for c in documents.columns if c != text]
    rows = documents.select(F.struct(F.lit(0).alias("_none"), *others).alias("_doc"), F.col(text).alias("_text"))
    found = with_secrets(rows, text="_text", scope=scope)

    def step(state: Column, x: Column) -> Column:
        gap = F.substring("_text", state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        fresh = x["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.concat(cut["out"], F.substring("_text", cut["at"] + 1, F.length("_text")))
    masked = F.when(F.size("spans") > 0, rest).otherwise(F.col("_text"))
    return found.select(*[masked.alias(c) if c == text else F.col(f"_doc.`{c}`") for c in documents.columns])
