"""PII: bootstrapped contextual extraction.

Four base patterns (e-mail and IP addresses, card and phone numbers) find what can be told
by its form. Those finds are the seeds: the two words before each are a lexical pattern.
Weak candidates (other long numbers, written-out or incomplete addresses) are instances of
unknown standing. Patterns and instances form a graph, scored in rounds: a pattern is worth
the occurrences of known instances behind it, over all its occurrences in all texts, so that
everyday words score near zero; an instance is as credible as at least one of its patterns
being right. Instances that pass ``accept`` are known from then on, as the kind their best
pattern belongs to in that round: all their occurrences become spans, and the words before
these are new patterns, which find further instances in the next round. Only patterns with
``support`` different known instances take part. What is known stays known, so known
instances only grow in number, and the rounds go on until none is new.

All of it is DataFrame functions. Every round's tables go to the shared folder. Texts are
never shuffled for scoring, only the candidates with their context and the places of patterns;
equal texts count once. The occurrences of all patterns that may ever take part (enough
different instances behind them, known or not, and an unknown one) are counted before the
rounds, in one pass over the texts; the rounds read the graph alone.

A null text counts as empty; an empty one has no spans. Rows are kept as they come, repeated
ones too; columns ``spans`` and ``base`` are replaced, all others stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm import spans as S
from foliograph.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored at the start of a run (or the end of the match before), so that long runs cost linear time.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits with single separators, if it has 13 to 19 digits.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NUMBER = r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
_AT = r"\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?"
_WRITTEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++"
_PARTIAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
_BREAK = r"[^\p{L}\p{N}:=#]+"
_NONE = f"array<{S.SPAN}>"


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind and then start."""
    at, plus = F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    octets = lambda x: F.transform(F.split(x["body"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.filter(S.matches(text, _IP, "ip"), lambda x: F.forall(octets(x), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255)))
    card = F.filter(S.matches(text, _CARD, "card"), lambda x: S.passes_luhn(S.digits(x["body"])))
    phone = F.filter(S.matches(text, _PHONE, "phone", plus), lambda x: F.length(S.digits(x["body"])).between(9, 15))
    return F.concat(S.matches(text, _EMAIL, "email", at), ip, card, phone)


def weak_spans(text: Column) -> Column:
    """Candidates of kind ``number`` or ``address``; they may lie in or over base spans."""
    at = F.contains(text, F.lit("@"))
    return F.concat(S.matches(text, _NUMBER, "number"), S.matches(text, _WRITTEN, "address", text.rlike(_AT)), S.matches(text, _PARTIAL, "address", at))


def _apart(weak: Column, base: Column) -> Column:
    return F.filter(weak, lambda w: ~F.exists(base, lambda b: (w["start"] < b["stop"]) & (b["start"] < w["stop"])))


def _words(text: Column) -> Column:
    """Lower-case words, digits folded to 0."""
    folded = F.regexp_replace(F.lower(text), "[0-9]+", "0")
    return F.filter(F.split(folded, _BREAK), lambda w: w != "")


def _marked(words: Column) -> Column:
    """The words of a whole text with two marks before the first."""
    return F.concat(F.array(F.lit("^"), F.lit("^")), words)


def before(text: Column, start: Column) -> Column:
    """The two words before a place. A part of the text is looked at first, and a wider one where that may have cut one of them."""
    last = lambda words: F.array_join(F.slice(words, -2, 2), " ")
    found = last(_marked(_words(F.substring(text, F.lit(1), start))))
    for wide in (16_384, 1_024, 64):
        words = _words(F.substring(text, F.greatest(start - (wide - 1), F.lit(1)), F.least(start, F.lit(wide))))
        found = F.when(start <= wide, last(_marked(words))).when(F.size(words) > 2, last(words)).otherwise(found)
    return found


def with_spans(documents: DataFrame, *, text: str = "text", support: int = 5, accept: float = 0.5) -> DataFrame:
    """The documents with ``base`` (base spans) and ``spans`` (those and the discovered ones), each by kind and then start."""
    kept = [c for c in documents.columns if c not in ("spans", "base")]
    row, check, row2, check2, more = S.unused(documents.columns, "_row", "_sum", "_row2", "_sum2", "_found")
    body = F.coalesce(documents[text], F.lit(""))
    told = (F.xxhash64(documents[text]).alias(row), F.md5(documents[text].cast("binary")).alias(check))
    keyed = documents.select(*[documents[f"`{c}`"] for c in kept], base_spans(body).alias("base"), *told)
    found = _discovered(documents.select(F.col(text).alias("_text")), support, accept)
    if found is None:
        return keyed.withColumn("spans", F.col("base")).drop(row, check)
    # a table, so that its size is known: a small one goes to the documents
    found = written(found, "pii-found").toDF(row2, check2, more)
    out = keyed.join(found, (F.col(row) == F.col(row2)) & (F.col(check) == F.col(check2)), "left")
    spans = S.ordered(F.concat("base", F.coalesce(more, F.array().cast(_NONE))), KINDS, by_start=False)
    return out.select(*[F.col(f"`{c}`") for c in kept], "base", spans.alias("spans"))


def _discovered(texts: DataFrame, support: int, accept: float) -> DataFrame | None:
    """Discovered spans by text: (_row, _sum, _found), or None where there are no candidates or no patterns."""
    text = F.col("_text")
    scanned = texts.filter(text.rlike("[0-9]|@|" + _AT)).select("_text", base_spans(text).alias("_base"), weak_spans(text).alias("_weak"))
    holding = scanned.select("_text", "_base", _apart(F.col("_weak"), F.col("_base")).alias("_weak")).filter((F.size("_base") > 0) | (F.size("_weak") > 0))
    part = F.explode(F.concat(F.transform("_base", lambda x: F.struct(x.alias("span"), F.lit(True).alias("seed"))), F.transform("_weak", lambda x: F.struct(x.alias("span"), F.lit(False).alias("seed")))))
    is_address = F.col("_part.span.kind").isin("email", "address")
    name = F.when(is_address, F.lower("_part.span.body")).otherwise(S.digits(F.col("_part.span.body")))
    parts = holding.select("_text", part.alias("_part")).select(
        F.xxhash64("_text").alias("_row"),
        F.md5(F.col("_text").cast("binary")).alias("_sum"),
        F.col("_part.span").alias("span"),
        F.col("_part.seed").alias("seed"),
        before(F.col("_text"), F.col("_part.span.start")).alias("pattern"),
        is_address.alias("is_address"),
        name.alias("name"),
    )
    parts = written(parts.dropDuplicates(["_row", "_sum", "span"]), "pii-parts")
    nodes, context = ["is_address", "name"], ["pattern", "is_address"]
    seeds = parts.filter("seed").select(*nodes, F.col("span.kind").alias("kind")).distinct()
    unknown = written(parts.filter(~F.col("seed")).join(seeds.select(*nodes).distinct(), nodes, "left_anti"), "pii-unknown")
    # the graph: an edge for each pattern and name, of the patterns that may ever take part and find something
    edges = parts.groupBy("pattern", *nodes).agg(F.count("*").alias("seen"))
    is_open = unknown.select(*nodes).distinct().withColumn("open", F.lit(True))
    edges = written(edges.join(is_open, nodes, "left").withColumn("open", F.coalesce("open", F.lit(False))), "pii-edges")
    able = edges.groupBy(*context).agg(F.count("*").alias("names"), F.max("open").alias("open")).filter(F.col("open") & (F.col("names") >= support))
    patterns = written(able.select(*context, F.xxhash64("pattern").alias("key")), "pii-patterns")
    if patterns.isEmpty():
        return None
    times = written(patterns.join(_times(texts, patterns), "key", "left").select(*context, F.coalesce("times", F.lit(0)).alias("times")), "pii-times")
    edges = written(edges.join(times, context), "pii-graph")
    known, found, size = seeds, None, -1
    while found is None or found.count() > size:
        size = 0 if found is None else found.count()
        held = edges.join(known, nodes).groupBy(*context, "kind").agg(F.count("*").alias("names"), F.sum("seen").alias("n"), F.max("times").alias("times")).filter(F.col("names") >= support)
        scores = written(held.select(*context, "kind", (F.col("n") / (F.greatest("times", "n") + 1)).alias("score")), "pii-scores")
        # that at least one of a name's patterns is right
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999999)))))
        credible = edges.filter("open").join(scores, context).groupBy(*nodes, "kind").agg((1 - doubt).alias("confidence")).filter(F.col("confidence") >= accept)
        best = credible.groupBy(*nodes).agg(F.max(F.struct("confidence", "kind")).alias("best")).select(*nodes, "best.kind")
        found = written(best if found is None else found.union(best.join(found.select(*nodes), nodes, "left_anti")), "pii-known")
        known = seeds.union(found.select(*seeds.columns))
    span = F.struct(F.col("kind"), F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), F.col("span.body").alias("body"))
    return unknown.join(found, nodes).groupBy("_row", "_sum").agg(F.sort_array(F.collect_set(span)).alias("_found"))


def _times(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, times): how often each pattern occurs in all different texts."""
    text = F.col("_text")
    worded = texts.select(F.xxhash64(text).alias("_row"), F.md5(text.cast("binary")).alias("_sum"), _marked(_words(text)).alias("_words"))
    keys = F.zip_with("_words", F.slice("_words", 2, F.size("_words")), lambda a, b: F.when(b.isNotNull(), F.xxhash64(F.concat_ws(" ", a, b))))
    places = worded.select("_row", "_sum", F.posexplode(keys).alias("_place", "key"))
    hits = places.join(patterns.select("key").distinct(), "key", "left_semi").dropDuplicates(["_row", "_sum", "_place", "key"])
    return hits.groupBy("key").agg(F.count("*").alias("times"))
