"""Quality rules: divergence of a document's histograms from language references.

Base rules count words, symbols, repeated lines and words in repeated three-word windows.
On top of them two histograms of each document, of character classes and of common words,
are compared with the references of every language by Jensen-Shannon distance (base 2, from
0 to 1). A document whose ``lang`` has a reference is taken for the language of the smallest
sum, whatever ``lang`` says; it fails where a histogram with enough counts (``least_chars``,
``least_common``) is further off than its limit. Short documents are spared: that is what the
minimum lengths are for. A histogram without counts has no distance, and counts as 1 in a sum.

References are the summed histograms of all documents of a language that pass the base
rules, computed over the whole corpus in one aggregation to a row for each known language.
The histograms of each document are written once to the shared folder and read twice.

Everything is DataFrame functions. Three-word windows are compared by 64-bit hash within a
text. A null text has no words; it and an empty text fail the base rules by their length.
Rows are kept as they come, repeated ones too. Of two languages as near the first by name is
taken. Where there is no reference (an empty table, a null or other ``lang``, a text mostly in
letters without case, as of Chinese or Arabic), only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import written

#: Common words of the known languages.
COMMON = {
    "en": "the of and to a in is it that was for on are as with by this be at from or an".split(),
    "de": "der die und das in den von zu ist mit sich des auf für ein eine im dem nicht es".split(),
    "fr": "le la de et les des en un une du que est pour dans qui par sur au pas il elle".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: Character classes in the order in which they are taken out of a text, the most common first.
CLASSES = {
    "lower": r"\p{javaLowerCase}",
    "space": r"\x09-\x0D\x20",
    "upper": r"\p{javaUpperCase}",
    "digit": r"0-9",
    "letter": r"\p{L}",
    "stop": r".,;:?'()\x22-",
    "bar": r"|",
    "mark": r"!#$%&*<>=^~@+/_\\\[\]{}`",
}
_SPACE = r"[\x20\x09-\x0D]+"


def _count(text: Column, chars: str) -> Column:
    """How many characters of the class the text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def with_classes(documents: DataFrame, text: str) -> DataFrame:
    """The documents with ``_chars`` (characters of each class, and of none), word_chars and n_symbols.

    Each class is taken out of what the ones before it left, so only the first looks at the whole text.
    """
    left, kept = documents.withColumn("_left0", F.coalesce(F.col(text), F.lit(""))), documents.columns
    for k, chars in enumerate(CLASSES.values()):
        left = left.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", f"[{chars}]+", ""))
        if k:
            left = left.withColumn(f"_size{k}", F.length(f"_left{k}").cast("long")).drop(*([f"_left{k}"] if k != 4 else []))
        else:
            left = left.withColumn("_size0", F.length("_left0").cast("long")).drop("_left0")
    n = len(CLASSES)
    left = left.withColumn(f"_size{n}", F.length(f"_left{n}").cast("long"))
    sizes = [F.col(f"_size{k}") for k in range(n + 1)]
    counts = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    # after letters, white space and digits are gone, few characters are left to look through
    return left.select(*[F.col(f"`{c}`") for c in kept], F.array(*counts).alias("_chars"), (sizes[0] - counts[1]).alias("word_chars"), _count(F.col("_left4"), r"#*$%&|<>").alias("n_symbols"))


def with_counts(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, replacing columns of such names."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return _counted(with_classes(documents.drop(*names), text), text).drop("_chars")


def _counted(step: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, _SPACE), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [F.col(f"`{c}`") for c in step.columns]
    step = step.select(*kept, words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    word = lambda i: F.get("_words", i)
    windows = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<long>"))
    step = step.select(*kept, n.cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"))
    kept = [F.col(f"`{c}`") for c in step.columns if c != "_windows"]
    # most texts repeat no window at all, and need no sort
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.select(*kept, F.when(repeats, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h: long, i: int>>")).alias("_sorted"))
    same = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    step = step.withColumn("_same", same)
    flagged = F.filter(F.arrays_zip(F.col("_sorted").alias("w"), F.col("_same").alias("next"), F.concat(F.array(F.lit(False)), "_same").alias("before")), lambda x: (x["next"] | x["before"]) & x["w"].isNotNull())
    step = step.withColumn("_starts", F.transform(flagged, lambda x: x["w"]["i"])).drop("_sorted", "_same")
    covered = F.array_distinct(F.concat("_starts", F.transform("_starts", lambda i: i + 1), F.transform("_starts", lambda i: i + 2)))
    step = step.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_starts")
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def word_histogram(text: Column) -> Column:
    """Uses of each of WORDS in a text: its common words are sorted, and those between the first places of two are the uses of one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.isin(WORDS))
    first = lambda some: F.transform(F.array_distinct(some), lambda w: F.array_position(some, w))
    uses = lambda some, starts: F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(some) + 1)), lambda a, b: (b - a).cast("long"))
    counted = _let(F.sort_array(words), lambda some: _let(first(some), lambda starts: F.struct(F.array_distinct(some).alias("words"), F.when(F.size(some) > 0, uses(some, starts)).alias("uses"))))
    return _let(counted, lambda c: F.transform(F.array(*map(F.lit, WORDS)), lambda w: F.coalesce(F.get(c["uses"], (F.array_position(c["words"], w) - 1).cast("int")), F.lit(0).cast("long"))))


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a distribution to a reference distribution; null for null."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), lambda p, r: term(p, (p + r) / 2) + term(r, (p + r) / 2))
    return F.when(shares.isNotNull(), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def with_verdict(
    documents: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    char_limit: float = 0.19,
    word_limit: float = 0.6,
    least_chars: int = 200,
    least_common: int = 50,
) -> DataFrame:
    """The base counts with char_distance, word_distance, language and kept, replacing columns of such names; the text itself is not carried on."""
    new = ("char_distance", "word_distance", "language", "kept", "_chars", "_common", "_lang", "_text", "_n_chars", "_n_common")
    old = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    carried = documents.select(*[documents[f"`{c}`"] for c in documents.columns if c not in (*new, *old, text)], documents[text].alias("_text"), F.col(lang).alias("_lang"))
    carried = with_classes(carried, "_text").withColumn("_common", word_histogram(F.coalesce("_text", F.lit(""))))
    counted = _counted(carried, "_text").drop("_text")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    counted = written(counted.withColumns({"_n_chars": total("_chars"), "_n_common": total("_common")}), "divergence")
    known = [F.lit(x) for x in COMMON]
    wide = [F.sum(F.col(c)[k]).cast("double").alias(f"{c}{k}") for c, n in (("_chars", len(CLASSES) + 1), ("_common", len(WORDS))) for k in range(n)]
    references = {r["_lang"]: r for r in counted.filter(F.col("_lang").isin(*known) & ~F.col("base_failed")).groupBy("_lang").agg(*wide).collect()}
    shares = lambda c, n: F.when(F.col(n) > 0, F.transform(c, lambda x: x / F.col(n)))
    judged = counted.withColumns({"_char_shares": shares("_chars", "_n_chars"), "_word_shares": shares("_common", "_n_common")})
    best = []
    for name in COMMON:
        if name in references:
            row = references[name]
            chars, common = ([row[f"{c}{k}"] or 0.0 for k in range(n)] for c, n in (("_chars", len(CLASSES) + 1), ("_common", len(WORDS))))
            if sum(chars) and sum(common):
                parts = [distance(F.col(c), [x / sum(v) for x in v]) for c, v in (("_char_shares", chars), ("_word_shares", common))]
                best.append(F.struct((F.coalesce(parts[0], F.lit(1.0)) + F.coalesce(parts[1], F.lit(1.0))).alias("sum"), F.lit(name).alias("language"), parts[0].alias("char_distance"), parts[1].alias("word_distance")))
    chosen = F.array_min(F.array(*best)) if best else F.lit(None).cast("struct<sum: double, language: string, char_distance: double, word_distance: double>")
    # a language without a reference, or a script that none of them is written in, has nothing to be compared with
    place = list(CLASSES).index
    foreign = F.col("_chars")[place("letter")] > F.col("_chars")[place("lower")] + F.col("_chars")[place("upper")]
    judged = judged.withColumn("_best", F.when(F.col("_lang").isin(*references) & ~foreign, chosen) if references else chosen)
    off = ((F.col("_n_chars") >= least_chars) & (F.col("_best.char_distance") > char_limit)) | ((F.col("_n_common") >= least_common) & (F.col("_best.word_distance") > word_limit))
    out = judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(off, F.lit(False)))
    return out.select("*", "_best.language", "_best.char_distance", "_best.word_distance").drop("_best", "_chars", "_common", "_char_shares", "_word_shares", "_n_chars", "_n_common", "_lang")
