"""Features of tokens from their text, their neighbours and the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.by_document import dealt

#: Feature names and the patterns that a whole token must match.
PATTERNS = {
    "INITCAP": r"[A-Z].*",
    "ALLCAPS": r"[A-Z]+",
    "CONTAINSDIGITS": r".*[0-9].*",
    "ALLDIGITS": r"[0-9]+",
    "PHONEORZIP": r"[0-9]+-[0-9]+",
    "CONTAINSDOTS": r"[^.]*\..*",
    "CONTAINSDASH": r".*-.*",
    "ACRO": r"[A-Z][A-Z.]*\.[A-Z.]*",
    "LONELYINITIAL": r"[A-Z]\.",
    "SINGLECHAR": r"[A-Za-z]",
    "CAPLETTER": r"[A-Z]",
    "PUNC": r"[,.;:?!()]",
    "YEAR": r"(19|20)[0-9][0-9][a-z]?",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "URL": r"(http|ftp)s?://.*",
}


def regex_features(token: Column) -> Column:
    """Names of the patterns that a token matches, ascending."""
    return F.array_sort(F.array_compact(F.array(*[F.when(token.rlike(f"^(?:{p})$"), F.lit(n)) for n, p in PATTERNS.items()])))


def lexicon_features(tokens: DataFrame, lexicon: DataFrame, name: str, ignore_case: bool = True) -> DataFrame:
    """Tokens with a boolean column ``name``: whether the one-column frame ``lexicon`` has the token. Spark broadcasts a small lexicon by itself."""
    fold = F.lower if ignore_case else (lambda x: F.col(x))
    words = lexicon.select(fold(lexicon.columns[0]).alias("_word")).distinct().withColumn(name, F.lit(True))
    return tokens.withColumn("_word", fold("token")).join(words, "_word", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_word")


def lexicon_names(tokens: DataFrame, lexicons: DataFrame, longest: int = 1, names: str = "lexicons") -> DataFrame:
    """Tokens with the names of all lexicons that they are in, ascending, by one table for all lexicons.

    ``lexicons`` has name, entry (words joined by single blanks) and ignore_case. An entry of up to
    ``longest`` words gives its name to all tokens of every place where it stands; longer ones are not
    looked for. Null entries match nothing. Tokens have doc_id and tok_idx, which tell them apart.
    The different entries are broadcast, so tokens stay where they are and become no further rows; windows by document pass names on.
    """
    entry = F.struct(F.when(~F.col("ignore_case"), F.col("entry")).alias("exact"), "name")
    words = F.broadcast(lexicons.filter(F.col("entry").isNotNull()).groupBy(F.lower("entry").alias("_folded")).agg(F.collect_set(entry).alias("_entries")))
    fitting = lambda text: F.array_distinct(F.transform(F.filter("_entries", lambda x: x["exact"].isNull() | (x["exact"] == text)), lambda x: x["name"]))
    none = F.array().cast("array<string>")
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    found = tokens
    for n in range(1, longest + 1):
        text = F.col("token") if n == 1 else F.concat(f"_text{n - 1}", F.lit(" "), F.lead("token", n - 1).over(order))
        found = found.withColumn(f"_text{n}", text)
    for n in range(1, longest + 1):
        joined = found.withColumn("_folded", F.lower(f"_text{n}")).join(words, "_folded", "left")
        found = joined.withColumn(f"_names{n}", fitting(F.col(f"_text{n}"))).drop("_folded", "_entries", f"_text{n}")
    held = [F.coalesce(f"_names{n}", none) for n in range(1, longest + 1)]
    for k in range(1, longest):
        away = F.col("tok_idx") - F.lag("tok_idx", k).over(order)  # more than k where numbers are missing
        held += [F.when(away < n, F.coalesce(F.lag(f"_names{n}", k).over(order), none)).otherwise(none) for n in range(k + 1, longest + 1)]
    return found.withColumn(names, F.array_sort(F.array_distinct(F.concat(*held)))).drop(*[f"_names{n}" for n in range(1, longest + 1)])


def phrase_matches(tokens: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """Runs of up to ``longest`` tokens that are phrases (lower case, words joined by blanks): doc_id, tok_idx, n, phrase.

    The different phrases are broadcast, so runs stay where they are. Spark left to itself does so only where it has counted
    the phrases before the tokens are there; else it shuffles every run by its text, ten times the documents.
    """
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    words = [F.lower("token") if k == 0 else F.lead(F.lower("token"), k).over(order) for k in range(longest)]
    runs = tokens.select("doc_id", "tok_idx", F.array(*words).alias("_words"))
    each = runs.select("doc_id", "tok_idx", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"), "_words")
    each = each.filter(F.get("_words", F.col("n") - 1).isNotNull()).select("doc_id", "tok_idx", F.col("n").cast("long").alias("n"), F.array_join(F.slice("_words", 1, F.col("n")), " ").alias("phrase"))
    return each.join(F.broadcast(phrases.select("phrase").distinct()), "phrase", "left_semi").select("doc_id", "tok_idx", "n", "phrase")


def with_thesis(tokens: DataFrame) -> DataFrame:
    """Every token flagged where its document names itself a dissertation or thesis."""
    hit = F.lower("token").isin("dissertation", "thesis")
    return tokens.withColumn("is_thesis", F.max(hit).over(Window.partitionBy("doc_id")))


def with_page_flags(tokens: DataFrame, word: str) -> DataFrame:
    """Tokens with whether their page has ``word``, and on which of the first pages they are."""
    page = Window.partitionBy("doc_id", "page")
    return tokens.withColumn("page_has_word", F.max(F.lower("token") == word).over(page)).withColumn("on_page", F.when(F.col("page") < 4, F.concat(F.lit("ONPAGE"), "page")))


def line_regions(lines: DataFrame, tolerance: int = 2, limit: int = 15) -> DataFrame:
    """Lines in regions of even spacing: a region ends where the distance jumps by more than ``tolerance`` or exceeds ``limit``."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_idx")
    distance = F.lag("lly").over(order) - F.col("lly")
    spaced = lines.withColumn("distance", distance)
    flip = (F.col("distance") > limit) | (F.abs(F.col("distance") - F.lag("distance").over(order)) > tolerance)
    region = F.sum(F.when(F.coalesce(flip, F.lit(False)), 1).otherwise(0)).over(order)
    return spaced.withColumn("region", region.cast("long")).withColumn("region_size", F.count("*").over(Window.partitionBy("doc_id", "page", "region")))


def with_line_fonts(tokens: DataFrame) -> DataFrame:
    """Tokens with whether they are the last of their line, and whether their length differs from the line's first."""
    line = Window.partitionBy("doc_id", "line_idx").orderBy("tok_idx")
    return tokens.withColumn("is_last", F.lead("tok_idx").over(line).isNull()).withColumn("differs", F.first("font").over(line) != F.col("font"))


def with_last_format_token(tokens: DataFrame) -> DataFrame:
    """Tokens with the last token before them at which the font changed, and what kind of text that was."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    changed = F.coalesce(F.col("font") != F.lag("font").over(order), F.lit(True))
    marked = tokens.withColumn("_mark", F.when(changed, F.col("token")))
    last = F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(last.rlike("^[0-9]+$"), "number").when(~last.rlike("^[A-Za-z]"), "not_letter").otherwise("word")
    return marked.withColumn("last_format", last).withColumn("last_format_kind", F.when(last.isNotNull(), kind)).drop("_mark")


def with_page_ranges(tokens: DataFrame) -> DataFrame:
    """Tokens with whether a page range is at them: ``12-34`` ascending, or number, hyphen, number in three tokens."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    # columns of their own, as a window has one for each time that an expression names it
    ahead = tokens.withColumns({"_one": F.lead("token", 1).over(order), "_two": F.lead("token", 2).over(order)})
    token, two, number = F.col("token"), F.col("_two"), "^[0-9]+$"
    bare = lambda c: F.regexp_extract(c, "^0*([0-9]*)", 1)
    # numbers of any length: by how many digits they have, then as text; those that fit are compared as longs, without a pattern
    longer = lambda a, b: F.struct(F.length(bare(a)), bare(a)) < F.struct(F.length(bare(b)), bare(b))
    as_longs = lambda a, b: a.try_cast("long") < b.try_cast("long")
    left, right = F.regexp_extract(token, "^([0-9]+)-", 1), F.regexp_extract(token, "-([0-9]+)$", 1)
    ascending = F.coalesce(as_longs(F.substring_index(token, "-", 1), F.substring_index(token, "-", -1)), longer(left, right))
    inside = token.rlike("^[0-9]+-[0-9]+$") & ascending
    across = (F.col("_one") == "-") & token.rlike(number) & two.rlike(number) & F.coalesce(as_longs(token, two), longer(token, two))
    return ahead.withColumn("is_page_range", F.coalesce(inside, F.lit(False)) | F.coalesce(across, F.lit(False))).drop("_one", "_two")


def offset_features(tokens: DataFrame, features: str, offsets: tuple[int, ...]) -> DataFrame:
    """Tokens whose feature array also has the neighbours' features, marked ``@k``."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    empty = F.array().cast("array<string>")
    own = [_marked(features, k, order, empty) for k in offsets]
    return tokens.withColumn(features, F.concat(features, *own))


def _marked(features: str, k: int, order, empty: Column) -> Column:
    near = F.lead(features, k).over(order) if k > 0 else F.lag(features, -k).over(order)
    return F.transform(F.coalesce(near, empty), lambda x: F.concat(x, F.lit(f"@{k}")))


def censored(labels: DataFrame, keep: tuple[str, ...], label: str = "label") -> DataFrame:
    """Labels outside ``keep`` become the background label O."""
    return labels.withColumn(label, F.when(F.col(label).isin(*keep), F.col(label)).otherwise("O"))


def font_features(lines: DataFrame) -> DataFrame:
    """Lines with font flags and a region size as feature names: fonts, the large one as the largest where the document has no largest, and the largest font in regions of one to three lines."""
    has_largest = F.max("is_largest").over(Window.partitionBy("doc_id"))
    largest = F.col("is_largest") | F.col("is_large") & ~F.col("_has")
    names = [F.when(F.col("is_small"), "SMALLFONT"), F.when(F.col("is_large") & F.col("_has"), "LARGEFONT"), F.when(largest, "LARGESTFONT")]
    names += [F.when(largest & (F.col("region_size") == k), f"LARGESTFONT-AND-IN{k}LINETEXTREGION") for k in (1, 2, 3)]
    return lines.withColumn("_has", has_largest).withColumn("features", F.array_compact(F.array(*names))).drop("_has")


def with_font_changes(tokens: DataFrame, least: int = 120) -> DataFrame:
    """Tokens with whether the font changed, whether theirs is the document's biggest (of at least ``least``), and whether a line begins."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    size = F.col("ury") - F.col("lly")
    changed = F.coalesce(F.lag("font").over(order) != F.col("font"), F.lit(False))
    return tokens.withColumns({"font_change": changed, "biggest_font": size >= F.greatest(F.max(size).over(Window.partitionBy("doc_id")), F.lit(least)), "line_break": F.coalesce(F.lag("line_idx").over(order) != F.col("line_idx"), F.lit(True))})


def with_predictions(tokens: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """Tokens with ``predicted``: the ``k`` labels of the highest score as feature names, best first; of equal scores the first by name."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))), 1, k)
    named = F.transform(best, lambda x, i: F.concat(F.lit("PRED"), (i + 1).cast("string"), F.lit("="), x["label"]))
    each = predictions.groupBy("doc_id", "tok_idx").agg(named.alias("predicted"))
    # there are as many as tokens, so neither side is broadcast, whatever Spark makes of their size
    return dealt(tokens, "doc_id", "tok_idx").join(each.hint("merge"), ["doc_id", "tok_idx"], "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


def as_features(rows: DataFrame, words: str, features: str = "features") -> DataFrame:
    """The words of an array column as the features of numbered tokens; ``source`` keeps what they were."""
    return rows.select("doc_id", F.posexplode(words).alias("tok_idx", "token"), F.array_join(words, " ").alias("source")).withColumn("tok_idx", F.col("tok_idx").cast("long")).withColumn(features, F.array("token"))


def any_features(tokens: DataFrame, features: str = "features") -> DataFrame:
    """Whether any token of a document has features."""
    return tokens.groupBy("doc_id").agg(F.max(F.size(features) > 0).alias("any"))
