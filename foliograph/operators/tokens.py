"""Tokens and lines of positioned text: fonts, repeated headers, hyphens, line records.

Line frames have doc_id, line_idx, text, page, llx, lly, urx, ury and font; token frames
doc_id, tok_idx, token and the columns of their line. All windows are by document.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.by_document import dealt

#: What a token is, the alternatives in the order in which they are tried; trailing white space belongs to it.
LEXER = (
    r"(?:``|''|“|”|\n|&amp;|[0-9]+(?:st|nd|rd|th)\b|[Pp]h\.?[Dd]\.?|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[A-Z]\.|\+[A-Z]+\+|\p{L}+|[0-9]+|[\p{Punct}\p{S}])\s*"
)


def lexed(lines: DataFrame) -> DataFrame:
    """Tokens of each line with their trimmed text and the blanks after them beyond the first (-1 for none)."""
    each = lines.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(LEXER), F.lit(0))).alias("pos", "_raw"))
    blanks = F.length(F.regexp_extract("_raw", r"\s*$", 0))
    return each.withColumn("token", F.rtrim(F.regexp_replace("_raw", r"\s+$", ""))).withColumn("trailing", (blanks - 1).cast("long")).withColumn("pos", F.col("pos").cast("long")).drop("_raw")


def font_sizes(lines: DataFrame) -> DataFrame:
    """The most common font size of each document (of equals the smallest) and its largest."""
    size = F.col("ury") - F.col("lly")
    counts = lines.groupBy("doc_id", size.alias("size")).agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("size")).alias("m"))).alias("best"), F.max("size").alias("largest")).select("doc_id", (-F.col("best.m")).alias("normal"), "largest")


def with_font_flags(lines: DataFrame) -> DataFrame:
    """Lines with flags for large, largest and small fonts and for changes of size and number from the line before."""
    flagged = lines.join(font_sizes(lines), "doc_id").withColumn("size", F.col("ury") - F.col("lly"))
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    size, normal, largest = F.col("size"), F.col("normal"), F.col("largest")
    return flagged.withColumns(
        {
            "is_largest": (size >= largest - 1) & (size > normal + 1),
            "is_large": size > normal + 1,
            "is_small": size < normal - 1,
            "new_size": F.coalesce(F.lag("size").over(order) != size, F.lit(False)),
            "new_font": F.coalesce(F.lag("font").over(order) != F.col("font"), F.lit(False)),
        }
    )


def header_footer_key() -> Column:
    """What a repeated line has in common: its text without digits and blanks, its place and its font."""
    return F.concat_ws("|", F.regexp_replace("text", r"[0-9\s]+", ""), "llx", "lly", "font")


def with_header_footer(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines with a flag for those that a document repeats at one place at least ``least`` times."""
    same = Window.partitionBy("doc_id", "_key")
    return lines.withColumn("_key", header_footer_key()).withColumn("is_header_footer", F.count("*").over(same) >= least).drop("_key")


def header_footer_boxes(lines: DataFrame) -> DataFrame:
    """The box around a page's repeated lines."""
    flagged = with_header_footer(lines).filter("is_header_footer")
    return flagged.groupBy("doc_id", "page").agg(*[f(c).alias(c) for f, c in ((F.min, "llx"), (F.min, "lly"), (F.max, "urx"), (F.max, "ury"))])


def dehyphenated(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words broken at a line end by a hyphen: the two parts, and the word they become.

    They are joined where the dictionary or the document itself has the joined word; else
    the hyphen stays. ``dictionary`` has one column, ``word``, in lower case.
    """
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    ahead = tokens.select("doc_id", "tok_idx", "line_idx", "token", F.lead("token").over(order).alias("rhs"), F.lead("line_idx").over(order).alias("rhs_line"))
    lhs = F.regexp_replace("token", "-$", "")
    word = F.regexp_replace(F.lower(F.concat(lhs, "rhs")), r"[^A-Za-z0-9_]", "")
    is_broken = F.col("token").rlike("[A-Za-z]-$") & (F.col("rhs_line") > F.col("line_idx"))
    # every token as a word of its document, and the words that broken ones may become: a window by word tells which the document has
    row = lambda word, lhs: F.struct(word.alias("word"), lhs.alias("lhs"))
    both = F.when(is_broken, F.array(row(F.lower("token"), F.lit(None).cast("string")), row(word, lhs))).otherwise(F.array(row(F.lower("token"), F.lit(None).cast("string"))))
    each = ahead.select("doc_id", "tok_idx", "rhs", F.inline(both)).withColumn("rhs", F.when(F.col("lhs").isNotNull(), F.col("rhs")))
    own = F.max(F.col("lhs").isNull()).over(Window.partitionBy("doc_id", "word")) & F.col("doc_id").isNotNull()
    broken = each.withColumn("_own", own).filter("lhs is not null")
    known = dictionary.select("word").distinct().withColumn("_known", F.lit(True))
    found = broken.join(known, "word", "left")
    is_word = F.coalesce(F.nullif("_own", F.lit(False)), "_known", F.lit(False))
    return found.select("doc_id", "tok_idx", "lhs", "rhs", is_word.alias("joined"), F.when(is_word, F.concat("lhs", "rhs")).otherwise(F.concat("lhs", F.lit("-"), "rhs")).alias("word"))


def withheld_hyphens(tokens: DataFrame) -> DataFrame:
    """Tokens without the hyphens that end a line on their own, renumbered, with ``split_lhs``: whether such a hyphen came behind, on this page or the next.

    Behind the first token of a document a hyphen goes without a mark. A document of such hyphens alone has no tokens left.
    """
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    ends = F.coalesce(F.lead("line_idx").over(order) != F.col("line_idx"), F.lit(True))
    marked = tokens.withColumn("_withheld", F.coalesce(F.trim("token") == "-", F.lit(False)) & ends)
    # each kept token with the hyphens up to the next
    numbered = marked.withColumn("_kept", F.sum((~F.col("_withheld")).cast("long")).over(order))
    split = F.max("_withheld").over(Window.partitionBy("doc_id", "_kept")) & (F.col("_kept") > 1)
    return numbered.withColumn("split_lhs", split).filter(~F.col("_withheld")).withColumn("tok_idx", F.col("_kept") - 1).drop("_withheld", "_kept")


def line_records(tokens: DataFrame) -> DataFrame:
    """Line records from tokens: text, box and token count. Tokens of line 0 belong to none and are left out."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]), " ")
    return tokens.filter("line_idx <> 0").groupBy("doc_id", "line_idx").agg(text.alias("text"), F.min("page").alias("page"), F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), F.count("*").alias("n_tokens"))


def token_range(tokens: DataFrame, first: int, last: int) -> DataFrame:
    """The tokens from ``first`` to before ``last`` of each document, renumbered."""
    return tokens.filter(F.col("tok_idx").between(first, last - 1)).withColumn("tok_idx", F.col("tok_idx") - first)


def formatted_text(lines: DataFrame) -> DataFrame:
    """The text of each document, every line ended by a line feed."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "")
    return lines.groupBy("doc_id").agg(text.alias("text"))


def without_pagination(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines without those at a page's edge that match ``pattern``; the head of the first page stays."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_idx")
    edge = lines.withColumn("_first", F.lag("line_idx").over(page).isNull()).withColumn("_last", F.lead("line_idx").over(page).isNull())
    artefact = F.col("text").rlike(pattern) & (F.col("_last") | F.col("_first") & (F.col("page") > 0))
    return edge.filter(~artefact).drop("_first", "_last")


def with_phantoms(tokens: DataFrame, joined: DataFrame) -> DataFrame:
    """Tokens after joining the words broken at line ends: the word stands where it began, and an empty phantom keeps the place on the next line if the word's rest was all of that line.

    ``joined`` is what ``dehyphenated`` returns.
    """
    # a word stands at its token, and its rest is the token behind: one table, so that tokens are joined once
    at = F.array(F.struct(F.col("tok_idx").alias("tok_idx"), F.col("word").alias("_word"), F.lit(None).cast("boolean").alias("_rest")), F.struct((F.col("tok_idx") + 1).alias("tok_idx"), F.lit(None).cast("string").alias("_word"), F.lit(True).alias("_rest")))
    changes = joined.filter("joined").select("doc_id", F.inline(at)).groupBy("doc_id", "tok_idx").agg(F.max("_word").alias("_word"), F.max("_rest").alias("_rest"))
    line = Window.partitionBy("doc_id", "line_idx")
    placed = tokens.withColumn("_alone", F.count("*").over(line) == 1)
    both = dealt(placed, "doc_id", "tok_idx").join(changes, ["doc_id", "tok_idx"], "left")
    is_rest = F.coalesce("_rest", F.lit(False))
    kept = both.withColumn("phantom", is_rest).withColumn("token", F.when(is_rest, "").otherwise(F.coalesce("_word", "token")))
    return kept.filter(~F.col("phantom") | F.col("_alone")).drop("_word", "_rest", "_alone")


def text_lines(tokens: DataFrame) -> DataFrame:
    """Lines of a token run, by where ``newline`` is set: token range, place of the first token, page and text, and whether a page ends before it."""
    order = Window.partitionBy("doc_id").orderBy("tok_idx")
    numbered = tokens.withColumn("line_no", F.sum(F.col("newline").cast("long")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]), " ")
    lines = numbered.groupBy("doc_id", "line_no").agg(F.min("tok_idx").alias("first_token"), F.max("tok_idx").alias("last_token"), F.min_by("llx", "tok_idx").alias("llx"), F.min_by("lly", "tok_idx").alias("lly"), F.min_by("page", "tok_idx").alias("page"), text.alias("text"))
    return lines.withColumn("is_page_break", F.coalesce(F.lag("page").over(Window.partitionBy("doc_id").orderBy("line_no")) != F.col("page"), F.lit(False)))


#: Marks that stand alone behind their letter, and the combining mark each means.
LONE_MARKS = {"\u00b4": "\u0301", "\u0060": "\u0300", "\u005e": "\u0302", "\u00a8": "\u0308", "\u007e": "\u0303"}


def repaired_diacritics(text: Column) -> Column:
    """Text in which a letter and the lone mark behind it are one letter, and two backticks a quote. Pairs that make no letter stay."""
    pairs = {}
    for mark, combining in LONE_MARKS.items():
        for letter in "aceginosuyzACEGINOSUYZ":
            whole = unicodedata.normalize("NFC", letter + combining)
            if len(whole) == 1:
                pairs[letter + mark] = whole
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    quoted = F.replace(text, F.lit("``"), F.lit('"'))
    # only the pairs that a text holds are replaced
    held = F.array_distinct(F.regexp_extract_all(quoted, F.lit("[aceginosuyzACEGINOSUYZ][\u00b4\u0060^\u00a8~]"), F.lit(0)))
    return F.aggregate(F.filter(held, lambda x: F.map_contains_key(table, x)), quoted, lambda t, x: F.replace(t, x, F.element_at(table, x)))


def harvested(texts: DataFrame, most_of_author: int = 3, longest_abstract: int = 1000) -> DataFrame:
    """Header texts for labelling: at most ``most_of_author`` papers of an author, in order of doc_id, and no abstracts over ``longest_abstract`` characters. Both bounds are what the harvest is."""
    nth = F.row_number().over(Window.partitionBy("author").orderBy("doc_id"))
    return texts.filter(F.length("abstract") <= longest_abstract).withColumn("_nth", nth).filter(F.col("_nth") <= most_of_author).drop("_nth")
