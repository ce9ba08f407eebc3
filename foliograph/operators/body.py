"""Layout of body lines: page boxes, histograms with their modes, spacing, look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.by_document import dealt

#: Lexical flags of a body line and their patterns.
PATTERNS = {
    "starts_table": r"^(Table|TABLE|Tab\.)",
    "starts_figure": r"^(Figure|FIGURE|Fig\.)",
    "ends_in_dot": r"\.$",
    "ends_in_dot_and_number": r"\.[0-9]+$",
    "ends_in_colon": r":$",
    "is_contents": r"^C(?i:ontents)$",
    "is_index_line": r"[.]{5,999}[\s]{0,5}[0-9]+$",
    "starts_cap": r"^\p{Lu}",
    "no_alphabetic": r"^[^A-Za-z]*$",
    "first_level": r"^[0-9]+[.]?\s+\p{Lu}",
    "second_level": r"^[0-9]+[.][0-9]+[.]?\s+\p{Lu}",
    "third_level": r"^[0-9]+[.][0-9]+[.][0-9]+[.]?\s+\p{Lu}",
}


def page_boxes(lines: DataFrame) -> DataFrame:
    """The box around each page's lines."""
    return lines.groupBy("doc_id", "page").agg(F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), F.count("*").alias("n_lines"))


def modes(lines: DataFrame, value: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The most common value; of equals the one seen first."""
    counts = lines.select(*keys, "line_idx", value.alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("line_idx").alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct("value", "n"), F.struct("n", (-F.col("first")).alias("first"))).alias("m")).select(*keys, F.col("m.value").alias("value"), F.col("m.n").alias("n"))


def with_spacing(lines: DataFrame) -> DataFrame:
    """Lines with height, width, distance to the next line of the page (-1 for none) and pixels for a character, rounded half up."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_idx")
    distance = F.coalesce(F.col("lly") - F.lead("lly").over(page), F.lit(-1))
    width, n = F.col("urx") - F.col("llx"), F.length("text")
    return lines.withColumns({"height": F.col("ury") - F.col("lly"), "width": width, "distance": distance, "per_char": F.when(n > 0, F.floor(width / n + 0.5))})


def with_relative_flags(lines: DataFrame) -> DataFrame:
    """Lines with flags against the line before and the document's most common height, width and distance."""
    spaced, names = with_spacing(lines), ("height", "width", "distance")
    # one aggregation for all three modes; of equals the one seen first
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("value")) for n in names]))
    counts = spaced.select("doc_id", "line_idx", values.alias("v")).select("doc_id", "line_idx", "v.*").filter("value >= 0").groupBy("doc_id", "what", "value").agg(F.struct(F.count("*").alias("n"), (-F.min("line_idx")).alias("first")).alias("rank"))
    usual = counts.groupBy("doc_id").agg(*[F.max_by(F.when(F.col("what") == n, F.col("value")), F.when(F.col("what") == n, F.col("rank"))).alias(f"usual_{n}") for n in names])
    spaced = spaced.join(usual, "doc_id", "left")
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    flag = lambda c: F.coalesce(c, F.lit(False))
    up = F.col("lly") > F.lag("lly").over(order)
    return spaced.withColumns(
        {
            "new_page": flag(F.lag("page").over(order) != F.col("page")),
            "new_column": flag((F.lag("page").over(order) == F.col("page")) & up & (F.col("llx") > F.lag("urx").over(order))),
            "up": flag(up),
            "up20": flag(F.col("lly") > F.lag("lly").over(order) + 20),
            "up_and_left": flag(up & (F.col("llx") < F.lag("llx").over(order))),
            "right": flag(F.col("llx") > F.lag("llx").over(order)),
            "taller": flag(F.col("height") > F.col("usual_height") + 2),
            "wider": flag(F.col("width") > F.col("usual_width") + 10),
            "more_space": flag(F.col("distance") > F.col("usual_distance") + 2),
            "near_top": F.col("ury") > 700,
            "near_bottom": F.col("lly") < 300,
        }
    )


def lexical_flags(text: Column) -> Column:
    """Names of the patterns found, ascending."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in PATTERNS.items()])))


def ahead(lines: DataFrame, test: Column, least: int, of: int, name: str = "ahead") -> DataFrame:
    """Lines with whether ``test`` holds for at least ``least`` of the ``of`` lines from each on."""
    frame = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(0, of - 1)
    return lines.withColumn(name, F.sum(test.cast("long")).over(frame) >= least)


def dictionary_words(tokens: DataFrame, dictionary: DataFrame, least: int = 3) -> DataFrame:
    """Different dictionary words of each line with at least ``least`` tokens; ``dictionary`` has one column, ``word``."""
    words = tokens.select("doc_id", "line_idx", F.lower(F.regexp_replace("token", r"[^A-Za-z]", "")).alias("word"))
    sizes = tokens.groupBy("doc_id", "line_idx").agg(F.count("*").alias("n_tokens")).filter(F.col("n_tokens") >= least)
    hits = words.distinct().join(dictionary.select("word").distinct(), "word", "left_semi").groupBy("doc_id", "line_idx").agg(F.count("*").alias("n_words"))
    return sizes.join(hits, ["doc_id", "line_idx"], "left").select("doc_id", "line_idx", "n_tokens", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def numbered_without(lines: DataFrame, left_out: str) -> DataFrame:
    """Lines without those flagged by the column ``left_out``, numbered anew in ``body_idx``."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    return lines.filter(~F.col(left_out)).withColumn("body_idx", (F.row_number().over(order) - 1).cast("long"))


def figure_ahead(lines: DataFrame, of: int = 6) -> DataFrame:
    """Lines with ``figure_ahead``: whether a caption seems to end within the ``of`` lines from each on.

    A line that ends left of the margin and before a break is one by itself. Of the lines after
    it the first that decides counts: a line as long as the one before it, before a break,
    says no; a shorter one with the same left margin, before a break or the end, says yes.
    ``lines`` has flags ends_left, shorter, same_left, more_space, up and right.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    last = F.lead("line_idx").over(order).isNull()
    breaks = F.coalesce(F.lead("up").over(order) | F.lead("right").over(order), F.lit(False)) | F.col("more_space")
    decided = F.when(~F.col("shorter") & ~F.col("_last") & F.col("_breaks"), False).when(F.col("same_left") & F.col("shorter") & (F.col("_last") | F.col("_breaks")), True)
    marked = lines.withColumns({"_last": last, "_breaks": breaks}).withColumn("_decided", decided)
    later = F.first("_decided", ignorenulls=True).over(order.rowsBetween(1, of - 1))
    return marked.withColumn("figure_ahead", F.col("ends_left") & (F.col("_last") | F.col("_breaks")) | F.coalesce(later, F.lit(False))).drop("_last", "_breaks", "_decided")


def above_before(lines: DataFrame, value: Column, of: int = 20) -> DataFrame:
    """Lines with whether ``value`` is no less than on any of the ``of`` lines before, as in a sorted list."""
    frame = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(-of, -1)
    return lines.withColumn("in_order", F.coalesce(value >= F.max(value).over(frame), F.lit(True)))


def token_body_labels(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Line labels spread over the lines' tokens: the first token keeps a beginning, the others are inside."""
    first = F.row_number().over(Window.partitionBy("doc_id", "line_idx").orderBy("tok_idx")) == 1
    inside = F.regexp_replace("label", "-begin.*$", "-inside")
    # dealt and sorted once, for the window and for the join
    placed = dealt(tokens, "doc_id", "line_idx").withColumn("_first", first)
    spread = placed.join(lines.select("doc_id", "line_idx", "label").hint("merge"), ["doc_id", "line_idx"])
    return spread.withColumn("label", F.when(F.col("_first"), F.col("label")).otherwise(inside)).drop("_first")
