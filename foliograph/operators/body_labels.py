"""Labels of body lines: section markers, captions of tables and figures, footers, paragraphs.

The rules remember what stood before: whether the last line was a section marker, which caption
goes on, whether a footer has begun. Each memory is a small automaton, and each line sets it, clears
it, turns it round or leaves it alone, so its state is that of the last line that did
something: a window over the document's lines. No line is looked at by a loop, and one shuffle by document
serves all windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.body import PATTERNS, ahead

#: What ``body_labels`` needs to know of a line, as Boolean columns.
FLAGS = (
    *("numbered", "all_caps", "starts_cap", "ends_in_dot", "ends_in_dot_and_number", "ends_in_colon", "no_alphabetic", "word_form"),
    *("starts_table", "starts_figure", "starts_enum", "is_index_line", "no_words", "one_word", "few_words"),
    *("no_column", "layout_change", "centered", "ends_left", "tabbed", "new_page", "new_column", "up", "up20", "up_and_left", "right"),
    *("near_top", "near_bottom", "space2", "space4", "space12", "space100", "rise2", "rise4"),
    *("lower1", "taller2", "taller10", "taller30", "wider10", "narrower20", "sparse2", "no_per_char", "figure_near", "figure_far"),
)


def _or(*some: Column) -> Column:
    return reduce(lambda a, b: a | b, some)


def with_line_flags(lines: DataFrame) -> DataFrame:
    """Lines with ``FLAGS``, but for the figures ahead.

    ``lines`` has text and box, ``left`` and ``right`` margins of the line's column (null where it is
    in none), ``n_words`` (dictionary words), the box's ``height`` and ``width``, ``distance`` and ``rise``
    (to the next line of the page, by lower and upper edges, -1 for none), ``per_char``, and what is usual in the
    document under the same names with ``usual_`` in front. Pages are 792 high.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    back = lambda c: F.lag(c).over(order)
    over = lambda c, by: F.col(c) > F.col(f"usual_{c}") + by
    under = lambda c, by: F.col(c) < F.col(f"usual_{c}") - by
    text, up = F.col("text"), F.col("lly") > back("lly")
    before, after = F.col("llx") - F.col("left"), F.col("right") - F.col("urx")
    flags = {n: text.rlike(PATTERNS[n]) for n in ("starts_table", "starts_figure", "ends_in_dot", "ends_in_dot_and_number", "ends_in_colon", "is_index_line", "starts_cap", "no_alphabetic")}
    flags |= {
        "numbered": _or(*[text.rlike(PATTERNS[n]) for n in ("first_level", "second_level", "third_level")]),
        "all_caps": text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}"),
        "word_form": text.rlike("[A-Za-z]{3}"),
        "starts_enum": text.rlike(r"^\(?[0-9]{1,2}[).]?\s"),
        "no_words": F.col("n_words") == 0,
        "one_word": F.col("n_words") == 1,
        "few_words": F.col("usual_n_words") > F.col("n_words") + 2,
        "no_column": F.col("left").isNull(),
        "layout_change": (back("page") == F.col("page")) & ((back("left") != F.col("left")) | (back("right") != F.col("right"))),
        "centered": (before > 5) & (F.abs(before - after) <= 4),
        "ends_left": after > 10,
        "tabbed": (before > 2) & (before < 30),
        "new_page": back("page") != F.col("page"),
        "new_column": (back("page") == F.col("page")) & up & (F.col("llx") > back("urx")),
        "up": up,
        "up20": F.col("lly") > back("lly") + 20,
        "up_and_left": up & (F.col("llx") < back("llx")),
        "right": F.col("llx") > back("llx"),
        "near_top": F.col("ury") > 792 - 150,
        "near_bottom": F.col("lly") < 100,
        "lower1": under("height", 0),
        "wider10": over("width", 10),
        "narrower20": under("width", 20),
        "sparse2": over("per_char", 1),
        "no_per_char": F.col("per_char").isNull(),
    }
    flags |= {f"space{n}": over("distance", n - 1) for n in (2, 4, 12, 100)} | {f"rise{n}": over("rise", n - 1) for n in (2, 4)} | {f"taller{n}": over("height", n - 1) for n in (2, 10, 30)}
    return lines.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})


def with_title_ahead(lines: DataFrame, of: int = 3) -> DataFrame:
    """Lines with ``title_ahead``: whether titles, from this line on, lead to a change of columns within ``of`` lines.

    The first line that decides counts: a change of columns says yes; a new page or column, but for
    the first line, and what cannot be a title say no.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    shape = _or(*map(F.col, ("numbered", "all_caps", "centered", "ends_left"))) & ~F.col("ends_in_dot") & ~F.col("no_alphabetic")
    alone = F.col("space2") & F.col("rise2")
    wide = F.coalesce(F.lag("space4").over(order), F.lit(False))
    decided = lambda title: F.when(F.col("layout_change"), True).when(~title, False)
    first, later = decided(shape & alone), F.when(F.col("new_page") | F.col("new_column"), False).otherwise(decided(shape & (alone | wide)))
    marked = lines.withColumns({"_first": first, "_later": later})
    found = F.coalesce("_first", *[F.lead("_later", k).over(order) for k in range(1, of)], F.lit(False))
    return marked.withColumn("title_ahead", found).drop("_first", "_later")


def body_labels(lines: DataFrame) -> DataFrame:
    """Lines with ``label`` and ``paragraph``; ``lines`` has ``FLAGS``.

    Labels: ``section-marker``, ``table-marker``, ``figure-marker`` and ``paragraph``, each with ``-begin`` or
    ``-inside``, and ``notext``. A beginning paragraph carries its number, from 0, which is also in ``paragraph``, as
    ``--_--id=n``. A null flag counts as false. A line begins with a table's or a figure's word, never both.
    """
    kept = list(lines.columns)
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    sofar, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    f = F.col
    lines = lines.withColumns({n: F.coalesce(f(n), F.lit(False)) for n in FLAGS})
    lines = ahead(lines, f("sparse2") | f("no_words") | f("one_word"), 3, 10, "_table_ahead")
    lines = with_title_ahead(lines)
    remembered = ("space2", "space4", "space12", "space100", "rise2", "rise4", "no_column", "ends_left")
    lines = lines.withColumns({f"_{n}": F.coalesce(F.lag(n).over(order), F.lit(False)) for n in remembered} | {"_first": F.lag("line_idx").over(order).isNull()})
    loose, gap = f("space2") & f("rise2"), f("_space2") & f("_rise2")

    # captions: the last beginning counts until something after it clears it
    cut = f("up20") | f("new_page")
    open_end = f("ends_left") & ~f("ends_in_dot")
    in_table = _or(*map(f, ("sparse2", "no_per_char", "no_words", "few_words", "lower1"))) | open_end
    ends_table, ends_figure = cut | gap & ~in_table, cut | f("taller10") | gap & ~open_end
    below = ~f("near_top")
    begins_table = f("starts_table") & (f("up_and_left") | f("up") & (f("_table_ahead") | below) | f("right") & below | f("_space100") & below & ~f("new_page") | f("_space2") & f("_table_ahead") & ~f("new_page"))
    figure_ahead = F.when(f("narrower20"), f("figure_far")).otherwise(f("figure_near"))
    begins_figure = f("starts_figure") & (f("up_and_left") | (f("up") | f("right") | f("_space100")) & below | figure_ahead)
    begins_again = f("starts_figure") & f("narrower20") & f("_space12")
    lines = lines.withColumns({"_ends_table": ends_table, "_ends_figure": ends_figure, "_again": ends_figure & begins_again, "_opens": F.when(begins_figure, "figure").when(begins_table, "table")})
    lines = lines.withColumn("_open", F.last(F.when(f("_opens").isNotNull(), F.struct("line_idx", f("_opens").alias("kind"))), ignorenulls=True).over(sofar))
    kind = f("_open.kind")
    closes = f("_opens").isNull() & ((kind == "table") & f("_ends_table") | (kind == "figure") & f("_ends_figure") & ~f("_again"))
    lines = lines.withColumn("_closed", F.last(F.when(closes, f("line_idx")), ignorenulls=True).over(sofar))
    lines = lines.withColumn("_goes_on", F.coalesce(f("_open.line_idx") > F.coalesce(f("_closed"), F.lit(-1)), F.lit(False)))
    again = (kind == "figure") & f("_again") & f("_goes_on")
    caption = F.when(f("_opens").isNotNull(), F.concat("_opens", F.lit("-marker-begin"))).when(again, "figure-marker-begin").when(f("_goes_on"), F.concat(kind, F.lit("-marker-inside")))

    # footers: where a line would both begin and end one, it turns the state round
    begins = f("_rise4") & f("starts_enum") & f("near_bottom") & f("lower1")
    live = ~f("is_index_line")
    lines = lines.withColumns({"_caption": caption, "_footer_begins": begins & live, "_turns": F.sum((live & begins & f("up")).cast("long")).over(sofar)})
    lines = lines.withColumn("_set", F.last(F.when(live & (begins != f("up")), F.struct(begins.alias("on"), f("_turns").alias("turns"))), ignorenulls=True).over(sofar))
    on = F.coalesce(f("_set.on"), F.lit(False)) != ((f("_turns") - F.coalesce(f("_set.turns"), F.lit(0))) % 2 == 1)
    lines = lines.withColumn("_on", on)
    was_on = F.coalesce(F.lag("_on").over(order), F.lit(False))
    lines = lines.withColumn("_no_text", f("is_index_line") | was_on & ~f("up") | ~was_on & f("_footer_begins"))

    # section markers: what may be one by itself begins or renews them, what may follow one keeps them
    worded = ~f("no_alphabetic") & f("word_form") & ~f("ends_in_dot")
    looks = _or(f("numbered"), f("all_caps"), f("centered"), f("ends_left") & f("starts_cap") & ~f("tabbed") & ~f("ends_in_dot_and_number"))
    placed = (~f("no_column") | f("title_ahead")) & (loose | f("_space4") | f("taller2") & f("ends_left")) & ~f("wider10")
    by_itself = worded & looks & placed & (f("new_column") | f("no_column") | gap)
    following = worded & ((looks | f("ends_left")) & placed | loose)
    turned = ~f("ends_left") & ~loose  # becomes part of a paragraph
    stays = f("_caption").isNull() & ~f("_no_text") & ~turned
    lines = lines.withColumn("_event", F.when(by_itself & stays, True).when(~(following & stays), False)).withColumn("_marker", F.coalesce(F.last("_event", ignorenulls=True).over(earlier), F.lit(False)))
    section = by_itself | f("_marker") & following
    stray = f("no_column") & _or(f("_first"), *map(f, ("new_page", "new_column", "up_and_left", "_space2", "_no_column", "layout_change", "taller30", "up", "is_index_line")))
    marker = F.when(f("numbered") | f("_marker") & f("_ends_left") & gap, "section-marker-begin").otherwise("section-marker-inside")
    plain = F.when(section, marker).when(~f("layout_change") & stray, "notext").otherwise("text")
    lines = lines.withColumn("_label", F.when(f("_no_text"), "notext").otherwise(F.coalesce("_caption", plain)))
    lines = lines.withColumn("_in_paragraph", (f("_label") == "text") | f("_label").startswith("section") & turned)

    # paragraphs: a line against the last one that was part of any
    formula = f("no_words") & ~f("word_form")
    seen = F.struct(*[f(n) for n in ("ends_in_dot", "ends_in_dot_and_number", "ends_in_colon", "starts_cap", "ends_left", "no_words", "space2", "rise2")], formula.alias("formula"))
    lines = lines.withColumns(
        {
            "_last": F.last(F.when(f("_in_paragraph"), seen), ignorenulls=True).over(earlier),
            "_adjacent": F.coalesce(F.lag("_in_paragraph").over(order), F.lit(False)),
            "_after_section": F.coalesce(F.lag(f("_label").startswith("section") & ~f("_in_paragraph")).over(order), F.lit(False)),
        }
    )
    last = lambda n: F.coalesce(f(f"_last.{n}"), F.lit(False))
    moved = f("new_column") | f("new_page") | f("up_and_left")
    opens = _or(
        f("tabbed") & f("starts_cap") & (f("_last").isNull() | last("ends_in_dot")),
        moved,
        last("ends_left") & (last("ends_in_dot") | last("ends_in_dot_and_number")),
        last("ends_in_colon") & f("no_words"),
        last("no_words") & last("space2") & last("rise2"),
        f("_after_section"),
    )
    carried_over = moved & (~last("ends_in_dot") | ~last("starts_cap") & ~last("ends_left") & ~f("tabbed"))
    after_formula = last("formula") & ~formula & (last("space2") | last("rise2"))
    one_formula = last("formula") & formula
    begins = F.when(opens, ~one_formula).otherwise(after_formula | ~f("_adjacent") & ~f("_first"))
    new = F.when(opens, ~one_formula & ~carried_over).otherwise(after_formula)
    lines = lines.withColumn("_begins", begins).withColumn("paragraph", F.when(f("_in_paragraph"), F.sum((f("_in_paragraph") & new).cast("long")).over(sofar)))
    text = F.when(f("_begins"), F.concat(F.lit("paragraph-begin--_--id="), "paragraph")).otherwise("paragraph-inside")
    return lines.withColumn("label", F.when(f("_in_paragraph"), text).otherwise(f("_label"))).select(*[c for c in kept if c not in ("label", "paragraph")], "label", "paragraph")
