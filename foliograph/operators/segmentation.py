"""Papers into header, body and references, by line patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of headings, and what may number them.
BIBLIOGRAPHY = ("References", "Bibliography", "References and Notes", "Literature Cited", "Acknowledgements")
PLAIN_BIBLIOGRAPHY = ("References", "REFERENCES", "Bibliography", "BIBLIOGRAPHY")
OPENINGS = ("introduction", "background")
NUMBERING = "#iIvVxX.0123456789"
_WHITE = " \t\n\x0b\f\r"


def is_introduction(text: Column) -> Column:
    """A line that begins with the word, its first letter a capital, behind nothing but numbering."""
    at = F.instr(F.lower(text), "introduction")
    before = F.substring(text, F.lit(1), at - 1)
    return (at > 0) & (F.substring(text, at, F.lit(1)) == "I") & (F.translate(before, NUMBERING + _WHITE, "") == "")


def is_abstract(text: Column) -> Column:
    """A line that begins with the word, capital, or is the word alone."""
    line = F.ltrim(text, F.lit(_WHITE))
    return F.startswith(F.lower(line), F.lit("abstract")) & F.startswith(line, F.lit("A")) | (F.rtrim(line, F.lit(_WHITE)) == "abstract")


def is_bibliography(text: Column, most: int = 5) -> Column:
    """A line that is a heading of references, its first letter a capital, behind up to ``most`` marks of numbering."""
    rest = F.ltrim(text, F.lit(NUMBERING + _WHITE))
    core = F.rtrim(rest, F.lit(_WHITE))
    return F.lower(core).isin([w.lower() for w in BIBLIOGRAPHY]) & F.substring(core, 1, 1).isin("A", "B", "L", "R") & (F.length(text) - F.length(rest) <= most)


def _where(test: Column) -> Column:
    return F.when(test, F.col("line_idx"))


def _matches(pattern: str) -> Column:
    return F.col("text").rlike(pattern)


def sections(lines: DataFrame) -> DataFrame:
    """Line ranges (stop not included) of header and body and the start of the references.

    The header is what stands before an abstract, and the abstract up to the introduction or
    the end of the abstract's page; without an abstract, what stands before the introduction.
    An abstract on line 0 is none. The body ends at the last bibliography heading. A document
    without a header or a body has an ``error``.
    """
    marks = lines.groupBy("doc_id").agg(
        F.min(_where(is_abstract(F.col("text")))).alias("abstract"),
        F.min(_where(is_introduction(F.col("text")))).alias("introduction"),
        F.max(_where(is_bibliography(F.col("text")))).alias("bibliography"),
        (F.max("line_idx") + 1).alias("n_lines"),
    )
    abstract = F.when(F.col("abstract") > 0, F.col("abstract"))
    paged = lines.join(marks.select("doc_id", abstract.alias("_at")).filter("_at is not null"), "doc_id")
    page = paged.filter("line_idx = _at").select("doc_id", F.col("page").alias("_page"))
    after = paged.join(page, "doc_id").filter(F.col("line_idx") > F.col("_at")).groupBy("doc_id").agg(F.min(F.when(F.col("page") > F.col("_page"), F.col("line_idx"))).alias("_next_page"), F.min(_where(is_introduction(F.col("text")))).alias("_next_intro"))
    stop = F.when(abstract.isNotNull(), F.coalesce(F.least("_next_page", "_next_intro"), "n_lines")).when(F.col("introduction") > 0, F.col("introduction"))
    body = F.when(F.col("bibliography") > 0, F.col("bibliography"))
    error = F.when(stop.isNull(), "header not found").when(body.isNull(), "references not found")
    return marks.join(after, "doc_id", "left").select("doc_id", stop.alias("header_stop"), body.alias("body_stop"), "n_lines", error.alias("error"))


def journal_abstract(lines: DataFrame, skip: int = 10, indent: int = 20) -> DataFrame:
    """The first line after ``skip`` lines that starts more than ``indent`` left of the mean so far."""
    before = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    hit = lines.withColumn("_mean", F.avg("llx").over(before)).filter((F.col("line_idx") > skip) & (F.col("llx") < F.col("_mean") - indent))
    return hit.groupBy("doc_id").agg(F.min("line_idx").alias("line_idx"))


def rule_labels(lines: DataFrame) -> DataFrame:
    """Bibliography labels by rule: heading, junk, begin of a reference, inside of one. ``lines`` has possible_init and ignored."""
    label = F.when(F.upper("text").rlike("^[^A-Z]*REFERENCES[^A-Z]*$"), "biblioPrologue").when(F.col("ignored"), "junk").when(F.col("possible_init"), "biblio-B").otherwise("biblio-I")
    return lines.withColumn("label", label)


def references(labelled: DataFrame) -> DataFrame:
    """References from labelled lines: their number, first and last line and text. Inside lines before any begin are dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    number = F.sum((F.col("label") == "biblio-B").cast("long")).over(order)
    lines = labelled.withColumn("ref_no", number).filter(F.col("label").isin("biblio-B", "biblio-I") & (F.col("ref_no") > 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc_id", "ref_no").agg(F.min("line_idx").alias("first_line"), F.max("line_idx").alias("last_line"), text.alias("text"))


def oversized(refs: DataFrame, most: int = 3200) -> DataFrame:
    """How many references of each document are too long: none, one or several."""
    counted = refs.groupBy("doc_id").agg(F.count("*").alias("n_refs"), F.sum((F.length("text") > most).cast("long")).alias("n_long"))
    return counted.withColumn("verdict", F.when(F.col("n_long") == 0, "ok").when(F.col("n_long") == 1, "one too long").otherwise("several too long"))


def _numbered(text: Column) -> tuple[Column, Column, Column]:
    """The first word of a line and the rest, and whether that word is a number: a digit or capital letters I, with periods behind, or a digit with ``.0``."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.substring_index(line, " ", 1)
    base = F.rtrim(first, F.lit("."))
    number = base.rlike("^[0-9]$") | (F.translate(base, "I", "") == "") & (base != "") | (F.length(first) == 3) & F.endswith(first, F.lit(".0")) & first.rlike("^[0-9]")
    return line, F.ltrim(F.substring(line, F.length(first) + 1, F.length(line))), number


def is_opening(text: Column) -> Column:
    """A line that begins with a word of ``OPENINGS``, numbered or not, in any case."""
    line, rest, number = _numbered(F.upper(text))
    begins = lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(w.upper())) for w in OPENINGS])
    return begins(line) | number & begins(rest)


def is_numbered_heading(text: Column) -> Column:
    """A numbered line that goes on with a capital word."""
    _, rest, number = _numbered(text)
    return number & rest.rlike("^[A-Z][a-z]")


def ends_in_bibliography(text: Column) -> Column:
    """A line whose last word is a heading of references, with or without a colon and a period behind."""
    line = F.rtrim(text, F.lit(_WHITE))
    without = lambda x, mark: F.when(F.endswith(x, F.lit(mark)), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    core = without(without(line, "."), ":")
    return reduce(lambda a, b: a | b, [F.endswith(core, F.lit(w)) for w in PLAIN_BIBLIOGRAPHY])


def older_sections(lines: DataFrame) -> DataFrame:
    """Header and body of papers by headings alone: the first strict introduction ends the header, else the first numbered heading; the first reference heading from there on ends the body."""
    starts = lines.groupBy("doc_id").agg(F.min(_where(is_opening(F.col("text")))).alias("strict"), F.min(_where(is_numbered_heading(F.col("text")))).alias("lenient"))
    found = starts.select("doc_id", F.coalesce("strict", "lenient").alias("header_stop"), (F.col("strict").isNull() & F.col("lenient").isNotNull()).alias("is_lenient"))
    ends = lines.join(found.filter("header_stop is not null"), "doc_id").filter(F.col("line_idx") >= F.col("header_stop")).groupBy("doc_id").agg(F.min(_where(ends_in_bibliography(F.col("text")))).alias("body_stop"))
    error = F.when(F.col("header_stop").isNull(), "introduction not found").when(F.col("body_stop").isNull(), "references not found")
    return found.join(ends, "doc_id", "left").withColumn("error", error)


def matching_lines(lines: DataFrame, begin: str, end: str, most_lines: int | None = None) -> DataFrame:
    """Lines from the first that matches ``begin`` to before the first after it that matches ``end``; none without an end. ``most_lines`` bounds how far the end may be."""
    starts = lines.groupBy("doc_id").agg(F.min(_where(_matches(begin))).alias("_start")).filter("_start is not null")
    after = lines.join(starts, "doc_id").filter(F.col("line_idx") > F.col("_start"))
    if most_lines is not None:
        after = after.filter(F.col("line_idx") <= F.col("_start") + most_lines)
    stops = after.groupBy("doc_id").agg(F.min("_start").alias("_start"), F.min(_where(_matches(end))).alias("_stop")).filter("_stop is not null")
    return lines.join(stops, "doc_id").filter((F.col("line_idx") >= F.col("_start")) & (F.col("line_idx") < F.col("_stop"))).drop("_start", "_stop")


def bibliography_parts(labelled: DataFrame) -> DataFrame:
    """Labelled lines as parts: prologue (its label, or what precedes all references), numbered references, epilogue (what follows a ``post`` line). Junk and inside lines before any beginning are in none."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    number = F.sum((F.col("label") == "biblio-B").cast("long")).over(order)
    after = F.max(F.col("label") == "post").over(order)
    part = F.when(F.col("_after"), "epilogue").when(F.col("label") == "biblioPrologue", "prologue").when(F.col("label").isin("biblio-B", "biblio-I") & (F.col("ref_no") > 0), "reference")
    numbered = labelled.withColumns({"ref_no": number, "_after": after}).withColumn("part", part)
    return numbered.filter("part is not null").withColumn("ref_no", F.when(F.col("part") == "reference", F.col("ref_no"))).drop("_after")


def cut_at(lines: DataFrame, hint: Column) -> DataFrame:
    """Lines with ``ref_no``: each hint starts a reference; lines before the first are in none."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    return lines.withColumn("ref_no", F.sum(hint.cast("long")).over(order)).filter("ref_no > 0")


def reference_statistics(labelled: DataFrame, junk: int = 5) -> DataFrame:
    """What is suspicious about references: continuation lines that stand differently, more than ``junk`` junk lines in a row after one, and how often the left margin changes inside."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    lines = labelled.withColumn("ref_no", F.sum((F.col("label") == "biblio-B").cast("long")).over(order)).filter("ref_no > 0")
    inside = Window.partitionBy("doc_id", "ref_no").orderBy("line_idx")
    is_junk = F.col("label") == "junk"
    runs = lines.withColumn("_run", F.sum((~is_junk).cast("long")).over(inside)).withColumn("_junk", F.sum(is_junk.cast("long")).over(Window.partitionBy("doc_id", "ref_no", "_run")))
    step = F.when(F.col("label") == "biblio-I", F.signum(F.col("llx") - F.first("llx").over(inside)))
    moved = ~is_junk & (F.lag("llx").over(inside) != F.col("llx"))
    seen = runs.withColumn("_step", step).withColumn("_moved", F.coalesce(moved, F.lit(False)))
    return seen.groupBy("doc_id", "ref_no").agg((F.min("_step") != F.max("_step")).alias("mixed"), (F.max("_junk") > junk).alias("much_junk"), F.sum(F.col("_moved").cast("long")).alias("margin_changes")).withColumn("mixed", F.coalesce("mixed", F.lit(False)))


def oversized_headers(lines: DataFrame, found: DataFrame, most: int = 20_000) -> DataFrame:
    """Headers of more than ``most`` characters, by the sections found."""
    sizes = lines.join(found.filter("header_stop is not null").select("doc_id", "header_stop"), "doc_id").filter(F.col("line_idx") < F.col("header_stop")).groupBy("doc_id").agg(F.sum(F.length("text") + 1).alias("n_chars"))
    return sizes.filter(F.col("n_chars") > most)


def _before_year(line: Column) -> Column:
    """What stands before the first number of a line, if that has four digits at least; else nothing."""
    return F.regexp_extract(line, "^([^0-9]+)[0-9]{4}", 1)


def _pieces(names: Column) -> Column:
    """Parts between commas; all but the first must begin with white space, else there are none."""
    parts = F.split(names, ",")
    apart = F.forall(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.rlike(r"^\s"))
    return F.when(apart, F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))).otherwise(F.array().cast("array<string>"))


def _all(parts: Column, test) -> Column:
    return (F.size(parts) > 0) & F.forall(parts, test)


def _surname_first(line: Column) -> Column:
    """Surnames with initials, a comma behind each, then a year."""
    head = F.rtrim(_before_year(line), F.lit(_WHITE))
    names = _pieces(F.substring(head, F.lit(1), F.length(head) - 1))
    initials = lambda w: F.forall(F.slice(w, F.lit(2), F.size(w)), lambda x: F.translate(x, ".", "").rlike("^[A-Z]+$") & x.rlike("^[A-Z]"))
    one = lambda w: (F.size(w) > 1) & w[0].rlike(r"^[A-Z]\w+$") & initials(w)
    return F.endswith(head, F.lit(",")) & (F.length(head) < F.length(_before_year(line))) & _all(names, lambda x: one(F.split(x, " ")))


def _full_names(line: Column) -> Column:
    """Up to six capital words or initials for each name, commas between, a period, a year and a period."""
    head = F.rtrim(_before_year(line), F.lit(_WHITE))
    names = F.transform(_pieces(F.substring(head, F.lit(1), F.length(head) - 1)), lambda x: F.regexp_replace(x, "^and ", ""))
    words = lambda x: F.split(F.trim(F.regexp_replace(x, r"\.\s*", ". ")), " ")
    one = lambda w: (F.size(w) <= 6) & F.forall(w, lambda x: x.rlike(r"^[A-Z](\.|\w+)$"))
    after = F.substring(line, F.length(_before_year(line)) + 5, F.lit(1))
    return F.endswith(head, F.lit(".")) & (F.length(head) < F.length(_before_year(line))) & (after == ".") & _all(names, lambda x: one(words(x)))


def _names_in_turn(line: Column) -> Column:
    """Surnames, each with its initials behind, joined by commas, and, &; then a year that may stand in parentheses."""
    head = F.regexp_replace(_before_year(line), r"\($", "")
    kind = lambda w: (
        F.when(w.isin("and", "&"), "+").when(w.rlike(r"^[A-Z]\.(-?[A-Z]\.)*$"), "i").when(w.rlike(r"^[A-Z]\.(-?[A-Z]\.)*,$"), "j").when(w.rlike(r"^[A-Z][\w-]+,?$"), "S").otherwise("?")
    )
    shape = F.array_join(F.transform(F.split(F.trim(F.regexp_replace(head, r"\s+", " ")), " "), kind), "")
    return head.rlike(r"\s$") & shape.rlike("^(Si*[ij][+]*)*Si+$")


def reference_start_kinds(text: Column) -> list[Column]:
    """How a reference may begin: with a bracket, authors and year in three forms, a number with a parenthesis, a number with a period."""
    line = F.ltrim(text, F.lit(_WHITE))
    number, rest = F.substring_index(line, ")", 1), F.substring(line, F.length(F.substring_index(line, ")", 1)) + 2, F.length(line))
    first = F.substring_index(line, ".", 1)
    return [
        F.startswith(line, F.lit("[")) & (F.instr(line, "]") > 2),
        _surname_first(line),
        _full_names(line),
        _names_in_turn(line),
        number.rlike("^[0-9]+$") & rest.rlike(r"^\s+[A-Z]"),
        first.rlike("^[0-9]{1,3}$") & (F.length(line) > F.length(first) + 1),
    ]


#: The kind that is numbered with periods.
_NUMBERED = 6


def reference_starts(lines: DataFrame, budget: int = 3200) -> DataFrame:
    """Lines that begin references, by the first pattern that the document's first line has: doc_id, line_idx, style (from 1).

    Numbers with a period must go up by one to three from the one before; others are no
    beginnings. Nothing counts after more than ``budget`` characters without a beginning.
    """
    first = F.min_by("text", "line_idx")
    style = F.coalesce(*[F.when(c, k + 1) for k, c in enumerate(reference_start_kinds(F.col("_first")))])
    chosen = lines.groupBy("doc_id").agg(first.alias("_first")).select("doc_id", style.alias("style")).filter("style is not null")
    hit = F.coalesce(*[F.when(F.col("style") == k + 1, c) for k, c in enumerate(reference_start_kinds(F.col("text")))])
    before = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(chosen, "doc_id").withColumn("_at", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    hits = placed.filter(hit).select("doc_id", "style", "line_idx", "_at", F.when(F.col("style") == _NUMBERED, F.regexp_extract("text", r"^\s*([0-9]{1,3})\.", 1).try_cast("int")).alias("_number"))
    # numbers that go on from the last accepted: a fold over a document's candidates
    listed = hits.groupBy("doc_id", "style").agg(F.array_sort(F.collect_list(F.struct("line_idx", "_at", "_number"))).alias("_hits"))
    state = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def goes_on(s: Column, x: Column) -> Column:
        step = x["_number"] - s["last"]
        taken = x["_number"].isNull() | s["last"].isNull() | step.between(1, 3)
        return F.struct(F.when(taken, x["_number"]).otherwise(s["last"]).alias("last"), F.when(taken, F.concat(s["out"], F.array(x["line_idx"].cast("bigint")))).otherwise(s["out"]).alias("out"))

    kept = F.when(F.col("style") == _NUMBERED, F.aggregate("_hits", state, goes_on, lambda s: s["out"])).otherwise(F.transform("_hits", lambda x: x["line_idx"].cast("bigint")))
    accepted = listed.select("doc_id", "style", F.explode(kept).alias("line_idx")).join(placed.select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), "_at"), ["doc_id", "line_idx"])
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    late = F.coalesce(F.col("_at") - F.lag("_at").over(order) > budget, F.lit(False))
    return accepted.withColumn("_late", late).withColumn("_ended", F.max("_late").over(order)).filter(~F.col("_ended")).select("doc_id", "line_idx", "style")
