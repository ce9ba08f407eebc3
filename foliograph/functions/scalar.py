"""Scalar text functions as Column expressions. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names looked for in a date, in the order in which they are reported.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Letter groups deleted from text, in the order in which they are looked for.
LIGATURES = ("ffi", "fi", "fl", "ff", "ae", "oe", "ll")
_HOLE = "@~@"
#: Extensions that name a derived file rather than the document.
EXTENSIONS = ("xml", "refs", "gz", "pdf", "ps", "meta", "tagged", "txt", "html")


def without_ligatures(text: Column) -> Column:
    """Delete ligature letter groups one after the other; a deletion never makes a new group."""
    for group in LIGATURES:
        text = F.replace(text, F.lit(group), F.lit(_HOLE))
    return F.replace(text, F.lit(_HOLE), F.lit(""))


def trimmed_to_alphanumeric(text: Column) -> Column:
    """Cut what is not an ASCII letter or digit from both ends, and a leading or trailing lone ``fl``."""
    text = F.regexp_replace(F.regexp_replace(text, "^fl ", "   "), " fl$", "   ")
    return F.regexp_replace(F.regexp_replace(text, "^[^A-Za-z0-9]+", ""), "[^A-Za-z0-9]+$", "")


def without_edge_punctuation(text: Column) -> Column:
    """Drop one punctuation character at each end; an opening bracket may lead and a closing one may trail."""
    head = F.when(F.startswith(text, F.lit("(")), text).otherwise(F.regexp_replace(text, r"^\p{Punct}", ""))
    return F.when(F.endswith(head, F.lit(")")), head).otherwise(F.regexp_replace(head, r"\p{Punct}$", ""))


def normalised_year(text: Column) -> Column:
    """Four digits for ``'97`` or ``-03``; of anything else its digits."""
    century = F.when(F.substring(text, 2, 1) == "0", "20").otherwise("19")
    return F.when(text.rlike("^['-]"), F.regexp_replace(text, F.lit("['-]"), century)).otherwise(F.regexp_replace(text, "[^0-9]+", ""))


def parsed_date(text: Column, this_year: int) -> Column:
    """``year=YYYY`` of the first plausible year and ``month=Mon`` of every month named, joined by ``%%``."""
    years = F.transform(
        F.regexp_extract_all(text, F.lit("(?:[12][0-9]{3}|'[0-9]{2})"), F.lit(0)),
        lambda y: F.when(F.startswith(y, F.lit("'")), F.concat(F.when(F.substring(y, 2, 1) == "0", "20").otherwise("19"), F.substring(y, 2, 2))).otherwise(y),
    )
    year = F.get(F.filter(years, lambda y: (y.cast("int") > 1700) & (y.cast("int") <= this_year)), F.lit(0))
    parts = [F.when(year.isNotNull(), F.concat(F.lit("year="), year))]
    parts += [F.when(F.contains(F.lower(text), F.lit(m.lower())), F.lit(f"month={m}")) for m in MONTHS]
    return F.when(text.isNotNull(), F.concat_ws("%%", *parts))


def sha1_hex(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in upper-case hexadecimal."""
    return F.upper(F.sha1(text.cast("binary")))


def significant_letter(host: Column) -> Column:
    """The letter under which a host is filed: of the organisation's label, however deep the country code puts it."""
    bits = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    label = lambda k: F.get(bits, F.lit(k))
    deeper = (F.length(label(0)) == 2) & (F.size(bits) > 2) & (F.length(label(2)) >= F.length(label(1))) & (label(0) != "edu")
    return F.when(F.size(bits) < 2, "?").otherwise(F.substring(F.when(deeper, label(2)).otherwise(label(1)), 1, 1))


def mangled_url(url: Column) -> Column:
    """letter/host/url with slashes turned into backslashes."""
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    return F.concat_ws("/", significant_letter(host), host, F.replace(url, F.lit("/"), F.lit("\\")))


def demangled_url(path: Column) -> Column:
    """The URL of the last part of a mangled path."""
    return F.replace(F.substring_index(path, "/", -1), F.lit("\\"), F.lit("/"))


def corpus_name(path: Column) -> Column:
    """The file name of a path without its known extensions."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(\.(" + "|".join(EXTENSIONS) + "))+$", "")


def clean_name(text: Column) -> Column:
    """The first run of letters, hyphens, dots and blanks, trimmed."""
    return F.trim(F.regexp_extract(text, "[a-zA-Z. -]+", 0))


def full_name(first: Column, middle: Column, last: Column, style: str = "header") -> Column:
    """``First Middle Last`` or, in style ``reference``, ``Last F. M.``."""
    if style == "reference":
        initial = lambda x, end: F.when(F.length(x) > 0, F.concat(F.substring(x, 1, 1), F.lit(end))).otherwise("")
        return F.concat(last, F.lit(" "), initial(first, ". "), initial(middle, "."))
    return F.concat(first, F.lit(" "), middle, F.when(middle != "", " ").otherwise(""), last)


def email_user(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(0))


def email_domain(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(1))


def stripped(text: Column) -> Column:
    """Cut separators, brackets and white space from both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[,;. \t\r\n()\[\]]+", ""), r"[,;. \t\r\n()\[\]]+$", "")


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[(),.;\[\]]", "")


def elapsed(milliseconds: Column) -> Column:
    """Hours:minutes:seconds.milliseconds."""
    whole = milliseconds.cast("long")
    part = lambda by, of: F.lpad((F.floor(whole / by) % of).cast("string"), 2, "0")
    return F.concat(F.floor(whole / 3_600_000).cast("string"), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))


def text_after(text: Column, pattern: str) -> Column:
    """The text from the first match of a pattern on; empty where there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")


def indel_distance(left: Column, right: Column) -> Column:
    """Edit distance in which a substitution costs two: len + len - 2 * longest common subsequence.

    The subsequence is a fold over one text with the row of the other as state.
    """
    letters = lambda x: F.array_remove(F.split(x, ""), "")
    chars = letters(right)
    row = F.transform(F.concat(F.array(F.lit("")), chars), lambda _: F.lit(0))

    def step(before: Column, c: Column) -> Column:
        def cell(done: Column, x: Column) -> Column:
            k = F.size(done)
            best = F.when(x == c, F.get(before, k - 1) + 1).otherwise(F.greatest(F.get(before, k), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        return F.aggregate(chars, F.array(F.lit(0)), cell)

    common = F.aggregate(letters(left), row, step, lambda x: F.element_at(x, -1))
    common = F.when((F.length(left) == 0) | (F.length(right) == 0), F.lit(0)).otherwise(common)
    return F.length(left) + F.length(right) - 2 * common
