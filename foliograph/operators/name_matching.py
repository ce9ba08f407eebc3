"""E-mail strings cut into addresses, and how addresses go with authors' names, by rungs from exact to near.

All of it is expressions on rows and on a document's short lists of names; authors and addresses
of a document meet in a join by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.scalar import indel_distance
from foliograph.operators.by_document import dealt

#: Top-level domains of more than two letters; any two letters are a country's.
TOP_LEVEL = ("com", "edu", "org", "net", "gov", "mil", "int", "info", "biz", "name", "museum", "aero", "coop", "pro", "jobs", "mobi", "travel", "cat", "arpa")
#: What stands for any sign between the parts of a name.
_SIGN = "·"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\W", _SIGN)


def _forms(part: Column) -> Column:
    """A part of a name, whole and as its first letter."""
    return F.array_distinct(F.array(part, F.substring(part, 1, 1)))


def _joined(left: Column, right: Column, sign: bool = True) -> Column:
    """Each of the left before each of the right, with and without a sign between."""
    pair = lambda x, y: F.array(F.concat(x, y), F.concat(x, F.lit(_SIGN), y)) if sign else F.array(F.concat(x, y))
    return F.flatten(F.transform(left, lambda x: F.flatten(F.transform(right, lambda y: pair(x, y)))))


def exact_forms(first: Column, middle: Column, last: Column) -> Column:
    """The user names that are made of the parts of a name, whole or as initials: one, first before last with a sign or none between (a middle name may stand there), last before first."""
    first, middle, last = (_plain(x) for x in (first, middle, last))
    f, m, l = _forms(first), _forms(middle), _forms(last)  # noqa: E741
    short = F.concat(f, l, _joined(f, l), _joined(l, f, False))
    with_middle = _joined(f, m)
    long = F.concat(m, with_middle, _joined(with_middle, l), _joined(_joined(l, f, False), m, False))
    return F.when(middle != "", F.concat(short, long)).otherwise(short)


def is_exact(first: Column, middle: Column, last: Column, user: Column) -> Column:
    """Whether a user name is one of the ``exact_forms`` of a name."""
    return F.array_contains(exact_forms(first, middle, last), _plain(user))


def guesses_middle(first: Column, middle: Column, last: Column, user: Column) -> Column:
    """Whether, for an author without one, a letter in a user name may be a middle initial: between first and last, or behind last and first."""
    user, first, last = _plain(user), _plain(first), _plain(last)
    more = lambda f, x: F.length(user) - F.length(f) - F.length(x)
    between = lambda f, x: F.startswith(user, f) & F.endswith(user, x) & (more(f, x) > 0) & F.substring(user, F.length(f) + 1, F.greatest(more(f, x), F.lit(0))).rlike(f"^{_SIGN}?.{_SIGN}?$")
    behind = lambda f, x: F.startswith(user, F.concat(x, f)) & (more(f, x) == 1)
    some = F.exists(_forms(first), lambda f: F.exists(_forms(last), lambda x: between(f, x) | behind(f, x)))
    return (F.coalesce(middle, F.lit("")) == "") & some


def holds_part(first: Column, middle: Column, last: Column, user: Column) -> Column:
    """Whether a user name holds a part of a name of two letters or more; a name without such parts is held by any."""
    parts = F.filter(F.array(*[F.lower(F.coalesce(x, F.lit(""))) for x in (first, middle, last)]), lambda x: F.length(x) > 1)
    return (F.size(parts) == 0) | F.exists(parts, lambda x: F.contains(F.lower(user), x))


def distance(first: Column, middle: Column, last: Column, user: Column, below: int | None = None) -> Column:
    """The least edit distance, substitutions at two, of a user name to the names it may be made of; with ``below`` names that differ by as much in length are not looked at, and null stands for none."""
    f, m, l = (F.lower(F.coalesce(x, F.lit(""))) for x in (first, middle, last))  # noqa: E741
    one = lambda x: F.substring(x, 1, 1)
    names = F.array(F.concat(f, m, l), F.concat(l, f, m), f, l, F.concat(one(f), l), F.concat(l, one(f)), F.concat(f, one(l)), F.concat(one(l), f))
    some = F.array_distinct(names)
    if below is not None:
        some = F.filter(some, lambda x: F.abs(F.length(x) - F.length(user)) < below)
    return F.array_min(F.transform(some, lambda x: indel_distance(x, F.lower(user))))


def match_kind(first: Column, middle: Column, last: Column, user: Column, near: int = 4, forms: Column | None = None) -> Column:
    """EXACT, MIDDLE_GUESS, NAME_SUBSTRING_MATCH, or LEVEN with a distance below ``near``; null for no match. ``forms`` are the name's exact forms where they are known."""
    name = (first, middle, last, user)
    # one distance for the test and for the name of the rung
    leven = F.get(F.transform(F.array(distance(*name, below=near)), lambda d: F.when(d < near, F.concat(F.lit("LEVEN"), d))), F.lit(0))
    return (
        F.when(is_exact(*name) if forms is None else F.array_contains(forms, _plain(user)), "EXACT")
        .when(guesses_middle(*name), "MIDDLE_GUESS")
        .when(holds_part(*name), "NAME_SUBSTRING_MATCH")
        .otherwise(leven)
    )


def matches(authors: DataFrame, emails: DataFrame) -> DataFrame:
    """Pairs of authors (doc_id, author_no, first, middle, last) and addresses (doc_id, email_no, name, domain) of a document that match: their ``kind``, and whether they have the same place in their lists."""
    # the forms of a name are made once for an author, behind the shuffle, and the rung of a pair once, where a filter on it would be a second time
    formed = dealt(authors, "doc_id").withColumn("_forms", exact_forms(F.col("first"), F.col("middle"), F.col("last")))
    kind = match_kind(F.col("first"), F.col("middle"), F.col("last"), F.col("name"), forms=F.col("_forms"))
    pairs = formed.join(emails, "doc_id").select("doc_id", "author_no", "email_no", "name", "domain", F.explode(F.array_compact(F.array(kind))).alias("kind"))
    return pairs.withColumn("same_position", F.col("author_no") == F.col("email_no"))


def _people(names: Column) -> Column:
    return F.filter(F.split(F.translate(names, ",|;", "   "), " +"), lambda x: x != "")


def segmented(raw: DataFrame, authors: DataFrame, top_level: tuple[str, ...] = TOP_LEVEL) -> DataFrame:
    """Addresses of strings (doc_id, email_ref, raw) as they are printed: doc_id, email_no (from 0, in order), email_ref, name, domain.

    Words up to the last "mail" go. What stands before each domain are user names, between commas,
    bars, semicolons or blanks; brackets go. Brackets misread as 1 and 2, or f and g, go too, if more
    of the names then match authors exactly. Null strings and strings without a domain give none.
    """
    domain = r"(?i)([^@]*)(@(?:[\w-]+\.)+(?:[a-z]{2}|" + "|".join(top_level) + r"))(?=\W|$)"
    text = F.regexp_replace("raw", r"(?i)^.*mails?\W+", "")
    each = raw.select("doc_id", "email_ref", F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(domain), F.lit(1)).alias("names"), F.regexp_extract_all(text, F.lit(domain), F.lit(2)).alias("domain"))).alias("k", "c"))
    each = each.select("doc_id", "email_ref", "k", F.regexp_replace(F.translate("c.names", "{}()[]#<", ""), r"^\W+", "").alias("names"), F.col("c.domain").alias("domain"))
    listed = authors.groupBy("doc_id").agg(F.collect_list(exact_forms(F.col("first"), F.col("middle"), F.col("last"))).alias("authors"))
    exact = lambda names: F.aggregate(
        _people(names), F.lit(0), lambda n, p: n + F.size(F.filter("authors", lambda forms: F.array_contains(forms, _plain(p))))
    )
    misread = reduce(lambda a, b: a | b, [F.col("names").rlike(p) for p in ("^1.*2$", "^f.*[ ,].*g$")])
    within = F.substring("names", F.lit(2), F.length("names") - 2)
    mended = F.when(misread & F.col("authors").isNotNull(), F.when(exact(within) > exact(F.col("names")), within).otherwise(F.col("names"))).otherwise(F.col("names"))
    people = each.join(listed, "doc_id", "left").select("doc_id", "email_ref", "k", "domain", F.posexplode(_people(mended)).alias("p", "name"))
    order = Window.partitionBy("doc_id").orderBy("email_ref", "k", "p")
    return people.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("email_no"), "email_ref", "name", "domain")
