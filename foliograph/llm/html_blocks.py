"""HTML extraction by line-block distribution.

A page is turned into lines, one for each block of text: tags end blocks or vanish, scripts,
styles and comments are stripped, character references are decoded. A line weighs the length
of its text, where outside of ``article`` and ``main`` text in links does not count. Markup can only lower that weight:

* blocks that a class, id or role names as no article text (adverts, notices, reader comments
  and the like), and lines below a heading such as "Comments" outside of an article, weigh nothing;
* lines of ``nav``, ``footer``, ``aside``, ``form``, ``menu`` and of a page's ``header`` weigh a twentieth.

The distribution is the sum of weights over a sliding window of lines that are not lowered. A stretch of windows that
are not empty is text if one of them reaches ``share`` of the page's mean weight of a line: the text surges at its
beginning and dives where the sums fall to nothing. So short lines beside long ones are text, at the edges too, and
short lines that stand by themselves, among links and notices, are not. A stretch is cut to its first and last line that
weigh anything, and, where ``article`` or ``main`` begins or ends within a window of such an edge, to that
place. Between these every line is kept, however short, but for lines that markup lowered. A page whose text is all in
forms, which may wrap whole pages, is judged by its lowered weights.

A null, empty or text-free page gives an empty text. A page cut off in the middle of a tag
or reference gives the text before it. A quote that is never closed is a character like
others. Each repeated row is extracted on its own. Pages are worked on row by row, in time
linear in their length: no shuffle, and no page is shortened.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_INSIDE = re.compile(r"[^>=]*+")
_VALUE = re.compile(r"=\s*+")
_NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Their content is not markup.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
_DROPPED = {"head", "dialog", "select", "button", "fieldset", "map"}
_LOWERED = {"nav", "footer", "aside", "form", "menu", "header"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_INNER = {"article", "main"}
#: What these hold ends at the next tag of the set.
_UNCLOSED = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_ENDS = _UNCLOSED | _HEADINGS | _INNER | {"div", "section", "ul", "ol", "table", "pre", "blockquote", "header", "footer", "nav", "aside", "form", "body"}
#: Names (class, id, role) of what is not article text.
_MARKS = {
    "byline", "rating", "ratings", "tags", "thread", "toc", "voices",
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "disclaimer", "dialog", "feedback", "footer", "form", "gdpr", "header", "hidden", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
#: Words of layout that may stand beside a mark in one name, as in ``site-header``; any other word makes it another name.
_LAYOUT = {"discussion", "area", "bar", "block", "bottom", "box", "container", "global", "group", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "primary", "reader", "right", "secondary", "section", "site", "slot", "text", "top", "user", "wrap", "wrapper"}
#: Words of a heading that opens what follows an article, and words that may stand beside them.
_CLOSERS = {"comment", "comments", "discussion", "recommended", "related", "replies", "reply", "responses"}
_SMALL = {"a", "and", "article", "articles", "by", "for", "from", "leave", "more", "on", "our", "post", "posts", "reader", "readers", "s", "stories", "the", "this", "to", "your"}
_LETTERS = re.compile(r"[^\W\d_]+")
_PIECES = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    text: str
    plain: int = 0  # length without link text
    inside: bool = False  # in article or main
    low: bool = False  # of an element that seldom holds article text
    form: bool = False  # lowered by forms alone


def is_mark(name: str) -> bool:
    """Whether a whole class, id or role names what is not article text: a mark, alone or with words of layout."""
    pieces = [x for x in _PIECES.findall(_CAMEL.sub("-", name).lower()) if not x.isdigit()]
    return any(x in _MARKS for x in pieces) and all(x in _MARKS or x in _LAYOUT for x in pieces)


def is_closer(heading: str) -> bool:
    """Whether a heading opens what follows an article, such as the readers' comments."""
    words = _LETTERS.findall(heading.lower())
    return any(x in _CLOSERS for x in words) and all(x in _CLOSERS or x in _LAYOUT or x in _SMALL for x in words)


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _DROPPED:
        return True
    if tag in ("html", "body") or tag in _INNER and not inside or not attributes:
        return False
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role"):
            if any(is_mark(x) and not (inside and x.lower() == "header") for x in value.split()):
                return True
    return False


class _Tags:
    """Reads the tags of a page in order; a failed look for a closing quote is not repeated."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, {"'": len(page), '"': len(page)}

    def end(self, at: int) -> int:
        """Where the tag that goes on at ``at`` ends. Quotes hide what they hold only where a value begins."""
        page, size = self.page, len(self.page)
        while True:
            at = _INSIDE.match(page, at).end()
            if at >= size:
                return size
            if page[at] == ">":
                return at + 1
            at = _VALUE.match(page, at).end()
            quote = page[at : at + 1]
            if quote in self.unclosed and quote and at < self.unclosed[quote]:
                close = page.find(quote, at + 1)
                if close < 0:
                    self.unclosed[quote] = at
                else:
                    at = close + 1

    def after(self, at: int, mark: str) -> int:
        found = self.page.find(mark, at)
        return len(self.page) if found < 0 else found + len(mark)


def lines_of(page: str | None) -> list[Line]:
    """The lines of a page; a block that is not article text is a line without text."""
    page = page or ""
    tags = _Tags(page)
    lines: list[Line] = []
    text: list[str] = []
    links: list[str] = []
    inside = linked = heading = closed = at = 0
    dropped: list[str] = []  # open tags below one that is left out, that one first
    below: Counter = Counter()
    lowered: Counter = Counter()  # open tags that lower what they hold
    skipped = False  # text of a block was left out since the last line

    def end_line() -> None:
        nonlocal closed, skipped
        body = " ".join(html.unescape("".join(text)).split())
        if body:
            if heading and not inside and (not closed or heading <= closed):
                closed = heading if is_closer(body) else 0
            plain = len(body) - (0 if inside else len(" ".join(html.unescape("".join(links)).split())))
            low = lowered.total()
            lines.append(Line("") if closed and not inside else Line(body, plain, inside > 0, low > 0, low == lowered["form"]))
        if skipped:
            lines.append(Line("", inside=inside > 0))
            skipped = False
        text.clear()
        links.clear()

    def say(part: str) -> None:
        nonlocal skipped
        if dropped:
            skipped |= dropped[0] not in _INLINE and not part.isspace() and part != ""
        elif part:
            text.append(part)
            if linked:
                links.append(part)

    while at < len(page):
        m = _OPEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            at = tags.after(at, {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">"))
            continue
        tag, closing, start = m[2].lower(), m[1], at
        at = tags.end(at)
        attributes = page[start : at - 1]
        if tag in _RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag not in _INLINE and (text or skipped):
            end_line()
        if dropped:
            if closing:
                if below[tag]:
                    while (last := dropped.pop()) != tag:
                        below[last] -= 1
                    below[tag] -= 1
                elif tag in ("body", "html") or tag in _INNER:
                    dropped.clear()
                    below.clear()
                    lowered.clear()
            elif dropped[0] in _UNCLOSED and len(dropped) == 1 and tag in _ENDS:
                dropped.clear()
                below.clear()
            elif tag not in _VOID:
                dropped.append(tag)
                below[tag] += 1
            if dropped or closing and tag not in _INNER:
                continue
        if not closing and tag not in _VOID and _left_out(tag, attributes, inside > 0):
            dropped.append(tag)
            below[tag] += 1
            continue
        if tag in _LOWERED:
            if not closing:
                lowered[tag] += tag != "header" or not inside
            elif lowered[tag]:
                lowered[tag] -= 1
        elif closing and (tag in _INNER or tag in ("body", "html")):
            lowered.clear()
        if tag == "a":
            linked = 0 if closing else 1
        if tag in _HEADINGS:
            heading = 0 if closing else int(tag[1])
        elif tag in _ENDS:
            heading = 0
        if tag not in _INLINE:
            linked = 0
            if tag in _INNER:
                inside = max(0, inside + (-1 if closing else 1))
    end_line()
    return lines


def weights_of(lines: list[Line]) -> list[float]:
    """What each line weighs."""
    return [x.plain * (0.05 if x.low else 1.0) for x in lines]


def between(weights: list[float], window: int, limit: float) -> list[tuple[int, int]]:
    """Each stretch of text from surge to dive, as its first and last line that weigh anything: windows that are not empty, one of which reaches the limit."""
    found: list[tuple[int, int]] = []
    surge, tall = None, False
    for k in range(len(weights) + window):  # the window that ends with line k
        some = weights[max(0, k - window + 1) : k + 1]
        total = sum(some)
        if total > 0:
            surge, tall = k if surge is None else surge, tall or total >= limit
        elif surge is not None:
            if tall:
                found.append((surge, max(i for i in range(surge, min(k, len(weights))) if weights[i])))
            surge, tall = None, False
    return found


def chosen(lines: list[Line], window: int, share: float) -> list[Line]:
    """The lines that are article text."""
    lines = [x for x in lines if not x.inside or x.text and not x.low]  # what an article does not mean as text does not part it
    weights = weights_of(lines)
    own = [0.0 if x.low else w for w, x in zip(weights, lines)]
    if not any(own):
        own = [w if x.form else 0.0 for w, x in zip(weights, lines)]
        return [x for a, b in _stretches(own, window, share) for x in lines[a : b + 1] if x.text and x.form]
    kept: list[Line] = []
    for a, b in _stretches(own, window, share):
        inner = [i for i in range(a, b + 1) if lines[i].inside]
        if inner:
            a, b = inner[0] if inner[0] - a <= window else a, inner[-1] if b - inner[-1] <= window else b
        kept += [x for x in lines[a : b + 1] if x.text and not x.low]
    return kept


def _stretches(weights: list[float], window: int, share: float) -> list[tuple[int, int]]:
    heavy = [w for w in weights if w]
    return between(weights, window, share * sum(heavy) / len(heavy)) if heavy else []


def main_text(page: str | None, *, window: int = 3, share: float = 0.5) -> str:
    """The blocks of the main text, joined by line feeds."""
    return "\n".join(x.text for x in chosen(lines_of(page), window, share))


def with_text(pages: DataFrame, *, source: str = "html", text: str = "text") -> DataFrame:
    """The pages with a text column; ``text`` replaces a column of that name."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return pages.withColumn(text, extracted(F.col(source)))
