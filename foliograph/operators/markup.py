"""Marked-up text: tokens with their tags, page features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tag or a run of text without one; a token of the text is a run of word characters or one sign.
_PIECE = r"<[^>]*>|[^<]+"
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


#: Tags that tell of the layout and open nothing.
LAYOUT = ("doc", "page", "line", "phantom", "font", "position")

# the same for a pass over whole texts; white space is that of ASCII, and a quoted value ends with its line, as for Spark
_PIECES = re.compile(_PIECE)
_TOKENS = re.compile(r"\w+|[^\w \t\n\x0b\f\r]")
_NAME = re.compile(r"<([^ \t\n\x0b\f\r>/]*)")
_QUOTED = re.compile(r'"([^\n\r\x85\u2028\u2029]*)"')
_ELEMENT = re.compile("</?([A-Za-z][A-Za-z0-9:_-]*)")


def _runs(texts: DataFrame, text: str, key: str) -> DataFrame:
    """The runs of text between tags, numbered, with the path of open tags."""
    row_type = "array<struct<path: string, body: string>>"
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast(f"array<{row_type}>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9:_-]*)", 1))
        closing, opening = F.startswith(piece, F.lit("</")), piece.rlike(r"^<[A-Za-z][^>]*[^/>]?>$") & ~F.endswith(piece, F.lit("/>"))
        at = F.size(state["open"]) - F.array_position(F.reverse(state["open"]), name).cast("int")
        known = F.array_contains(state["open"], name)
        stack = F.when(closing & known, F.slice(state["open"], 1, at)).when(opening, F.concat(state["open"], F.array(name))).otherwise(state["open"])
        row = F.struct(F.array_join(state["open"], "!!").alias("path"), piece.alias("body"))
        out = F.concat(state["out"], F.array(row))
        return F.struct(stack.alias("open"), F.when(F.startswith(piece, F.lit("<")), state["out"]).otherwise(out).alias("out"))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["open"].alias("open"), F.array().cast(row_type).alias("out")), step)
        return F.struct(inner["open"].alias("open"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    # a fold copies what it appends to, so pieces are folded in blocks of about the root of their number
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))
    split = texts.select(key, pieces.alias("_pieces")).filter(F.size("_pieces") > 0)
    size = F.ceil(F.sqrt(F.size("_pieces"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size("_pieces"), size), lambda k: F.slice("_pieces", k, size))
    each = split.select(key, F.posexplode(F.flatten(F.aggregate(blocks, start, block, lambda s: s["out"]))).alias("run", "p"))
    return each.select(key, F.col("run").cast("long").alias("run"), F.col("p.path").alias("path"), F.col("p.body").alias("body"))


def tagged_tokens(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens of nested mark-up with the path of open tags, outermost first, joined by ``!!``.

    A closing tag closes the innermost open tag of its name and those inside it; one that
    closes nothing is ignored, and so is a tag that ends itself.
    """
    runs = _runs(texts, text, key)
    return runs.select(key, "run", "path", F.posexplode(F.regexp_extract_all("body", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))


def _layout_of(text: str, background: str) -> tuple[list[str], list[str], list[str | None], list[bool], list[bool]]:
    """Tokens of one text with their labels and fonts, and whether they start or end a line."""
    pieces = _PIECES.findall(text)
    tokens, labels, fonts, starts, ends = [], [], [], [], []
    opened: list[str] = []
    font, fresh, last = None, True, len(pieces) - 1
    for k, piece in enumerate(pieces):
        if piece[0] != "<":
            words = _TOKENS.findall(piece)
            if words:
                n = len(words)
                tokens += words
                labels += [opened[-1] if opened else background] * n
                fonts += [font] * n
                starts += [fresh and k < last] + [False] * (n - 1)
                ends += [False] * n
                fresh = False
            if ends and (k == last or (tag := _NAME.match(pieces[k + 1])) and tag[1].lower() == "position"):
                ends[-1] = True
            continue
        tag = _NAME.match(piece)[1].lower()
        if tag == "font":
            quoted = _QUOTED.search(piece)
            font = quoted and quoted[1] or None
        elif tag == "position":
            fresh = True
        name = _ELEMENT.match(piece)
        name = name[1].lower() if name else ""
        if piece[1] == "/":
            if name in opened:
                del opened[len(opened) - 1 - opened[::-1].index(name) :]
        elif name and not piece.endswith("/>") and name not in LAYOUT:
            opened.append(name)
    return tokens, labels, fonts, starts, ends


def layout_tokens(texts: DataFrame, text: str = "text", key: str = "doc_id", background: str = "O") -> DataFrame:
    """Tokens of nested mark-up with their innermost tag, font and place in the line: key, tok_idx, token, label, font, line_start, line_in, line_end.

    ``<position>`` ends a line, ``<font>`` with a quoted value sets the font of what follows; tags of the
    layout (``LAYOUT``) give no label, tags outside any other have the background's. The first token of a line
    starts it; none in the text behind the last tag does. Where text, if only a blank, stands right
    before a position tag or at the very end, the last token so far ends a line. A token that neither
    starts nor ends a line is inside it. A text without tokens has no rows. Texts are passed one after the
    other, so that runs and tokens are neither shuffled nor sorted.
    """
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, tok_idx long, token string, label string, font string, line_start boolean, line_in boolean, line_end boolean"

    def frame(keys: pa.Array, at: list[int], rows: list[list]) -> pa.RecordBatch:
        numbers, tokens, labels, fonts, starts, ends = rows
        inside = [not (a or b) for a, b in zip(starts, ends)]
        columns = [(numbers, pa.int64()), (tokens, pa.string()), (labels, pa.string()), (fonts, pa.string()), (starts, pa.bool_()), (inside, pa.bool_()), (ends, pa.bool_())]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(x, t) for x, t in columns]], [key, "tok_idx", "token", "label", "font", "line_start", "line_in", "line_end"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], [[] for _ in range(6)]
            for k, x in enumerate(batch.column(1)):
                found = _layout_of(x.as_py() or "", background)
                at += [k] * len(found[0])
                for column, more in zip(rows, [range(len(found[0])), *found]):
                    column += more
                if len(at) > 20_000:
                    yield frame(batch.column(0), at, rows)
                    at, rows = [], [[] for _ in range(6)]
            if at:
                yield frame(batch.column(0), at, rows)

    return texts.select(key, text).mapInArrow(passed, schema)


def changed_paths(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tagged tokens whose path is blank where it is that of the token before."""
    order = Window.partitionBy(key).orderBy("run", "pos")
    return tokens.withColumn("path", F.when(F.lag("path").over(order).eqNullSafe(F.col("path")), "").otherwise(F.col("path")))


def flat_tokens(texts: DataFrame, text: str = "text", key: str = "doc_id", background: str = "O") -> DataFrame:
    """Tokens of flat mark-up with the name of the tag before them; behind a closing tag, and before any tag, they have the background label."""
    pieces = texts.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))).alias("run", "piece"))
    tag = F.when(F.startswith("piece", F.lit("</")), background).when(F.startswith("piece", F.lit("<")), F.lower(F.regexp_extract("piece", r"^<\s*([^\s>/]*)", 1)))
    label = F.coalesce(F.last(tag, ignorenulls=True).over(Window.partitionBy(key).orderBy("run")), F.lit(background))
    each = pieces.withColumn("label", label).filter(~F.startswith("piece", F.lit("<")))
    return each.select(key, F.col("run").cast("long").alias("run"), "label", F.posexplode(F.regexp_extract_all("piece", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))


def without_scripts(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", " ")


def field(text: Column, tag: str) -> Column:
    """What stands in the first element of a name."""
    return F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def homepage_features(pages: DataFrame, html: str = "html", url: str = "url") -> Column:
    """Names of the traits found in a page that make it a researcher's home page, ascending."""
    body, title = F.lower(without_scripts(F.col(html))), F.lower(field(F.col(html), "title"))
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    heading = lambda words: body.rlike(rf"(?s)<h[1-3]\b[^>]*>[^<]*\b(?:{words})")
    link = lambda words: body.rlike(rf"(?s)<a\b[^>]*>[^<]*\b(?:{words})")
    traits = {
        "publicationlink": link("publications?|papers?"),
        "publicationheading": heading("publications?|papers?"),
        "researchlink": link("research"),
        "researchheading": heading("research"),
        "resumelink": link("resume|cv|vita"),
        "contactinfo": body.rlike(r"\b(?:e-?mail|phone|fax|office|address)\b"),
        "hometitle": title.rlike(r"\bhome\s*page\b"),
        "possibleroot": F.coalesce(path, F.lit("")).rlike(r"^/?(?:~[^/]+/?)?(?:index\.[a-z]+)?$"),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in traits.items()])))
