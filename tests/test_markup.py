"""Mark-up operators on hand-made pages."""

from pyspark.sql import functions as F

from foliograph.operators import linking as L
from foliograph.operators import markup as M


def test_tagged_tokens(spark):
    df = spark.createDataFrame([(1, "a <x>b, <y>c</y></z> d<br/></x> e"), (2, None), (3, "<x>open <y>in</x> out")], "doc_id long, text string")
    got = [(r["doc_id"], r["token"], r["path"]) for r in M.tagged_tokens(df).orderBy("doc_id", "run", "pos").collect()]
    assert got == [(1, "a", ""), (1, "b", "x"), (1, ",", "x"), (1, "c", "x!!y"), (1, "d", "x"), (1, "e", ""), (3, "open", "x"), (3, "in", "x!!y"), (3, "out", "")]


def test_homepage_features(spark):
    df = spark.createDataFrame([("<title>My Home Page</title><h2>Publications</h2><a href=x>Research</a> email: x", "http://u.edu/~me/"), (None, None)], "html string, url string")
    assert [r[0] for r in df.select(M.homepage_features(df)).collect()] == [["contactinfo", "hometitle", "possibleroot", "publicationheading", "researchlink"], ["possibleroot"]]


def test_splice(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(t).alias("tag")) for a, b, t in ((0, 1, "<x>"), (2, 4, "é"))])
    assert spark.range(1).select(L.spliced(F.lit("abcdef"), spans).alias("v")).first()["v"] == "<x>béef"


def test_tag_paths_equal_a_plain_stack(spark):
    import random
    import re

    rng = random.Random(3)
    pieces = ["<a>", "<b x='1'>", "</a>", "</b>", "<c/>", "word two", "x, y", "</zz>", "<i>", "</i>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(40)]

    def plain(text):
        out, opened, run = [], [], 0
        for piece in re.findall(r"<[^>]*>|[^<]+", text):
            if not piece.startswith("<"):
                out += [(run, "!!".join(opened), k, t) for k, t in enumerate(re.findall(r"\w+|[^\s\w]", piece))]
                run += 1
                continue
            name = re.match(r"</?([A-Za-z][\w:-]*)", piece)[1].lower()
            if piece.startswith("</"):
                if name in opened:
                    opened = opened[: len(opened) - 1 - opened[::-1].index(name)]
            elif not piece.endswith("/>"):
                opened = [*opened, name]
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in M.tagged_tokens(df).collect():
        got.setdefault(r["doc_id"], []).append((r["run"], r["path"], r["pos"], r["token"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain(t)) for k, t in enumerate(texts) if plain(t)}


def plain_layout(text):
    """Tokens with line and font properties by one pass over the tags."""
    import re

    tokens, opened, font, starts, at = [], ["O"], None, True, 0

    def add(body, starts, ends):
        found = re.findall(r"\w+|[^\s\w]", body)
        for k, token in enumerate(found):
            tokens.append({"token": token, "label": opened[-1], "font": font, "start": starts and k == 0, "end": False})
        if body and ends and tokens:
            tokens[-1]["end"] = True
        return bool(found)

    for m in re.finditer(r"<(/?)([^\s>/]*)([^>]*)>", text):
        if add(text[at : m.start()], starts, m[2] == "position"):
            starts = False
        at = m.end()
        if m[2] == "font":
            font = m[0].split('"')[1]
        elif m[2] == "position":
            starts = True
        elif m[2] in M.LAYOUT or m[0].endswith("/>"):
            pass
        elif m[1]:
            if opened[-1] == m[2]:
                opened.pop()
        else:
            opened.append(m[2])
    add(text[at:], False, True)
    return [(k, t["token"], t["label"], t["font"], t["start"], not t["start"] and not t["end"], t["end"]) for k, t in enumerate(tokens)]


def test_layout_tokens_equal_one_pass(spark):
    import random

    rng = random.Random(5)
    pieces = ["<position x='1'/>", '<font name="a b"/>', '<font name="c"/>', "<line>", "</line>", "<page>", "<phantom/>", "two words", " ", "x", "\n"]

    def nested(depth):
        some = [rng.choice(pieces) if rng.random() < 0.8 or not depth else f"<t{depth}>{nested(depth - 1)}</t{depth}>" for _ in range(rng.choice([0, 1, 3, 12]))]
        return "".join(some)

    texts = [nested(3) for _ in range(120)] + ["", "only text", "a<position/>", "a <position/> <position/>b"]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    got = {}
    for r in M.layout_tokens(df).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_layout(t) for k, t in enumerate(texts) if plain_layout(t)}


def test_layout_tokens_sort_nothing(spark):
    """Odd mark-up beside what the windows said of it; no run or token is sorted."""
    texts = ["a<b", "a<position", "x<<position/>y<", '<font name="A\nB"/>u<FONT k="c" l="d"/>v<font/>w', "<T>Straße</t>é_1<x/>²</u>½<>z", "<b><i>p</b>q</i>r", "a <Position/> \u00a0"]
    df = spark.createDataFrame([*enumerate(texts)], "`k k` long, text string")
    found = M.layout_tokens(df, key="k k")
    got = {}
    for r in found.collect():
        got.setdefault(r[0], []).append("".join([r["token"], "/", r["label"], "/", r["font"] or "-", *["SIE"[k] for k in range(3) if r[5 + k]]]))
    assert got == {
        0: ["a/O/-S", "b/O/-E"],
        1: ["a/O/-S", "position/O/-E"],
        2: ["x/O/-S", "y/O/-E"],
        3: ["u/O/-S", 'v/O/c" l="dI', "w/O/-E"],
        4: ["Straße/t/-S", "é_1/O/-I", "²/O/-I", "½/O/-I", "z/O/-E"],
        5: ["p/i/-S", "q/O/-I", "r/O/-E"],
        6: ["a/O/-SE", "\u00a0/O/-E"],
    }
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Sort", "Window", "Exchange"))


def test_changed_paths(spark):
    df = spark.createDataFrame([(1, "a b <x>c d<y>e</y></x>f")], "doc_id long, text string")
    got = [r["path"] for r in M.changed_paths(M.tagged_tokens(df)).orderBy("run", "pos").collect()]
    assert got == ["", "", "x", "", "x!!y", ""]
