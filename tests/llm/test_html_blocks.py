"""The line-block distribution against a plain version, pages that mislead, long broken markup."""

import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm import html_blocks as H


def plain_between(weights, window, limit):
    """Window by window: runs of windows that are not empty, one over the limit, as the first and last line in them that weigh anything."""
    sums = {k: sum(weights[i] for i in range(max(0, k), min(len(weights), k + window))) for k in range(1 - window, len(weights))}
    out, run = [], []
    for k in [*sums, None]:
        if k is not None and sums[k] > 0:
            run.append(k)
            continue
        if run and max(sums[x] for x in run) >= limit:
            lines = [i for x in run for i in range(x, x + window) if 0 <= i < len(weights) and weights[i] > 0]
            out.append((min(lines), max(lines)))
        run = []
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 2, 8, 30, 100]), max_size=40), st.integers(1, 5), st.sampled_from([0.1, 5, 50, 120]))
def test_windows(weights, window, limit):
    assert H.between([float(w) for w in weights], window, limit) == plain_between(weights, window, limit)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='post related-works'><p>Main article text.</p></div>", "Main article text."),
        ("<div class='job-search-results'><p>A job</p></div>", "A job"),
        ("<article><p class='alert'>Hello</p><div class='share-price'>Stock text</div><p>More</p></article>", "Stock text\nMore"),
        ("<article><p>One text.</p></article><p>between</p><article><p>Two text.</p></article><p>after</p>", "One text.\nbetween\nTwo text."),
        ("<p><a href=x>nearly all of it is a link</a> x</p>", "nearly all of it is a link x"),
        ("<p>one</p><p title=it's>two</p><p>three</p><p>four's</p>", "one\ntwo\nthree\nfour's"),
        ("<p>Kurz</p><p>A long text stands here, in a block.</p><p>- yes</p><p>Short end</p>", "Kurz\nA long text stands here, in a block.\n- yes\nShort end"),
        ("<article><p>A long text stands here.</p><ul><li><a>b</a><li><a>c</a><li><a>d</a><li><a>e</a></ul><p>f</p><div class='toc'>x</div><p class=byline>By y</p></article>", "A long text stands here.\nb\nc\nd\ne\nf"),
        ("<form><p>A long text stands here, in a form.</p><p>And more.</p></form>", "A long text stands here, in a form.\nAnd more."),
        ("<form><nav>Menu</nav><p>Text of a page in a form.</p></form><footer>Foot</footer>", "Text of a page in a form."),
        ("<nav>Only a menu, however long it may be.</nav><footer>And a footer</footer>", ""),
        ("<p>A long text stands here, in a block.</p><div class='discussion-thread'><p>I say so.</p></div><div class='reader-voices'>Me too.</div>", "A long text stands here, in a block."),
        ("<h1>Title</h1><p>A long text stands here, in a block.</p><p>So.</p><h2>3 comments</h2><p>I like it a lot.</p><h3>Bob</h3><p>Me too.</p><h2>Sources</h2><p>A book.</p>", "Title\nA long text stands here, in a block.\nSo.\nSources\nA book."),
        ("<article><h2>Comments</h2><p>On the law.</p></article>", "Comments\nOn the law."),
        ("<div class='site-header'>Site</div><div id='cookie-banner'>We</div><p>text<span class='share'>share</span> goes on</p>", "text goes on"),
        ("<article><p>a b.</p><aside><p>x</p><p>y</p><p>z</p><p>w</p></aside><p>c</p></article>", "a b.\nc"),
        ("<b c='<p>one</p>", "one"),
    ],
)
def test_misleading_pages(page, text):
    assert H.main_text(page) == text


def test_the_threshold_is_the_pages_own():
    """The same lines are text or not, after what else the page has."""
    nearby, links = "<p>nine word</p>", "<p><a>one</a></p><p><a>two</a></p><p><a>three</a></p>"
    long = "long words " * 30
    assert H.main_text(nearby) == H.main_text(nearby + links) == "nine word"
    assert H.main_text(nearby + links + f"<p>{long}</p>") == long.strip()
    assert H.main_text(nearby + f"<p>{long}</p>") == f"nine word\n{long.strip()}"


def planted(draw):
    """A page without helpful tags, and its text: links and short notes, an article of long and short blocks, links and short notes."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randrange(a, b)))
    links = lambda: "".join(f"<div><a href=x>{words(1, 4)}</a></div>" for _ in range(draw.randrange(3, 9)))
    note = lambda: f"<div>{words(1, 4)}</div>"
    blocks = [words(1, 8), *[words(40, 200) if draw.random() < 0.6 else words(1, 8) for _ in range(draw.randrange(3, 12))], words(40, 200), words(1, 8)]
    return note() + links() + "".join(f"<div>{b}</div>" for b in blocks) + links() + note(), blocks


def test_windows_decide_on_planted_pages():
    """Precision and recall of lines on pages that only the distribution can tell apart; without windows they would be kept whole."""
    draw, right, given, wanted, whole = random.Random(1), 0, 0, 0, 0
    for _ in range(300):
        page, blocks = planted(draw)
        found = H.main_text(page).split("\n")
        right += sum((Counter(found) & Counter(blocks)).values())
        given, wanted, whole = given + len(found), wanted + len(blocks), whole + sum(bool(x.text) for x in H.lines_of(page))
    assert right == given == wanted < whole / 2


@pytest.mark.parametrize("part", ["<a b='", '<p class="', "<", "<a =", "<!--", "<div class=ad>", "&", "<nav><div>", "</span>", "<title>", "<a class=x ", "<![CDATA["])
def test_long_broken_markup_takes_linear_time(part):
    began = time.time()
    H.main_text(part * 40_000 + "x")
    H.main_text("<nav>" + "<div>" * 20_000 + part * 20_000)
    assert time.time() - began < 5
