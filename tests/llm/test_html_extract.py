"""HTML extraction against a plain recursive version of its scoring, and case by case."""

import random
import time

import pytest

from tallyforge.llm import html_extract as hx
from tallyforge.llm.html_extract import main_text

PROSE = "The tide came in over the flats, and the boats that had lain on their sides all morning began to lift, one after another."


class Plain:
    """An element: tag, class, and children that are strings or elements. Everything is computed from its definition."""

    def __init__(self, tag, name, children):
        self.tag, self.name, self.children, self.up = tag, name, children, None
        for c in children:
            if not isinstance(c, str):
                c.up = self

    def html(self):
        inner = "".join(c if isinstance(c, str) else c.html() for c in self.children)
        return f"<{self.tag}{f' class={chr(34)}{self.name}{chr(34)}' if self.name else ''}>{inner}</{self.tag}>"

    def all(self):
        yield self
        for c in self.children:
            if not isinstance(c, str):
                yield from c.all()

    def path(self):
        return [self, *(self.up.path() if self.up else [])]

    def is_block(self):
        return self.tag in ("div", "section", "article", "main", "body", "p", "h2", "ul", "li", "nav", "footer")

    def strings(self, linked=False):
        """(text, linked, block) of everything below."""
        linked = linked or self.tag == "a"
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    yield c, linked, next(x for x in self.path() if x.is_block())
            else:
                yield from c.strings(linked)

    def density(self):
        got = list(self.strings())
        return sum(len(t.strip()) for t, a, _ in got if a) / max(sum(len(t.strip()) for t, _, _ in got), 1)

    def low(self):
        return self.tag in ("nav", "footer") or self.name in ("sidebar", "reader-comments", "ad") and self.tag not in ("article", "main")

    def points(self):
        text = " ".join("".join(t for t, _, b in self.strings() if b is self).split())
        if not text or not self.is_block():
            return 0
        return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - self.density()) * (0.25 if self.tag == "h2" else 1)

    def total(self):
        return (self.points() + sum(c.total() for c in self.children if not isinstance(c, str))) * (0.02 if self.low() else 1)


def scored(root):
    scores = {}
    for block in root.all():
        if not block.points():
            continue
        way = block.path()[0 if block.tag in ("div", "section", "article", "main", "body", "nav", "footer") else 1 :]
        seen = set()
        for level, x in enumerate(way):
            share = 1 if x.tag == "article" else 0.7 if x.tag == "main" else [1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15, *[0] * 50][level]
            if x.tag in ("article", "main"):
                share *= x.tag not in seen
                seen.add(x.tag)
            lows = sum(y.low() for y in block.path()[: block.path().index(x) + 1])
            if share:
                scores[x] = scores.get(x, 0) + block.points() * share * 0.02**lows
    return {x: n * (1 - x.density()) for x, n in scores.items()}


def by_hand(body):
    nodes = list(body.all())
    scores = scored(body)
    if not any(True for _ in body.strings()):
        return ""
    if not scores:
        top = body
    else:
        most = max(scores.values())
        top = next(x for x in nodes if scores.get(x) == most)
    whole = top.tag == "body"
    keep = []
    for x in [top] if whole else [c for c in top.up.children if not isinstance(c, str)]:
        if x is top:
            keep.append(x)
        elif any(True for _ in x.strings()) and not x.low() and x.density() < 0.25:
            long = sum(len(t.strip()) for t, _, _ in x.strings()) > 80
            if scores.get(x, 0) >= max(2, 0.2 * scores[top]) or x.tag == "p" and long or x.tag == "h2" or (x.tag, x.name) == (top.tag, top.name) and x.name:
                keep.append(x)
    inside = top.total() / (0.02 if top.low() else 1)
    if top.low() and top.total() < 1:
        return ""

    def goes(x):
        boxed = whole and x.tag in ("ul", "div", "section") and x.density() > 0.6 and sum(not isinstance(c, str) for c in x.children) > 1
        return x is not top and (x.low() and x.total() < max(1, inside - x.total())) or boxed

    lines = [""]

    def walk(x):
        if goes(x):
            return
        if x.is_block():
            lines.append("")
        for c in x.children:
            if isinstance(c, str):
                lines[-1] += c
            else:
                walk(c)
        if x.is_block():
            lines.append("")

    for x in keep:
        walk(x)
    return "\n".join(y for y in (" ".join(x.split()) for x in lines) if y)


def grow(r, depth):
    text = lambda: " ".join(r.choice(["one", "two,", "three", "fourteen", "words, and"]) for _ in range(r.choice([1, 3, 12, 40, 90])))
    if depth == 0 or r.random() < 0.4:
        tag = r.choice(["p", "p", "p", "h2", "li"])
        return Plain(tag, "", [r.choice([text(), Plain("a", "", [text()]), text()]) for _ in range(r.randint(1, 3))])
    tag = r.choice(["div", "div", "section", "article", "main", "ul", "nav", "footer"])
    return Plain(tag, r.choice(["", "", "", "story", "sidebar", "reader-comments", "ad", "share-price"]), [grow(r, depth - 1) for _ in range(r.randint(1, 4))])


@pytest.mark.parametrize("seed", range(400))
def test_equals_plain_scoring(seed):
    r = random.Random(seed)
    body = Plain("body", "", [grow(r, r.randint(1, 4)) for _ in range(r.randint(1, 4))])
    assert main_text(f"<html>{body.html()}</html>") == by_hand(body)


CASES = [
    # names lower by their last telling word
    (f"<article><div class='search-results'><p>{PROSE}</p></div><div id='form-and-function'><p>{PROSE}</p></div><div class='share-price'><p>Up.</p></div></article>", f"{PROSE}\n{PROSE}\nUp."),
    (f"<article><p>{PROSE}</p><div class='ad-banner'>Buy</div><div class='comment-list'><p>{PROSE} {PROSE}</p></div><div class='related-posts'>More</div></article>", PROSE),
    # lists of links and mathematics stay inside the container
    (f"<article><p>{PROSE}</p><h2>Works</h2><ul><li><a href=a>First work</a></li><li><a href=b>Second work</a></li></ul></article>", f"{PROSE}\nWorks\nFirst work\nSecond work"),
    (f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p></article>", f"{PROSE} x=2"),
    (f"<ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>{PROSE}</p>", PROSE),
    # an article's own header has its title, the page's does not
    (f"<header><p>Site</p></header><article><header><h1>Title</h1></header><p>{PROSE}</p></article>", f"Title\n{PROSE}"),
    # pages without an article
    ("<nav><a href=/>Home</a></nav><article></article><div class=ad>Buy now.</div><footer>Ours</footer>", ""),
    # a form around the whole page is no form
    (f"<body><form id=aspnet>{'<p>' + PROSE + '</p>'}{('<p>' + PROSE + '</p>') * 4}</form></body>", "\n".join([PROSE] * 5)),
    (f"<article><p>{PROSE}</p><div>{'<p>' + PROSE + '</p>'}</div><section><p>Short.</p></section></article>", f"{PROSE}\n{PROSE}\nShort."),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(page, want):
    assert main_text(page) == want


def test_hostile_pages_take_linear_time():
    begin = time.perf_counter()
    for page in ("<b>" * 100_000 + "</i>" * 100_000, '<a x=""' * 100_000 + '">', "<div>x" * 100_000, "<p>" + "x<br>" * 200_000, "<" * 500_000, "<!--" * 100_000, "<tr><td>" * 100_000, "<script>" * 100_000):
        main_text(page)
    assert time.perf_counter() - begin < 30


def test_names():
    assert [hx.is_low_name(x) for x in ("ad", "siteHeader", "has-sidebar", "sidebar-2", "cookie-notice-wrapper", "nav_links", "comments-area", "related-articles")] == [True, True, False, True, True, True, True, True]
    assert [hx.is_low_name(x) for x in ("share-price", "entry-header", "header-image", "content", "posts", "adventure", "reading", "")] == [False] * 8
