"""HTML extraction by tree scoring.

A page is parsed into a tree without what is never shown (scripts, styles, hidden elements). A paragraph, which is a block
with text of its own, earns (1 + commas + a point for each 100 characters, 3 at most) times the share of its text outside
links; headings earn a quarter. Its points go to the containers around it: in full to the first, half to the second, less
with each step (``LEVELS``), but in full to an ``article`` around it and at ``MAIN`` to a ``main``. A container's score is
that sum times the share of its text outside links. Tags, roles and names that speak of menus, headers, footers,
sidebars, notices, adverts, forms or comments lower all that passes through them to a fiftieth. The best container is kept, with
the siblings that score a fifth of it, those of its tag and class, paragraphs of prose and headings. Inside, a lowered block
goes unless its lowered points are 1 at least and no fewer than all others'; lists of links go only where the container
is the whole page. All else stays. Each block becomes one line.

Null, empty and text-less pages give an empty text. Broken markup (unclosed tags, quotes, cut pages) is parsed as far as
it goes, in time linear in its length. Repeated rows are extracted alike; very long pages are read whole. Empty tables give
empty results. Columns named like an output are replaced; the others pass through.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import by_bytes

# Names of HTML elements and roles, and words in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg select".split())
UNSHOWN = frozenset("button canvas audio video object head input label legend datalist annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside body div footer header main nav section td".split())
LINK_BOXES = frozenset("dl div menu ol section table ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html li tbody td tfoot th thead tr".split())
#: An element that one of these opens inside closes, up to the nearest of the second set.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)),
}
P_ENDS = (("p",), ("td", "th", "button", "object", "table", "caption"))
LOW_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
LOW_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
LOW_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner promo promotion sponsor sponsors sponsored sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager disclaimer copyright form search skip".split()
)
#: Words that leave the meaning of a name to the word before them.
BOXES = frozenset("area bar block body bottom box button buttons col column container content group holder inner item items left link links list module outer panel region right row section slot text top unit wrap wrapper zone".split())
OTHERS, TEXTS = frozenset("related recommended popular trending similar".split()), frozenset("posts articles stories topics news reading".split())
NEGATORS = frozenset("has no with without".split())
OWNERS = frozenset("article entry post story chapter section".split())

LOWERED, MAIN, LEVELS = 0.02, 0.7, (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15)
FORM_POINTS = 10

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
PLAIN = re.compile(r"[^<>]*")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$|=)", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = re.compile("[,，、،]")


class Node:
    __slots__ = ("children", "kept", "low", "name", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.kept, self.low, self.name = tag, parent, [], True, False, ""


def is_low_name(name: str) -> bool:
    """Whether the last telling word of one class or id name is of the kind that lowers."""
    words = [w.lower() for w in NAME_WORD.findall(name) if not w.isdigit()]
    while words and words[-1] in BOXES:
        words.pop()
    if not words:
        return False
    before = words[-2] if len(words) > 1 else ""
    if words[-1] in TEXTS:
        return before in OTHERS
    if words[-1] == "header" and before in OWNERS:
        return False
    return words[-1] in LOW_WORDS and before not in NEGATORS


def describe(node: Node, attributes: str) -> None:
    """Set from tag and attributes: whether the node is shown, whether it is lowered, and its class."""
    tag = node.tag
    if tag in UNSHOWN:
        node.kept = False
        return
    node.low = tag in LOW_TAGS
    if tag == "header":
        up = node.parent
        for _ in range(3):  # an article's own header has its title
            if up is not None and up.tag == "article":
                node.low = False
            up = up.parent if up is not None else None
    if not attributes or tag in ("html", "body"):
        return
    if "=" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDING.search(value):
                node.kept = False
            elif name == "role":
                node.low = node.low or value.lower() in LOW_ROLES
            elif name in ("class", "id"):
                if name == "class":
                    node.name = value
                node.low = node.low or tag not in ("article", "main") and any(is_low_name(x) for x in value.split())
        attributes = re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)
    if HIDDEN.search(attributes):
        node.kept = False


class Builder:
    """The open elements of a page, with where each tag is open, so that no end tag walks them."""

    def __init__(self) -> None:
        self.root = Node("#root", None)
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def text(self, x: str) -> None:
        self.open[-1].children.append(x)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close_from(self, k: int) -> None:
        while len(self.open) > k:
            self.at[self.open.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def end(self, tag: str) -> None:
        k = self.last((tag,))
        if k and (tag in BLOCK or not self.blocks or self.blocks[-1] < k):
            self.close_from(k)

    def start(self, tag: str, attributes: str) -> None:
        ends, until = P_ENDS if tag in CLOSES_P else ENDS.get(tag, ((), ()))
        if ends:
            floor = self.last(until)
            if tag == "tr":
                above = [self.at[t][k] for t in ends if self.at.get(t) and (k := bisect_right(self.at[t], floor)) < len(self.at[t])]
                k = min(above, default=0)
            else:
                k = self.last(ends)
            if k > floor:
                self.close_from(k)
        node = Node(tag, self.open[-1])
        describe(node, attributes)
        node.parent.children.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)


def parse(page: str) -> Node:
    """The tree of a page. Quotes that never close are no quotes: tags up to there end at the first bracket."""
    tree, at, look, plain_to = Builder(), 0, 0, 0
    while (lt := page.find("<", look)) >= 0:
        m = TAG.match(page, lt)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?"):
            look = lt + 1
            continue
        if lt > at:
            tree.text(page[at:lt])
        if not m:
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                end = end if end >= 0 else len(page)
                tree.text(html.escape(page[lt + 9 : end], quote=False))
                at = look = end + 3
            else:
                comment = page.startswith("<!--", lt)
                end = page.find("-->", lt + 2) if comment else page.find(">", lt)
                at = look = end + (3 if comment else 1) if end >= 0 else len(page)
            continue
        stop = QUOTED.match(page, m.end()).end() if lt >= plain_to else -1
        if stop < 0 or page[stop : stop + 1] != ">":
            plain_to = max(plain_to, stop)
            stop = PLAIN.match(page, m.end()).end()
        at = look = stop + (page[stop : stop + 1] == ">")
        tag, attributes = m[2].lower(), page[m.end() : stop]
        if m[1]:
            tree.end(tag)
        elif tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile("</" + re.escape(tag), re.I).search(page, at)
                close = page.find(">", end.start()) if end else -1
                at = look = close + 1 if close >= 0 else len(page)
            if tag != "svg":
                tree.text(" ")
        else:
            tree.start(tag, attributes)
    if at < len(page):
        tree.text(page[at:])
    return tree.root


class Facts:
    """By shown node: characters, linked ones, points as earned and as lowered; by block: its own text."""

    def __init__(self, root: Node):
        self.order: list[Node] = []
        self.block: dict[Node, Node] = {}
        linked: dict[Node, bool] = {}
        self.chars: dict[Node, int] = {}
        self.links: dict[Node, int] = {}
        words: dict[Node, list[str]] = {}
        todo = [root]
        while todo:
            x = todo.pop()
            up = x.parent
            self.order.append(x)
            self.block[x] = x if x.tag in BLOCK or up is None else self.block[up]
            linked[x] = x.tag == "a" or up is not None and linked[up]
            self.chars[x] = self.links[x] = 0
            for c in x.children:
                if isinstance(c, str):
                    if n := len(c.strip()):
                        self.chars[x] += n
                        self.links[x] += n * linked[x]
                        words.setdefault(self.block[x], []).append(c)
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node) and c.kept)
        own = {b: self.of_text(x) for b, x in words.items()}
        for x in reversed(self.order):
            if x.parent is not None:
                self.chars[x.parent] += self.chars[x]
                self.links[x.parent] += self.links[x]
        self.points = {b: n * (0.25 if b.tag in HEADINGS else 1) * self.unlinked(b) for b, n in own.items()}
        self.earned = self.sums(lambda x: 1)
        for x in self.order:
            if x.tag == "form" and self.earned[x] >= FORM_POINTS:
                x.low = False
        self.lowered = self.sums(lambda x: LOWERED if x.low else 1)

    @staticmethod
    def of_text(parts: list[str]) -> float:
        text = " ".join("".join(parts).split())
        return 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)

    def unlinked(self, x: Node) -> float:
        return 1 - self.links[x] / max(self.chars[x], 1)

    def sums(self, weight) -> dict[Node, float]:
        """Points of all blocks in a node, times the weights on their way, its own included."""
        out = dict.fromkeys(self.order, 0.0)
        for x in reversed(self.order):
            out[x] = (out[x] + self.points.get(x, 0)) * weight(x)
            if x.parent is not None:
                out[x.parent] += out[x]
        return out

    def scores(self) -> dict[Node, float]:
        """The score of every container that points reach."""
        lows: dict[Node, int] = {}
        around: dict[Node, tuple[Node, ...]] = {}
        for x in self.order:
            up = x.parent
            lows[x] = x.low + (lows[up] if up is not None else 0)
            outer = around[up] if up is not None else ()
            around[x] = (*(a for a in outer if a.tag != x.tag), x) if x.tag in ("article", "main") else outer
        out: dict[Node, float] = {}

        def give(x: Node, block: Node, points: float) -> None:
            out[x] = out.get(x, 0) + points * LOWERED ** (lows[block] - lows[x] + x.low)

        for block, points in self.points.items():
            if block.tag in ("#root", "html"):
                continue
            x = block if block.tag in CONTAINERS else block.parent
            for share in LEVELS:
                if x is None:
                    break
                if x.tag not in ("article", "main"):
                    give(x, block, points * share)
                x = x.parent
            for a in around[block]:
                give(a, block, points * (1 if a.tag == "article" else MAIN))
        return {x: n * self.unlinked(x) for x, n in out.items()}


def best_nodes(root: Node) -> list[Node]:
    """The best container and the siblings to keep with it, in page order, with what is to go in them marked."""
    facts = Facts(root)
    if not facts.points:
        return []
    scores = facts.scores()
    place = {x: k for k, x in enumerate(facts.order)}
    top = max(scores, key=lambda x: (scores[x], -place[x])) if scores else root
    whole = top.parent is None or top.tag in ("html", "body")
    out = [top] if whole else []
    for x in () if whole else top.parent.children:
        if x is top:
            out.append(x)
        elif isinstance(x, Node) and x in place and facts.chars[x]:
            links = 1 - facts.unlinked(x)
            prose = x.tag == "p" and facts.chars[x] > 80 or x.tag in HEADINGS
            twin = x.tag == top.tag and x.name == top.name and x.name
            if not x.low and links < 0.25 and (scores.get(x, 0) >= max(2.0, 0.2 * scores[top]) or prose or twin):
                out.append(x)
    inside = facts.lowered[top] / (LOWERED if top.low else 1)
    for x in facts.order[place[out[0]] :] if out else ():
        if x.low and x is not top and facts.lowered[x] < max(1, inside - facts.lowered[x]):
            x.kept = False
        elif whole and x.tag in LINK_BOXES and facts.links[x] > 0.6 * facts.chars[x] and sum(isinstance(c, Node) for c in x.children) > 1:
            x.kept = False
    if top.low and facts.lowered[top] < 1:
        return []
    return out


def blocks_of(nodes: list[Node]) -> Iterator[str]:
    line: list[str] = []

    def flush() -> Iterator[str]:
        if line and (out := " ".join(html.unescape("".join(line)).split())):
            yield out
        line.clear()

    for top in nodes:
        todo: list = [(top, False)]
        while todo:
            x, done = todo.pop()
            if isinstance(x, str):
                line.append(x)
            elif done:
                yield from flush()
            elif x.kept:
                if x.tag == "br":
                    line.append("\n")
                    continue
                if x.tag in BLOCK or x is top:
                    yield from flush()
                    todo.append((x, True))
                todo.extend((c, False) for c in reversed(x.children))
    yield from flush()


def main_text(page: str | None) -> str:
    """The main text of one page: a line for each block."""
    if not page:
        return ""
    return "\n".join(blocks_of(best_nodes(parse(page))))


def extract_html(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its length in code points."""
    df = df.drop(text, "n_chars")
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in by_bytes(batch, page):
                yield part.append_column(text, pa.array([main_text(x) for x in part.column(part.schema.get_field_index(page)).to_pylist()], pa.string()))

    return df.mapInArrow(run, schema).withColumn("n_chars", F.length(text).cast("long"))
