"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: runs of text
between block-level tags, each with the number of tags met since the line
before.  What stands in elements that are never an article's (``nav``,
``footer``, ``aside``, scripts, hidden ones and the like) makes no lines.  The
logarithm of each line's ratio of text to tags is smoothed with a Gaussian
over its neighbours.  The ratios fall into a low and a high group, by the
threshold half-way between the two groups' means; lines whose ratio, smoothed
or its own, is over a quarter of the way from the low mean to the high one are
content, and neighbouring ones form clusters.  Clusters decide:

* In a page with main elements (``article``, ``main``) that hold content, these
  are the region.
* Else the region is the lowest element that holds the largest cluster, grown
  to the element around it as long as most of the text that this adds is
  content.  Content lines outside the region are kept too, whatever their size.
* Of a region all lines are kept, short ones too, but for lines of links (of several, in a main element)
  and lines in an element with a telling class, if their own ratio is
  under the threshold.

Names in class and id weigh in: a line under an element with a telling word in
its names counts half.  Where the whole name tells (``cookie-notice``, but not
``banner-story``) the element's lines stay out, unless the page has three times
more content in there than elsewhere; for readers' comments there is no unless.

Each node knows its place, so the work grows with the page alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg canvas math audio video head title select textarea button datalist map applet noframes".split())
APART = frozenset("nav footer aside dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
#: Words in class and id names that tell of something apart from the article.
MARKS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adbox adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side aside rail cookie cookies consent gdpr notice notices banner alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager toolbar skip".split()
)
#: Words beside which a telling word still names the whole element.
PLAIN = frozenset(
    "area articles bar block body bottom box button buttons center col column container content dialog footer form global group header icon icons id inner item items left link links list main media message module network outer page panel posts primary reader right row secondary section site slot text thread title to top unit user wrap wrapper".split()
)
NOT_MARKED = frozenset("with has no without".split())
KEEPS = frozenset("html body main article".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select menu".split())
#: Elements of the text itself, which hold no region.
TEXT_LEVEL = INLINE | HEADINGS | frozenset("p li ul ol blockquote pre dl dt dd td th tr tbody thead tfoot table figure figcaption address".split())
#: How many times the content outside a named element must be in it, for the name not to count.
OUTWEIGHS = 3
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACES = re.compile(r"\s+")

#: What an element's names tell.
NOTHING, WEAK, STRONG, COMMENT = range(4)


def name_tells(value: str) -> int:
    """What the names in a class or id tell of the element."""
    most = NOTHING
    for name in value.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        told = parts & MARKS
        if not told or parts & NOT_MARKED:
            continue
        whole = all(p in MARKS or p in PLAIN or p.isdigit() for p in parts)
        most = max(most, WEAK if not whole else COMMENT if told & COMMENTS else STRONG)
    return most


@dataclass(eq=False, slots=True)
class Node:
    """An open or closed element; ``main``, ``named`` and ``weak`` are those that it is in, itself included."""

    tag: str
    up: Node | None
    place: int
    scope: Counter
    apart: bool = False
    unseen: bool = False
    linked: bool = False
    keeps_headings: bool = False
    main: Node | None = None
    named: Node | None = None
    comment: bool = False
    weak: bool = False
    end: int = 0


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    node: Node
    linked: int = 0
    links: int = 0


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = Node("", None, 0, Counter())
        self.nodes = [self.at]
        self.open: Counter = Counter()
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def _break(self) -> None:
        text = _SPACES.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            self.lines.append(Line(text, self.tags, self.at, self.linked, self.links))
            self.tags = 0
        self.linked = self.links = 0

    def _leave(self, node: Node) -> None:
        """Closes a node and all that is open in it."""
        while True:
            n = self.at
            self.open[n.tag] -= 1
            n.up.scope[n.tag] -= 1
            self.at = n.up
            if n is node:
                return

    def _nearest(self, tags: tuple[str, ...]) -> Node:
        n = self.at
        while n.tag not in tags:
            n = n.up
        return n

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        if tag in CLOSES_P and self.open["p"]:
            n = self.at
            while n.tag in INLINE:
                n = n.up
            if n.tag == "p":
                self._break()
                self._leave(n)
        if tag in SIBLINGS and any(self.at.scope[t] for t in SIBLINGS[tag]):
            self._break()
            self._leave(self._nearest(SIBLINGS[tag]))
        if tag not in INLINE:
            self._break()
        elif tag == "a":
            self.links += 1
        self._enter(tag, {k: v or "" for k, v in attrs})

    def _enter(self, tag: str, a: dict[str, str]) -> None:
        up = self.at
        n = Node(tag, up, len(self.nodes), Counter() if tag in SCOPES else up.scope, up.apart, up.unseen, up.linked or tag == "a", up.keeps_headings, up.main, up.named, up.comment, up.weak)
        n.unseen = up.unseen or tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        tells = max(name_tells(a.get("class", "")), name_tells(a.get("id", "")))
        main = tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"
        if n.unseen or (tag not in KEEPS and (tag in APART or a.get("role", "").lower() in ROLES)):
            n.apart, n.keeps_headings = True, False
        elif up.apart and up.keeps_headings:
            n.apart = tag not in HEADINGS
        elif not up.apart and tag == "header":
            n.apart, n.keeps_headings = True, up.main is not None
        if tag == "form":
            tells = max(tells, STRONG)
        if tells >= STRONG and tag not in KEEPS or tells == COMMENT and tag == "article":
            n.named, n.comment = up.named or n, up.comment or tells == COMMENT
        elif tells == WEAK and not main:
            n.weak = True
        if main and n.named is not n and up.main is None:
            n.main = n
        self.open[tag] += 1
        up.scope[tag] += 1
        self.nodes.append(n)
        self.at = n

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if not self.open[tag]:
            if tag == "p":
                self._break()
            return
        n = self.at
        while n.tag != tag:
            if tag in INLINE and n.tag not in INLINE:
                return  # an inline end tag doesn't close blocks
            n = n.up
        if tag not in INLINE:
            self._break()
        self._leave(n)

    def handle_data(self, data: str) -> None:
        if not self.at.apart and not self.at.comment:
            self.parts.append(data)
            if self.at.linked:
                self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._break()
        for n in reversed(self.nodes):
            n.end = max(n.end, n.place + 1)
            if n.up is not None:
                n.up.end = max(n.up.end, n.end)
        return self.lines


def smooth(ratio: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean of each line's ratio and those of up to ``radius`` lines to each side."""
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(ratio, k, mode="full")[radius : radius + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), k, mode="full")[radius : radius + len(ratio)]


def two_groups(x: np.ndarray, most_rounds: int = 50) -> float:
    """A quarter of the way between the means of two groups, the values up to half-way between these means and those beyond; the value itself if all are equal."""
    t = (x.min() + x.max()) / 2
    for _ in range(most_rounds):
        high = x > t
        if not high.any():
            break
        new = (x[~high].mean() + x[high].mean()) / 2
        if new == t:
            break
        t = new
    low, high = x[x <= t], x[x > t]
    return float(low.mean() + (high.mean() - low.mean()) / 4) if len(high) else float(t)


def content_lines(lines: list[Line], radius: int = 2, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the text-to-tag ratio marks as content, one at least, and which of them reach the threshold by themselves."""
    ratio = np.log1p([(len(x.text) - x.linked / 2) / max(1, x.tags) * (0.5 if x.node.weak else 1) for x in lines])
    s = smooth(ratio, radius, sigma)
    least = two_groups(ratio)
    marked = (s > least) | (ratio > least)
    return (marked if marked.any() else s >= s.max()), ratio > least


def _sums(nodes: list[Node], lines: list[Line], values: np.ndarray) -> np.ndarray:
    """For each node the sum of the values of the lines under it."""
    upto = np.zeros(len(nodes) + 1, np.int64)
    np.add.at(upto, np.array([x.node.place for x in lines], np.int64) + 1, values)
    upto = np.cumsum(upto)
    return upto[np.array([n.end for n in nodes])] - upto[np.array([n.place for n in nodes])]


def _region(nodes: list[Node], lines: list[Line], marked: np.ndarray, alone: np.ndarray, size: np.ndarray) -> Node:
    """The lowest element over the largest cluster's lines that are content by themselves, grown while most of what that adds is such."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    # a line of links alone doesn't tell where the article is
    prose = np.array([0 if 2 * x.linked > len(x.text) else len(x.text) for x in lines])
    lo, hi = max(runs, key=lambda r: (int(prose[r[0] : r[1]].sum()), -r[0]))
    own = np.zeros(len(lines), np.int64)
    own[lo:hi] = alone[lo:hi] & (prose[lo:hi] > 0)
    if not own.any():
        own[lo:hi] = 1
    full = _sums(nodes, lines, own)
    at = nodes[int(np.flatnonzero(full == own.sum())[-1])]
    if at.tag == "div" and at.up is not None and any(x.node is at for x, k in zip(lines, own, strict=True) if k):
        at = at.up  # a block that a line stands in directly is its paragraph
    while at.up is not None and at.tag in TEXT_LEVEL:
        at = at.up
    every, good = _sums(nodes, lines, size), _sums(nodes, lines, np.where(marked & alone, size, 0))
    n = at
    while n.up is not None:
        more, content = every[n.up.place] - every[n.place], good[n.up.place] - good[n.place]
        if 2 * content < more:
            break
        n = n.up
        at = n if more else at
    return at


def main_text(html: str | None, radius: int = 2, sigma: float = 1.0) -> str:
    """The article's blocks joined by newlines; empty for null, empty or text-free pages."""
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    lines = events.finish()
    if not lines:
        return ""
    marked, alone = content_lines(lines, radius, sigma)
    size = np.array([len(x.text) for x in lines], np.int64)
    named = np.array([x.node.named is not None for x in lines])
    if named.any():
        outside = int(size[marked & ~named].sum())
        if not any(m and not k and x.node.main is not None for x, m, k in zip(lines, marked, named, strict=True)):
            held: Counter = Counter()
            for x, m in zip(lines, marked, strict=True):
                if m and x.node.named is not None:
                    held[x.node.named] += len(x.text)
            cleared = {n for n, c in held.items() if c > OUTWEIGHS * outside}
            named = np.array([x.node.named is not None and x.node.named not in cleared for x in lines])
        lines = [x for x, out in zip(lines, named, strict=True) if not out]
        if not lines:
            return ""
        marked, alone = content_lines(lines, radius, sigma)
        size = np.array([len(x.text) for x in lines], np.int64)
    mains = {x.node.main for x, m in zip(lines, marked, strict=True) if m and x.node.main is not None}
    region = None if mains else _region(events.nodes, lines, marked, alone, size)
    out = []
    for x, m, own in zip(lines, marked, alone, strict=True):
        inside = x.node.main in mains if mains else region.place <= x.node.place < region.end
        chrome = not own and x.node.tag not in HEADINGS and (x.node.weak and not (region or x.node.main).weak or (x.links > bool(mains) and 2 * x.linked > len(x.text)))
        if (inside and not chrome) or (m and own and not mains and 2 * x.linked <= len(x.text)):
            out.append(x.text)
    return "\n".join(out)


def extract_text(df: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """``df`` without the page source, with its main text in ``column`` (an existing one is replaced).

    Null and empty pages give an empty text, an empty table no rows.  Whole
    pages are read, however long or deep; of equal clusters the first is the
    largest; equal pages give equal texts.  Other columns, null or not, stay.
    """
    keep = [c for c in df.columns if c not in (html, column)]
    src = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(v.as_py()) for v in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, column])

    return src.mapInArrow(run, ", ".join([f"`{c}` {k}" for c, k in src.dtypes if c != "__html"] + [f"`{column}` string"]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op8_html": op8_html}
ORACLES: dict[str, str] = {}
