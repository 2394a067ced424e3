"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block nodes; inline elements belong to the block around
them. Each node has features: tag, tokens of class, id and role, density of text
and links in its subtree, depth, ancestors, place among its siblings. Gradient-boosted trees
in numpy give the log-odds that a node is main text. They are trained here on
labelled pages made by a seeded generator.

Decoding is hierarchical: a node may be kept only if its parent is, and the kept
set is the one with the largest sum of log-odds, found from the leaves up. So no
block is kept inside a dropped container, nor a container of dropped blocks only.

A row in, a row out, over whole pages; one page at a time is in memory, and no
step recurses, so that depth is not bounded.

Defined results: null html counts as empty; a page without main text has the
empty text; text outside any block belongs to the block around it, or to the
page; unclosed and stray tags are accepted; repeated rows are read each. Head
hides nothing but what its elements hide, so its end tag may be left out, as may
the tags of html and body. Text of math, svg, object, button, select and canvas
belongs to the block around them. Only elements that HTML itself reads up to
their end tag (``SILENT``) run to the end of the page if they are not closed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements whose content is no text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe title textarea".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that are no blocks either: controls, embedded content, formulas and drawings with their parts.
WITHIN = frozenset((
    "button select option optgroup object canvas "
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "svg g defs symbol use switch text tspan textpath path rect circle ellipse line polyline polygon marker clippath mask pattern filter "
    "lineargradient radialgradient stop foreignobject desc animate animatetransform animatemotion"
).split())
#: Those whose text is a word apart.
APART = frozenset("button select option object mtr mtd svg text".split())
#: Elements that end an open paragraph; elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Tags that are features, and groups of attribute tokens.
TAGS = "body main article section div p h1 h2 h3 ul ol li dl table tr td blockquote pre figure nav header footer aside form".split()
TOKENS = {
    "main": {"content", "article", "post", "story", "entry", "main", "text", "body"},
    "menu": {"nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"},
    "edge": {"header", "footer", "masthead", "banner", "topbar", "copyright", "legal", "contentinfo"},
    "side": {"sidebar", "side", "aside", "widget", "related", "recommended", "complementary", "promo", "share", "social"},
    "advert": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored"},
    "notice": {"cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "signup"},
    "reader": {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond"},
}
_tokens = re.compile(r"[a-z]+").findall
_space = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "linked", "tokens")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str]):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        #: Own text between children: (number of children before, text).
        self.parts: list[tuple[int, str]] = []
        self.linked = 0


class Tree(HTMLParser):
    """Block nodes in page order; the first is the page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("page", None, frozenset())]
        self.open, self.silent, self.links = [self.nodes[0]], [], 0
        self.opened: Counter[str] = Counter()
        #: Of html, head and body, those that have begun.
        self.begun: set[str] = set()
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in ("head", "body"):
            self._imply("html")
            if tag in self.begun:
                return
            self.begun.add(tag)
            if tag == "head":
                return
        elif tag == "html":
            self.begun.add(tag)
        elif tag not in VOID:
            self._imply("body")
        if tag == "a":
            self.links += 1
        if tag in WITHIN:
            if tag in APART:
                self.handle_data(" ")
            return
        if tag in INLINE:
            return
        if tag == "br" or tag in VOID:
            self.handle_data(" ")
            return
        if tag in ENDS_P and self.open[-1].tag == "p":
            self._leave()
        if self.open[-1].tag in SAME.get(tag, ()):
            self._leave()
        self._enter(tag, frozenset(t for k, v in attrs if k in ("class", "id", "role") and v for t in _tokens(v.lower())))

    def _imply(self, tag: str) -> None:
        """Html where a page begins with head or body, body where one has html or head only."""
        if tag not in self.begun and (tag == "html" or self.begun):
            self.begun.add(tag)
            self._enter(tag, frozenset())

    def _enter(self, tag: str, words: frozenset[str]) -> None:
        node = Node(tag, self.open[-1], words)
        self.open[-1].children.append(node)
        self.nodes.append(node)
        self.open.append(node)
        self.opened[tag] += 1

    def _leave(self) -> None:
        self.opened[self.open.pop().tag] -= 1
        self.links = 0

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT or tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in WITHIN:
            if tag in APART:
                self.handle_data(" ")
            return
        if tag in INLINE or tag in VOID:
            return
        if self.opened[tag]:
            while self.open[-1].tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            if not data.isspace():
                self._imply("body")
            node = self.open[-1]
            node.parts.append((len(node.children), data))
            if self.links:
                node.linked += len(data)


def _features(nodes: list[Node]) -> np.ndarray:
    """One row for each node; subtree sums run from the last node to the first."""
    place = {id(n): i for i, n in enumerate(nodes)}
    own = np.array([sum(len(t.strip()) for _, t in n.parts) for n in nodes], dtype=float)
    chars, linked, below = own.copy(), np.array([n.linked for n in nodes], dtype=float), np.ones(len(nodes))
    paragraphs = np.array([n.tag == "p" for n in nodes], dtype=float)
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        for total in (chars, linked, below, paragraphs):
            total[up] += total[i]
    groups = list(TOKENS)
    hits = np.array([[bool(n.tokens & TOKENS[g]) for g in groups] for n in nodes], dtype=float)
    above = np.zeros((len(nodes), len(groups) + 3))
    depth, order = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i, n in enumerate(nodes[1:], 1):
        up = place[id(n.parent)]
        mine = [n.parent.tag in ("article", "main"), n.parent.tag in ("nav", "header", "footer", "aside", "form"), n.parent.tag == "body"]
        above[i] = np.maximum(above[up], np.concatenate([hits[up], mine]))
        depth[i] = depth[up] + 1
    for n in nodes:
        for k, child in enumerate(n.children):
            order[place[id(child)]] = k
    siblings = np.array([len(n.parent.children) if n.parent else 1 for n in nodes], dtype=float)
    tags = np.array([[n.tag == t for t in TAGS] for n in nodes], dtype=float)
    numbers = np.stack([np.log1p(own), np.log1p(chars), linked / np.maximum(chars, 1), chars / below, np.log1p(below),
                        np.log1p(paragraphs), np.minimum(depth, 30), siblings.clip(max=50), order / siblings, chars / max(chars[0], 1)], axis=1)
    return np.concatenate([tags, hits, above, numbers], axis=1)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, with binned splits."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        #: Each tree is a list of (feature, cut) for inner nodes and values for leaves, by heap place.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        # rare flags have no inner quantile apart from their least value
        cuts = [c if len(c) > 1 else np.unique(np.append(c, (x[:, f].min() + x[:, f].max()) / 2)) for f, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        z = np.zeros(len(x))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            inner = 2**self.depth - 1
            feature, cut, value = np.zeros(inner, dtype=int), np.full(inner, np.inf), np.zeros(2**self.depth)
            at = np.zeros(len(x), dtype=int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = (1e-9, 0, np.inf, None)
                total, weight = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (total - gl) ** 2 / (weight - hl + 1) - total**2 / (weight + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, c[k], b > k)
                feature[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (best[3] if best[3] is not None else 0)
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            z += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        z, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += value[at - (2**self.depth - 1)]
        return z


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the blocks that are main text): layouts, tags and class names vary."""
    r = np.random.default_rng(seed)
    syllables = ["er", "on", "the", "an", "ti", "re", "ing", "ed", "ou", "é", "ña", "sch", "ly", "pre"]
    serial = 0

    def of(options):
        return options[int(r.integers(0, len(options)))]

    def words(low: int, high: int) -> str:
        nonlocal serial
        serial += 1
        return " ".join("".join(of(syllables) for _ in range(int(r.integers(1, 5)))) for _ in range(int(r.integers(low, high)))) + f" {serial}."

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(int(r.integers(low, high)))) + "</ul>"

    def wrap(tag: str, name: str, inner: str) -> str:
        return f'<{tag} {of(["class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    for _ in range(n):
        kept: set[str] = set()

        def block(tag: str, low: int, high: int) -> str:
            text = words(low, high)
            kept.add(text)
            return f"<{tag}>" + (f"<b>{text}<br>" if r.random() < 0.2 else f"{text}</{tag}>")

        main = block("h1", 2, 9) if r.random() < 0.9 else ""
        for _ in range(int(r.integers(0, 14))):
            kind = r.random()
            if kind < 0.75:
                main += block("p", 1, of([6, 40, 160]))
            elif kind < 0.82:
                main += block(of(["h2", "h3"]), 1, 6)
            elif kind < 0.9:
                main += "<ul>" + "".join(block("li", 1, 20) for _ in range(3)) + "</ul>"
            elif kind < 0.95:
                main += wrap("div", of(["ad", "ads", "advert", "related", "share"]), words(2, 30))
            else:
                main += f"<blockquote>{block('p', 3, 30)}</blockquote>"
        tag, name = of([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("section", "entry")])
        parts = [wrap(tag, name, main)]
        junk = [
            lambda: wrap("nav", of(["", "", "menu"]), links(2, 9)),
            lambda: wrap("div", of(["menu", "navbar", "breadcrumbs"]), links(2, 6)),
            lambda: wrap("header", of(["", "masthead"]), f"<h1>{words(1, 4)}</h1>" if r.random() < 0.5 else words(1, 8)),
            lambda: wrap("div", of(["ad", "ads", "sponsored", "advert"]), words(2, of([12, 60]))),
            lambda: wrap("div", of(["cookie-notice", "consent", "newsletter", "popup"]), f"<p>{words(4, 30)}</p>"),
        ]
        tail = [
            lambda: wrap("footer", of(["", "", "site-footer"]), of([words(2, 14), f"<p>{words(2, 14)}</p>", links(1, 5)])),
            lambda: wrap(of(["aside", "div"]), "sidebar", f"<h2>{words(1, 4)}</h2><p>{words(3, 40)}</p>" + links(1, 5)),
            lambda: wrap("aside", "", f"<p>{words(3, 40)}</p>"),
            lambda: wrap(of(["section", "div"]), of(["comments", "discussion"]), "".join(f'<div class="comment"><p>{words(2, 50)}</p></div>' for _ in range(3))),
            lambda: f"<form><label>{words(1, 4)}</label><p>{words(1, 6)}</p></form>",
        ] + junk[3:]
        parts = [f() for f in junk if r.random() < 0.6] + parts + [f() for f in tail if r.random() < 0.55]
        inner = "".join(parts)
        if r.random() < 0.25:
            inner = f'<div class="{of(["wrapper", "page", "container"])}">{inner}</div>'
        yield f"<!DOCTYPE html><html><head><title>x</title></head><body>{inner}</body></html>", kept


def _own(node: Node) -> str:
    return _space.sub(" ", "".join(t for _, t in node.parts)).strip()


def _labels(nodes: list[Node], kept: set[str]) -> np.ndarray:
    """1 for blocks of main text and the containers of such."""
    y = np.array([_own(n) in kept for n in nodes], dtype=float)
    place = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[place[id(nodes[i].parent)]] = 1
    return y


@lru_cache(1)
def trained() -> Boosted:
    """The trees; the same wherever they are trained."""
    x, y = [], []
    for html, kept in labelled_pages(500, 3):
        nodes = Tree(html).nodes
        x.append(_features(nodes))
        y.append(_labels(nodes, kept))
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The subset closed towards the root with the largest sum of log-odds."""
    place = {id(n): i for i, n in enumerate(nodes)}
    # a node without text of its own and without children decides nothing
    gain = np.where([bool(n.parts) or bool(n.children) for n in nodes], margin, 0.0)
    for i in range(len(nodes) - 1, 0, -1):
        gain[place[id(nodes[i].parent)]] += max(0.0, gain[i])
    kept = [bool(gain[0] > 0)]
    for i, n in enumerate(nodes[1:], 1):
        kept.append(kept[place[id(n.parent)]] and bool(gain[i] > 0))
    return kept


def blocks(nodes: list[Node], kept: list[bool]) -> list[str]:
    """Kept texts in page order: a block's own text is cut where child blocks stand."""
    out = []
    place = {id(n): i for i, n in enumerate(nodes)}
    cut: dict[int, dict[int, list[str]]] = {}
    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        node, at = stack.pop()
        if kept[place[id(node)]]:
            if at == 0:
                cut[place[id(node)]] = grouped = {}
                for k, t in node.parts:
                    grouped.setdefault(k, []).append(t)
            text = _space.sub(" ", "".join(cut[place[id(node)]].get(at, ()))).strip()
            if text:
                out.append(text)
        if at < len(node.children):
            stack += [(node, at + 1), (node.children[at], 0)]
    return out


def main_text(html: str | None, model: Boosted) -> str:
    if not html:
        return ""
    nodes = Tree(html).nodes
    return "\n".join(blocks(nodes, decode(nodes, model.margin(_features(nodes)))))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each row's whole html."""
    held = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, held.value) for h in column], dtype=object)

    return pages.withColumn(out, of(F.col(html)))
