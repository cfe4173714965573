"""Main text of web pages: boosted trees over DOM-node features with hierarchical decoding.

A page is parsed to a tree of elements (implied ends of p, li and the like, void and
raw-text elements, unclosed elements at the end). A run of text directly in the root,
html or body is a leaf of its own, judged like an element. Each element gets features of its
tag, the words of its class, id and role, its depth, its subtree's text and link
density, and its siblings. Gradient-boosted trees give each element's log odds of
being part of the article. Decoding then chooses keep or drop for all elements at
once, the best sum of log probabilities such that whatever stands below a dropped
element is dropped: a bottom-up pass sums each subtree's best score both ways, a
top-down pass reads the choice. The kept blocks' text is joined.

The trees are trained here, on pages a small generator lays out in many ways with
the nature of each element known; the generator's size is a parameter, the seed is
fixed.

Defined results: a null, empty or blank page has empty text. Scripts, styles,
comments and the like are never text. ``n_chars`` counts code points. Rows are
handled one by one: repeated rows, ties, empty tables and further columns change
nothing. Deep nesting and very long pages are handled without recursion.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches, table, texts_of

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER_TEXT = RAW | frozenset("head template svg math object audio video canvas select option button".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
FOREIGN = frozenset(("svg", "math"))
#: An open element of the first kind ends when one of the second begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_EDGES = frozenset("ul ol dl table menu dir select".split())

#: Markup at a "<": a comment, a tag whose quoted values may hold ">", an end, anything else of the kind.
_MARKUP = re.compile(r"<!--(?:>|->|.*?-->|.*\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"']))|(?<!=)[\"'])*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/a-zA-Z][^>]*+>", re.S)
#: The same where quotes don't pair up: a tag ends at the next ">".
_UNQUOTED = re.compile(r"<!--(?:>|->|.*?-->|.*\Z)|<([a-zA-Z][^\s/>]*+)([^>]*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/a-zA-Z][^>]*+>", re.S)
#: Elements open at once; one further down stands beside the last of them, as in browsers.
DEPTH = 512
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD = re.compile(r"[a-z]+")


#: The page itself; its elements and runs of text are judged.
_PAGE = frozenset(("#root", "html", "body"))


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    attributes: str = ""
    items: list = field(default_factory=list)  # strings and numbers of child nodes, in order


def parse(page: str) -> list[Node]:
    """Elements, and runs of text directly in the page, in document order; the root is first.

    Takes time in proportion to the page: past the last ">" nothing is markup, and once a tag's quotes
    are found not to pair up before the end of the page, quotes no longer hide a ">".
    """
    nodes = [Node("#root", -1)]
    stack, names, foreign = [0], ["#root"], 0
    at, size, last = 0, len(page), page.rfind(">")
    markup, began = _MARKUP, 0  # the present text's begin

    def text(upto: int) -> None:
        if upto > began:
            own, run = stack[-1], html.unescape(page[began:upto])
            if nodes[own].tag in _PAGE and run.strip(" \t\r\n\f\v\xa0\ufeff"):
                nodes.append(Node("#text", own, items=[run]))
                run = len(nodes) - 1
            nodes[own].items.append(run)

    while True:
        at = page.find("<", at)
        if at < 0 or (at > last and not page.startswith("<!--", at)):
            text(size)
            return nodes
        found = markup.match(page, at)
        if found is not None and not found[1] and markup is _MARKUP and page[at + 1].isalpha():
            markup = _UNQUOTED
            found = markup.match(page, at)
        if found is None:
            at += 1
            continue
        text(at)
        at = began = found.end()
        name, end = found[1], found[3]
        if name:
            name = name.lower()
            if name in ENDS_P:
                _close(stack, names, {"p"}, BLOCKS - {"p"})
            if name in IMPLIED:
                _close(stack, names, IMPLIED[name], LIST_EDGES)
            nodes.append(Node(name, stack[-1], found[2]))
            me = len(nodes) - 1
            nodes[stack[-1]].items.append(me)
            if name in RAW:
                ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", ends.end()) if ends else -1
                at = began = close + 1 if close >= 0 else size
            elif name not in VOID and len(stack) < DEPTH:
                foreign = foreign or (len(stack) if name in FOREIGN else 0)
                if not (foreign and found[2].endswith("/")):  # only foreign elements can be closed at once
                    stack.append(me), names.append(name)
        elif end:
            end = end.lower()
            for depth in range(len(stack) - 1, 0, -1) if end in names else ():
                if names[depth] == end:
                    del stack[depth:], names[depth:]
                    break
                if end not in BLOCKS and names[depth] in BLOCKS:
                    break  # an inline end doesn't close blocks
        if foreign >= len(stack):
            foreign = 0


def _close(stack: list[int], names: list[str], tags: set[str], edges: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if names[depth] in tags:
            del stack[depth:], names[depth:]
            return
        if names[depth] in edges:
            return


# Attribute words by what they tend to mark: fixed values.
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead banner topbar brand logo hero site",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular more links",
    "ad": "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored sponsors commercial dfp",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe subscription paywall message toast overlay warning",
    "comment": "comment comments discussion reply replies disqus respond reader readers thread feedback",
    "form": "form search login signin signup register contact input",
    "share": "share sharing social follow facebook twitter tags meta byline author date",
    "main": "main content article post entry story body text page primary maincontent prose",
}
_GROUP_OF = {w: g for g, ws in enumerate(GROUPS.values()) for w in ws.split()}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tr td th figure figcaption header footer nav aside form a span b strong i em code label address details #text".split()
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
N_GROUPS, N_TAGS = len(GROUPS), len(TAGS)


@lru_cache(4096)
def attribute_groups(attributes: str) -> tuple[int, ...]:
    out = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            out.update(_GROUP_OF[w] for w in _WORD.findall((a or b or c).lower()) if w in _GROUP_OF)
    return tuple(out)


OVER = (("nav",), ("header",), ("footer",), ("aside",), ("form",), ("article", "main"))
_OVER_OF = {t: k for k, ts in enumerate(OVER) for t in ts}
_BLOCK_TAGS = frozenset("p h1 h2 h3 blockquote pre".split())
_INPUT_TAGS = frozenset("input button select textarea form label".split())


@dataclass
class Forest:
    """The elements of many pages in a row: parents (of roots: themselves), depths and the elements of each depth."""

    nodes: list[Node]
    parent: np.ndarray
    levels: list[np.ndarray]
    starts: list[int]

    @classmethod
    def of(cls, pages: list[list[Node]]) -> Forest:
        starts = np.cumsum([0, *map(len, pages)]).tolist()
        nodes = [x for page in pages for x in page]
        parent = np.array([x.parent + at if x.parent >= 0 else at for page, at in zip(pages, starts, strict=False) for x in page], np.int64)
        depth = [0] * len(nodes)
        for i, p in enumerate(parent.tolist()):
            if p != i:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(np.asarray(depth)[order])) + 1)
        return cls(nodes, parent, levels, starts)


def node_features(forest: Forest) -> np.ndarray:
    """A row an element: tag, attribute words (own and above), depth, subtree sums, siblings."""
    nodes, parent, levels = forest.nodes, forest.parent, forest.levels
    n = len(nodes)
    tags, over_rows, over_kinds, own_rows, own_kinds, texts, hidden = [], [], [], [], [], [], [False] * n
    parents = parent.tolist()
    for i, x in enumerate(nodes):
        tag = x.tag
        tags.append(_TAG_OF.get(tag, N_TAGS))
        if tag in NEVER_TEXT or hidden[parents[i]]:
            hidden[i] = True
        if tag in _OVER_OF:
            over_rows.append(i), over_kinds.append(_OVER_OF[tag])
        if x.attributes:
            for g in attribute_groups(x.attributes):
                own_rows.append(i), own_kinds.append(g)
        chars = words = stops = 0
        if not hidden[i]:
            for t in x.items:
                if t.__class__ is str:
                    chars += len(t)
                    words += t.count(" ") + (not t.isspace())
                    stops += t.count(".") + t.count(",")
        texts.append((chars, chars if tag == "a" else 0, words, stops, tag in _BLOCK_TAGS, tag in _INPUT_TAGS, tag == "a"))
    tags, sums = np.array(tags), np.array(texts, np.float64).reshape(n, 7)
    own = np.zeros((n, N_GROUPS))
    own[own_rows, own_kinds] = 1
    over = np.zeros((n, len(OVER)), bool)
    over[over_rows, over_kinds] = True
    above, depth = own.copy(), np.zeros(n)
    for d, level in enumerate(levels[1:], 1):
        above[level] = np.maximum(above[level], above[parent[level]])
        over[level] |= over[parent[level]]
        depth[level] = d
    is_link = tags == _TAG_OF["a"]
    for level in levels[:0:-1]:
        inside = level[is_link[level]]
        sums[inside, 1] = sums[inside, 0]
        np.add.at(sums, parent[level], sums[level])
    chars, links, words, stops, blocks, inputs, anchors = sums.T
    child = np.flatnonzero(parent != np.arange(n))
    count = np.bincount(parent[child], minlength=n)
    by_parent = child[np.argsort(parent[child], kind="stable")]
    first = np.r_[True, np.diff(parent[by_parent]) > 0] if len(by_parent) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    place = np.zeros(n)
    place[by_parent] = np.arange(len(by_parent)) - np.repeat(heads, np.diff(np.r_[heads, len(by_parent)]))
    up = parent
    root = np.repeat(forest.starts[:-1], np.diff(forest.starts))
    total = np.maximum(1.0, chars[root])
    tag_hot = np.zeros((n, N_TAGS + 1))
    tag_hot[np.arange(n), tags] = 1
    rest = np.stack(
        [
            np.minimum(depth, 30), np.log1p(chars), chars / total, links / np.maximum(chars, 1), np.log1p(words), stops / np.maximum(words, 1), np.log1p(blocks), np.log1p(inputs), np.log1p(anchors), anchors / np.maximum(words, 1),
            np.log1p(count), count[up], place / np.maximum(count[up], 1), np.log1p(chars[up]), chars / np.maximum(chars[up], 1), links[up] / np.maximum(chars[up], 1), stops[up] / np.maximum(words[up], 1), np.log1p(blocks[up]),
        ],
        1,
    )
    return np.hstack([tag_hot, own, above, over, rest])


# --- gradient-boosted trees ---------------------------------------------------


@dataclass
class Trees:
    """Each tree is complete: ``features`` and ``cuts`` of its inner nodes in breadth-first order, and leaf values."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        inner = self.features.shape[1]
        levels, wide = inner.bit_length(), x.shape[1]
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 2048):  # stays in cache
            part = x[start : start + 2048]
            flat, rows = np.ascontiguousarray(part).reshape(-1), np.arange(len(part)) * wide
            for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
                at = (flat.take(rows + f[0]) > c[0]) + np.int64(1)
                for _ in range(levels - 1):
                    at = 2 * at + 1 + (flat.take(rows + f.take(at)) > c.take(at))
                out[start : start + 2048] += v.take(at - inner)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over binned features, complete trees."""
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(x[:, k])) > bins else np.unique(x[:, k])[:-1]
        cuts.append(values[:bins])
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1).astype(np.int64)
    rate_of = y.mean()
    base = float(np.log(rate_of / (1 - rate_of)))
    f = np.full(len(y), base)
    inner, width = 2**depth - 1, bins + 1
    all_f, all_c, all_v = [], [], []
    flat = binned + np.arange(x.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, cut, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 8:
                    continue
                keys = flat[rows].reshape(-1)
                gs = np.bincount(keys, np.repeat(g[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(keys, np.repeat(h[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                k, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[k, b] > 1e-6 and b < len(cuts[k]):
                    feature[node], cut[node], cut_bin[node] = k, cuts[k][b], b
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut_bin[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        f += value[leaf]
        all_f.append(feature), all_c.append(cut), all_v.append(value)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_v), base)


# --- training pages -----------------------------------------------------------


class Layouts:
    """Lays out pages in many ways; each element is marked (by an attribute the features don't see) as article or not."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(["ba", "te", "ri", "no", "lu", "ska", "ve", "é", "der", "ing"]) for _ in range(self.rng.randrange(1, 5)))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        w = [self.word() for _ in range(self.rng.randrange(least, most))]
        return (" ".join(w)).capitalize() + self.rng.choice([".", ".", ".", "!", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randrange(1, 7)))

    def tag(self, name: str, mark: int, body: str, words: str = "") -> str:
        style = self.rng.random()
        attributes = f' class="{words}"' if words and style < 0.7 else f' id="{words}"' if words else ""
        return f'<{name}{attributes} data-y="{mark}">{body}</{name}>'

    def links(self, n: int, mark: int) -> str:
        kind = self.rng.random()
        each = [self.tag("a", mark, self.word() if kind < 0.8 else self.sentence(2, 6)) for _ in range(n)]
        if kind < 0.6:
            return self.tag("ul", mark, "".join(self.tag("li", mark, x) for x in each))
        return self.rng.choice([" | ", " ", " · "]).join(each)

    def block(self, mark: int, rich: bool = True) -> str:
        r = self.rng.random()
        if r < 0.62 or not rich:
            body = self.prose() if self.rng.random() < 0.85 else self.sentence(1, 5)
            if self.rng.random() < 0.25:
                body += " " + self.tag(self.rng.choice(["a", "b", "em", "i", "strong", "span", "code"]), mark, self.sentence(1, 4)) + " " + self.sentence(1, 8)
            if self.rng.random() < 0.1:
                body = self.tag("b", mark, body)
            return self.tag("p" if self.rng.random() < 0.92 else "div", mark, body)
        if r < 0.72:
            return self.tag(self.rng.choice(["h2", "h3", "h4"]), mark, self.sentence(1, 8))
        if r < 0.8:
            return self.tag(self.rng.choice(["ul", "ol"]), mark, "".join(self.tag("li", mark, self.sentence(1, 14)) for _ in range(self.rng.randrange(1, 7))))
        if r < 0.86:
            return self.tag("blockquote", mark, self.tag("p", mark, self.prose()) if self.rng.random() < 0.6 else self.prose())
        if r < 0.9:
            return self.tag("pre", mark, self.sentence())
        if r < 0.95:
            rows = "".join(self.tag("tr", mark, "".join(self.tag("td", mark, self.sentence(1, 4)) for _ in range(3))) for _ in range(self.rng.randrange(1, 5)))
            return self.tag("table", mark, rows)
        return self.tag("figure", mark, "<img src=x>" + self.tag("figcaption", mark, self.sentence()))

    def junk(self) -> str:
        """Something that isn't the article."""
        pick, few = self.rng.choice, self.rng.randrange(1, 9)
        kind = self.rng.randrange(9)
        sayings = lambda n: "".join(self.tag(pick(["p", "div", "span"]), 0, self.sentence(2, 14)) for _ in range(n))
        name = lambda group: pick(GROUPS[group].split())
        if kind == 0:
            return self.tag("nav", 0, self.links(few, 0), pick(["", name("nav")])) if self.rng.random() < 0.6 else self.tag("div", 0, self.links(few, 0), name("nav"))
        if kind == 1:
            return self.tag(pick(["header", "div"]), 0, self.tag("h1", 0, self.sentence(1, 4)) * self.rng.randrange(2) + self.links(few, 0) + self.tag("p", 0, self.sentence(2, 6)), pick(["header", "masthead", "topbar", "site-header"]))
        if kind == 2:
            body = pick(["&copy; ", ""]) + self.sentence() + (self.links(few, 0) if self.rng.random() < 0.5 else "")
            return self.tag("footer", 0, body) if self.rng.random() < 0.6 else self.tag("div", 0, sayings(2), pick(["footer", "copyright", "legal", "page-footer"]))
        if kind == 3:
            body = self.tag(pick(["h3", "h4", "div"]), 0, self.sentence(1, 4)) + (self.links(few, 0) if self.rng.random() < 0.6 else sayings(few))
            return self.tag("aside", 0, body, pick(["", name("side")])) if self.rng.random() < 0.5 else self.tag(pick(["div", "section"]), 0, body, pick(["sidebar", "related", "widget", "right-rail", "recommended", "more-stories", "popular"]))
        if kind == 4:
            return self.tag(pick(["div", "div", "aside", "section", "p"]), 0, pick([sayings(self.rng.randrange(1, 4)), self.sentence(3, 30), self.prose()]), pick(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "ad-box", "banner-ad"]))
        if kind == 5:
            return self.tag(pick(["div", "section", "p", "aside"]), 0, pick([sayings(2), self.prose(), self.sentence()]) + (self.tag("a", 0, self.word()) if self.rng.random() < 0.4 else ""), pick(["notice", "cookie", "cookie-consent", "alert", "newsletter", "gdpr-notice", "subscribe", "popup"]))
        if kind == 6:
            comments = "".join(self.tag(pick(["div", "li", "article"]), 0, self.tag("b", 0, self.word()) + self.tag("p", 0, self.prose()), pick(["comment", "reply", ""])) for _ in range(self.rng.randrange(1, 6)))
            return self.tag(pick(["section", "div", "ol"]), 0, self.tag("h3", 0, self.sentence(1, 3)) * self.rng.randrange(2) + comments, pick(["comments", "discussion", "responses comments", "reader-comments", "replies"]))
        if kind == 7:
            return self.tag("form", 0, self.tag("label", 0, self.sentence(1, 5)) + "<input name=q>" + self.tag("p", 0, self.sentence()) * self.rng.randrange(2), pick(["", "search", "signup", "contact"]))
        return self.tag(pick(["div", "ul", "p"]), 0, self.links(few, 0), pick(["share", "social", "tags", "share-links"]))

    def page(self) -> str:
        pick, chance = self.rng.choice, self.rng.random
        blocks = [self.tag(pick(["h1", "h1", "h2"]), 1, self.sentence(1, 12))] if chance() < 0.85 else []
        rich = chance() < 0.6
        blocks += [self.block(1, rich) for _ in range(self.rng.randrange(1, pick([3, 8, 20])))]
        for _ in range(pick([0, 0, 0, 1, 2])):
            blocks.insert(self.rng.randrange(len(blocks) + 1), self.junk())
        if chance() < 0.15:
            blocks[0] = self.tag("header", 1, blocks[0])
        body = "".join(blocks)
        if chance() < 0.25:
            body = self.tag(pick(["div", "section"]), 1, body, pick(["", "content", "body", "entry-content"]))
        holder = pick(["article", "article", "article", "main", "div", "div", "section", "td"])
        plain = holder in ("div", "section", "td")
        body = self.tag("div" if holder == "td" else holder, 1, body, pick(["content", "main", "post", "article", "story-body", "entry", ""]) if plain else pick(["", "", "post"]))
        if chance() < 0.3:
            body = self.tag(pick(["main", "div", "section"]), 1, body + "".join(self.junk() for _ in range(pick([0, 0, 1, 2]))), pick(["", "content", "page", "wrapper"]))
        before, after = ("".join(self.junk() for _ in range(self.rng.randrange(0, 5))) for _ in range(2))
        return f'<html data-y="1"><body data-y="1">{before}{body}{after}</body></html>'


    def bare(self) -> str:
        """A page or fragment whose article is text directly in it, with line breaks or blocks between; each run of text is in a RUN element."""
        pick, chance = self.rng.choice, self.rng.random
        run = lambda mark, text: self.tag(RUN, mark, text)
        inline = lambda: self.tag(pick(["a", "b", "em", "i", "strong", "span", "font"]), 1, self.sentence(1, 4))
        gap = pick(["<br>", "<br><br>", "<br/>\n", "<hr>"])
        parts = [self.tag(pick(["h1", "h2", "b"]), 1, self.sentence(1, 12)) + "<br>"] if chance() < 0.5 else []
        for _ in range(self.rng.randrange(1, pick([2, 6, 14]))):
            text = run(1, self.prose() if chance() < 0.8 else self.sentence(1, 8))
            if chance() < 0.3:
                text += " " + inline() + " " + run(1, self.sentence(2, 16))
            parts.append(text + gap if chance() < 0.8 else text + self.block(1))
        if chance() < 0.25:
            parts.insert(self.rng.randrange(len(parts) + 1), self.junk())
        if chance() < 0.2:
            return "".join(parts)
        bars = lambda: pick([" | ", " · ", " - "]).join("\0" for _ in range(self.rng.randrange(2, 7)))

        def menu() -> str:
            """Links with bare separators between, or a bare line of the site's own."""
            if chance() < 0.6:
                pieces = bars().split("\0")
                return self.tag("a", 0, self.word()).join(run(0, x) if x else "" for x in pieces) + pick(["<br>", "<hr>"])
            return pick(["<hr>", "<br><br>"]) + run(0, pick(["&copy; ", "Copyright ", ""]) + self.sentence(1, 5)) + self.tag("a", 0, self.word()) + "<br>"

        extra = lambda: "".join(menu() if chance() < 0.4 else self.junk() for _ in range(pick([0, 0, 1, 2])))
        body = extra() + "".join(parts) + extra()
        return f'<html data-y="1"><body data-y="1">{body}</body></html>' if chance() < 0.7 else body


#: Stands around a run of text directly in a generated page, to carry its mark.
RUN = "t-run"
_RUN = re.compile(rf"</?{RUN}\b[^>]*>")
_MARK = re.compile(r'data-y="(\d)"')
_TREES: dict[int, Trees] = {}


def marked(page: str) -> list[Node]:
    """The elements of a generated page, RUN elements as the runs of text they stand around."""
    nodes = parse(page)
    for x in nodes:
        if x.tag == RUN:
            x.tag = "#text"
    return nodes


def train(pages: int = 500, seed: int = 7) -> Trees:
    """Trees from generated pages, and half as many of bare text; kept, as the same numbers give the same trees."""
    if pages not in _TREES:
        made, bare, xs, ys = Layouts(seed), Layouts(seed + 1), [], []
        for text in [*(made.page() for _ in range(pages)), *(bare.bare() for _ in range(pages // 2))]:
            nodes = marked(text)
            marks = [int(m[1]) if (m := _MARK.search(x.attributes)) else -1 for x in nodes]
            keep = np.array(marks) >= 0
            xs.append(node_features(Forest.of([nodes]))[keep])
            ys.append(np.array(marks)[keep])
        _TREES[pages] = boost(np.vstack(xs), np.concatenate(ys).astype(float))
    return _TREES[pages]


def decode(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """The most likely keep or drop of each element, where nothing below a dropped element is kept."""
    parent, levels = forest.parent, forest.levels
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    fixed = np.array([1 if x.tag in _PAGE else -1 if x.tag in NEVER_TEXT else 0 for x in forest.nodes])
    keep[fixed == 1], drop[fixed == 1] = 0.0, -1e9  # the page itself; its elements are judged
    keep[fixed == -1], drop[fixed == -1] = -1e9, 0.0
    for level in levels[:0:-1]:
        np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
        np.add.at(drop, parent[level], np.maximum(drop[level], -1e9))
    kept = keep >= drop
    for level in levels[1:]:
        kept[level] &= kept[parent[level]]
    return kept


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """Blocks in page order, white space within one turned to one space."""
    blocks: list[list[str]] = [[]]
    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, at = todo.pop()
        x = nodes[i]
        block = x.tag in BLOCKS
        if at == 0 and block:
            blocks.append([])
        for k in range(at, len(x.items)):
            item = x.items[k]
            if isinstance(item, str):
                blocks[-1].append(item)
                continue
            if nodes[item].tag == "br":
                blocks[-1].append(" ")
            elif kept[item]:
                todo += [(i, k + 1), (item, 0)]
                break
            elif nodes[item].tag in BLOCKS:
                blocks.append([])
        else:
            if block:
                blocks.append([])
    lines = (" ".join("".join(parts).split()) for parts in blocks if parts)
    return "\n".join(line for line in lines if line)


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    trees_of = [parse(p) if p and not p.isspace() else [Node("#root", -1)] for p in pages]
    if not trees_of:
        return []
    forest = Forest.of(trees_of)
    kept = decode(forest, trees.log_odds(node_features(forest)))
    return [text_of(nodes, kept[at : at + len(nodes)].tolist()) for nodes, at in zip(trees_of, forest.starts, strict=False)]


def main_text(page: str, trees: Trees) -> str:
    return main_texts([page], trees)[0]


def extract(pages: DataFrame, trees: Trees | None = None, html_column: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``(carried columns, text, n_chars)``, a row a row."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or train())  # a fixed number of trees
    names = list(carry)

    def make():
        trees = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = main_texts(texts_of(batch.column(len(names))), trees)
            return pa.RecordBatch.from_pydict({**{c: batch.column(i) for i, c in enumerate(names)}, "text": pa.array(texts, pa.string())})

        return run

    plain = pages.select(*names, F.col(html_column).cast("string").alias("_html"))
    return map_batches(plain, make, plain.drop("_html").schema.add("text", "string"), rows=128).withColumn("n_chars", F.length("text").cast("long"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
