"""Pages as trees of blocks, and what a classifier sees of each node.

``parse`` reads tags leniently (unclosed and crossed tags, unquoted attributes, a page cut off
anywhere) into block elements in page order; inline markup belongs to the text around it.  A leaf
is a run of text between block borders, its character references decoded and its white space turned
into single spaces.  What is never shown (scripts, styles, templates, hidden elements, controls)
holds no text.  In page order a subtree is a range of nodes, so all subtree statistics are
differences of running sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("noscript template svg math object canvas audio video map select datalist button dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: kinds of elements that the classifier tells apart
KINDS = {
    "text": (), "heading": tuple(HEADINGS), "paragraph": ("p",), "item": ("li", "dt", "dd"), "list": ("ul", "ol", "dl", "menu", "dir"),
    "table": ("table", "thead", "tbody", "tfoot", "tr", "caption"), "cell": ("td", "th"), "article": ("article", "main"), "section": ("section", "hgroup", "details", "summary"),
    "box": ("div", "center", "fieldset"), "quote": ("blockquote", "pre", "address"), "figure": ("figure", "figcaption"),
    "nav": ("nav", "search"), "header": ("header",), "footer": ("footer",), "aside": ("aside",), "form": ("form", "legend", "optgroup", "option"),
}
_KIND = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags}
BLOCK = frozenset(_KIND)
#: starts that end an open paragraph
_ENDS_P = BLOCK - frozenset("thead tbody tfoot tr td th caption summary legend option optgroup".split()) | {"hr"}
#: start tag: (the open elements it ends, the ones that stop the search)
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset("thead tbody tfoot caption".split()), frozenset(["table"]))),
}
#: words in class, id and role by what they tell
FAMILIES = {
    "main": "article content contents entry post story main body text prose document page-content maincontent articlebody post-body copy",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs links sitemap skip",
    "header": "header masthead top topbar banner logo branding hero site-header",
    "footer": "footer foot bottom colophon copyright legal imprint contentinfo",
    "side": "sidebar side aside widget widgets rail complementary column-right secondary",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay dialog announcement paywall message banner-notice disclaimer",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted commercial outbrain taboola adsense dfp partner",
    "form": "form search login signin signup subscribe subscription newsletter register contact input field survey poll",
    "comment": "comment comments commentlist respond reply replies discussion disqus thread feedback reviews commentary",
    "share": "share sharing social follow like tweet facebook twitter toolbar tools actions buttons print",
    "related": "related recommended recommendations more popular trending latest similar also read-next teaser teasers",
    "meta": "meta byline author date time published timestamp tags tag category categories label labels credit",
    "wrap": "wrapper wrap container page site layout row col column grid inner outer root app",
}
_TOKEN = {w: 1 << i for i, words in enumerate(FAMILIES.values()) for w in words.split()}
_NAMES = list(FAMILIES)
_BY_TAG = {tag: 1 << _NAMES.index(name) for tag, name in (("article", "main"), ("main", "main"), ("nav", "nav"), ("search", "form"), ("header", "header"), ("footer", "footer"), ("aside", "side"), ("form", "form"))}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)|<(?:[!?/])[^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attribute_families(attributes: str) -> tuple[int, bool]:
    """(families of the words in class, id and role, as bits; whether the element is hidden)."""
    bits, hidden = 0, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for part in value.lower().split():
                bits |= _TOKEN.get(part, 0)
            for word in _WORDS.findall(value):
                bits |= _TOKEN.get(word.lower(), 0)
        elif name == "hidden" or name == "style" and _UNSEEN.search(value):
            hidden = True
    return bits, hidden


@dataclass
class Tree:
    """Nodes in page order: parent, first node after the subtree, kind, families, families above, text and its characters inside links."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, kind: int, own: int, text: str | None = None, linked: int = 0) -> int:
        i = len(self.parent)
        self.parent.append(parent)
        self.end.append(i + 1)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.own.append(own)
        self.above.append(self.above[parent] | self.own[parent] if parent >= 0 else 0)
        self.text.append(text)
        self.linked.append(linked)
        return i


def parse(html: str) -> Tree:
    """The tree of a page; node 0 is the whole page."""
    tree = Tree()
    root = tree.add(-1, _KIND["div"], 0)
    # open elements: (tag, node or that of the block around it, hidden)
    stack: list[tuple[str, int, bool]] = [("", root, False)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    link_at = 0  # stack size at which the open link began, 0 if none

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                tree.add(stack[-1][1], 0, 0, text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal link_at
        flush()
        tag, node, _ = stack.pop()
        opened[tag] -= 1
        if tag in BLOCK:
            tree.end[node] = len(tree.parent)
        if link_at > len(stack):
            link_at = 0

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        stop = m.start() if m else size
        if stop > at and not stack[-1][2]:
            text = unescape(html[at:stop])
            pieces.append(text)
            if link_at:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link_at = 0
            elif opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in ("p", "br"):
                pieces.append("\n")
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else size
            continue
        if tag in _ENDS_P and stack[-1][0] == "p":
            pop()
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            pop()
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            if any(opened.get(t) for t in ends):
                k = len(stack) - 1
                while k and stack[k][0] not in ends and stack[k][0] not in stops:
                    k -= 1
                if stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
        if tag == "a":
            link_at = len(stack)
        elif tag == "br":
            pieces.append("\n")
        elif tag == "hr":
            flush()
        elif tag in VOID:
            continue
        elif tag in HIDDEN:
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, stack[-1][1], True))
        elif tag in BLOCK:
            flush()
            bits, unseen = attribute_families(m[3]) if m[3] else (0, False)
            node = tree.add(stack[-1][1], _KIND[tag], bits | _BY_TAG.get(tag, 0))
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, node, unseen or stack[-1][2]))
    while len(stack) > 1:
        pop()
    flush()
    tree.end[root] = len(tree.parent)
    return tree


_STOPS = re.compile(r"[.,;:!?。、！？،؛।]")
_DIGITS = re.compile(r"\d")
_RIGHTS = re.compile("©|\\(c\\)|copyright|all rights reserved", re.I)

_PLAIN = [
    "chars", "words", "leaves", "nodes", "longest", "link_share", "density", "mean_leaf", "stops_a_word", "digit_share", "rights", "long_share",
    "depth", "depth_share", "siblings", "place", "place_share", "parent_share", "page_share", "starts_at", "ends_at", "page_chars", "page_leaves",
    "before_chars", "before_links", "after_chars", "after_links", "same_siblings", "sibling_mean",
]
FEATURES = [*_PLAIN, *(f"is_{k}" for k in KINDS), *(f"own_{n}" for n in FAMILIES), *(f"above_{n}" for n in FAMILIES)]


def features(trees: list[Tree]) -> np.ndarray:
    """One row of FEATURES for each node of the trees, in order."""
    sizes = np.array([len(t.parent) for t in trees])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    page = np.repeat(np.arange(len(trees)), sizes)
    base = first[page]
    flat = lambda name, kind=np.int64: np.fromiter((v for t in trees for v in getattr(t, name)), kind, n)
    parent, end, depth, kind, own, above, linked = (flat(name) for name in ("parent", "end", "depth", "kind", "own", "above", "linked"))
    top = parent < 0
    parent, end = np.where(top, np.arange(n), parent + base), end + base
    texts = [v or "" for t in trees for v in t.text]
    count = lambda f: np.fromiter((f(v) if v else 0 for v in texts), np.float64, n)
    length = count(len)
    at = np.arange(n)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[end] - total[at]

    leaf = (length > 0).astype(float)
    chars, words, leaves = below(length), below(count(lambda v: v.count(" ") + 1)), below(leaf)
    links, stops, digits = below(linked), below(count(lambda v: len(_STOPS.findall(v)))), below(count(lambda v: len(_DIGITS.findall(v))))
    rights = below(count(lambda v: _RIGHTS.search(v) is not None))
    long = below(np.where(length >= 100, length, 0))
    nodes = (end - at).astype(float)
    # the longest leaf below: leaves in page order, a range maximum by doubling
    longest = range_maximum(length, at, end)
    link_share = links / np.maximum(chars, 1)
    # siblings: children of a parent in page order
    child = ~top
    key = np.where(child, parent, n)
    order = np.argsort(key, kind="stable")
    run = key[order]
    start = np.searchsorted(run, run)
    place = np.empty(n)
    place[order] = at - start
    siblings = np.bincount(parent[child], minlength=n)[parent].astype(float)
    siblings[top] = 1
    place[top] = 0
    neighbour = lambda step: _neighbours(order, run, step, n)
    before, after = neighbour(-1), neighbour(1)
    pick = lambda values, where: np.where(where >= 0, values[where], -1)
    chars_log = np.log1p(chars)
    same = np.unique(np.stack([key, kind]), axis=1, return_inverse=True, return_counts=True) if n else None
    alike = same[2][same[1].ravel()].astype(float) if n else np.zeros(0)
    alike[top] = 1
    whole, depths = chars[first[:-1]][page] if n else chars, np.maximum.reduceat(depth, first[:-1])[page] if n else depth
    ahead = np.concatenate([[0.0], np.cumsum(length)])
    begins = ahead[at] - ahead[base]
    columns = [
        chars_log, np.log1p(words), np.log1p(leaves), np.log1p(nodes), np.log1p(longest), link_share, np.log1p(chars / nodes), np.log1p(chars / np.maximum(leaves, 1)),
        stops / np.maximum(words, 1), digits / np.maximum(chars, 1), rights > 0, long / np.maximum(chars, 1),
        depth, depth / np.maximum(depths, 1), np.log1p(siblings), place, place / np.maximum(siblings - 1, 1), chars / np.maximum(chars[parent], 1), chars / np.maximum(whole, 1),
        begins / np.maximum(whole, 1), (begins + chars) / np.maximum(whole, 1), np.log1p(whole), np.log1p(leaves[base]) if n else leaves,
        pick(chars_log, before), pick(link_share, before), pick(chars_log, after), pick(link_share, after), np.log1p(alike), np.log1p(chars[parent] / siblings),
    ]
    bits = [(v >> i & 1) for v in (own, above) for i in range(len(FAMILIES))]
    return np.column_stack([np.asarray(c, np.float32) for c in (*columns, *(kind == i for i in range(len(KINDS))), *bits)])


def _neighbours(order: np.ndarray, run: np.ndarray, step: int, n: int) -> np.ndarray:
    """The sibling before (-1) or after (1) each node, -1 if there is none."""
    found = np.full(n, -1)
    if n > 1:
        a, b = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
        same = (run[a] == run[b]) & (run[a] < n)
        found[order[a][same]] = order[b][same]
    return found


def range_maximum(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """max(values[start[i]:end[i]]) of non-empty ranges, from maxima over powers of two."""
    if not len(values):
        return np.zeros(0)
    out = np.empty(len(start))
    power = np.frexp(end - start)[1] - 1
    table = values
    for k in range(int(power.max()) + 1):
        here = np.flatnonzero(power == k)
        out[here] = np.maximum(table[start[here]], table[end[here] - (1 << k)])
        if len(table) > 1 << k:
            table = np.maximum(table[: len(table) - (1 << k)], table[1 << k :])
    return out
