"""Main text of web pages from flat text blocks and a decision tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?][^>]*|(?!)()()()", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|rel)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements whose content is no text of the page.
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "option", "textarea", "title", "head", "canvas", "audio", "video", "button", "datalist"}
_SOURCE = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "math", "canvas", "select", "object", "audio", "video", "datalist"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "input"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end where the next of their name begins.
_ITEMS = {"li", "dt", "dd", "tr", "td", "th", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that leave no gap in the text around them.
_UNSEEN = {"script", "style", "template", "noscript"}
#: Elements that stand for a part of a page other than its article.
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "address"}
_ASIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "note"}
#: Parts of names that elements beside the article have, and parts that say nothing beside these.
_ASIDE_PART = re.compile(r"ads?|advert\w*|promo\w*|sponsor\w*|banner|nav\w*|menu\w*|sidebar|side|footer|foot|header|masthead|breadcrumbs?|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|replies|reply|respond|discussion|disqus|widget|login|signup|search|pagination|pager|toolbar|copyright|legal|gdpr|alert|skip\w*|teaser|tags?")
_NEUTRAL = {"area", "articles", "bar", "block", "body", "bottom", "box", "buttons", "container", "form", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "page", "panel", "posts", "right", "row", "section", "site", "slot", "stories", "thread", "title", "to", "top", "unit", "wrap", "wrapper", ""}
#: Of these, what an article or main element itself may be called to stand beside the article, and names of parts that an article has of its own.
_ASIDE_ARTICLE = re.compile(r"ads?|advert\w*|promo\w*|sponsor\w*|comments?|replies|reply|related|recommend\w*|teaser|widget|sidebar")
_OWN_PART = {"header", "head", "masthead", "side"}
#: Class names that say what a page has rather than what an element is.
_HAS = ("has-", "with-", "no-", "without-", "show-", "hide-", "is-")
_MAIN_WORD = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body|text)(?:$|[-_\s])", re.I)
_SPACE = re.compile(r"\s+")

#: Names of a block's features, in order: those of the block and of the blocks before and after it; whether it is a heading; whether it is in an
#: article or main element (2) or in one named like one (1); whether it is in an element for another part, by kind, role or whole name (2) or by a part of a name (1);
#: and how long the article element that it is in, or what stands in none, is beside the longest of a page's.
FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "heading", "marked", "beside", "share")
#: Kinds of open elements that are counted: beside by their whole name, by a part of it, article elements, elements named like one.
_STRONG, _WEAK, _ARTICLE, _NAMED = range(4)


def _named(value: str, own: set[str] | None, parts: re.Pattern) -> int:
    """2 if a name stands for another part of a page as a whole, 1 if a part of one does, else 0."""
    out = 0
    for name in value.lower().split():
        if name.startswith(_HAS):
            continue
        found = [p for p in re.split(r"[-_]", name) if not own or p not in own]
        hits = [bool(parts.fullmatch(p)) for p in found]
        if any(hits):
            out = max(out, 2 if all(h or p in _NEUTRAL for h, p in zip(hits, found)) else 1)
    return out


def _kinds(name: str, attrs: str, within: bool = False) -> tuple[int, ...]:
    """The kinds that an element is counted as. within: in an article."""
    beside = 2 if name in _RAW or name in _ASIDE and not (within and name == "header") else 0
    marked = 2 if name in ("article", "main") else 0
    if attrs and name not in ("body", "html"):
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in ("hidden",) or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                beside = 2
            elif key == "role":
                beside, marked = (2 if value in _ASIDE_ROLE else beside), (2 if value in ("main", "article") else marked)
            elif key in ("class", "id"):
                if name == "article":
                    beside = max(beside, 2 * bool(_named(value, None, _ASIDE_ARTICLE)))
                elif name != "main":
                    beside = max(beside, _named(value, _OWN_PART if within else None, _ASIDE_PART))
                if _MAIN_WORD.search(value):
                    marked = max(marked, 1)
    return tuple(k for k, on in ((_STRONG, beside == 2), (_WEAK, beside == 1), (_ARTICLE, marked == 2), (_NAMED, marked == 1)) if on)


class _Open:
    """Elements that are open, with the places of each name and of those that make blocks, so that no end tag or new block looks through them all."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []  # places of elements that make blocks
        self.zones, self.links, self.headings = [0, 0, 0, 0], 0, 0
        self.articles = 0  # outermost ones that have begun

    def push(self, name: str, kinds: tuple[int, ...]) -> None:
        if _ARTICLE in kinds and not self.zones[_ARTICLE]:
            self.articles += 1
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in _INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((name, kinds))
        self._count(name, kinds, 1)

    def _count(self, name: str, kinds: tuple[int, ...], n: int) -> None:
        for k in kinds:
            self.zones[k] += n
        self.links += n * (name == "a")
        self.headings += n * (name in _HEADING)

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            name, kinds = self.stack.pop()
            self.places[name].pop()
            if name not in _INLINE:
                self.outer.pop()
            self._count(name, kinds, -1)

    def end(self, name: str) -> None:
        """An end tag closes the last element of its name and what is in it; one of an inline element doesn't reach out of a block."""
        at = (self.places.get(name) or [-1])[-1]
        if at >= 0 and (name not in _INLINE or not self.outer or self.outer[-1] < at):
            self.close(at)

    def begin_block(self, name: str) -> None:
        """A new block ends an open paragraph or heading, or an item of its own kind."""
        if self.outer:
            last = self.stack[self.outer[-1]][0]
            if last == "p" or last in _HEADING or name == last and name in _ITEMS:
                self.close(self.outer[-1])


#: A block: its text, words, words in links, whether it is a heading, marked and beside as in FEATURES, and the number of its article element (0: none).
Block = tuple[str, int, int, bool, int, int, int]


def blocks(page: str) -> list[Block]:
    """A page's flat blocks in order, empty ones left out. Only what is no text of the page (scripts, styles, controls) is passed over.

    Unclosed elements last until an enclosing one ends. Time grows with the page's length.
    """
    out: list[Block] = []
    parts: list[str] = []
    open_ = _Open()
    linked = 0

    def end_block() -> None:
        nonlocal linked, parts
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                words, z = text.count(" ") + 1, open_.zones
                out.append((text, words, min(words, linked), open_.headings > 0, 2 if z[_ARTICLE] else min(1, z[_NAMED]), 2 if z[_STRONG] else min(1, z[_WEAK]), open_.articles if z[_ARTICLE] else 0))
            parts = []
        linked = 0

    pos, size, last = 0, len(page), page.rfind(">")
    while pos < size:
        m = _next_token(page, pos, last)
        chunk = page[pos : m.start() if m else size]
        if chunk:
            parts.append(chunk)
            if open_.links:
                linked += len(chunk.split())
        if not m:
            break
        pos, name = m.end(), m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name not in _INLINE and name not in _UNSEEN:
            end_block()
        if m[1]:
            open_.end(name)
            continue
        if name in _VOID:
            continue
        if name in _SOURCE and not m[0].endswith("/>"):  # its content is skipped up to its end tag
            gone = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            pos = gone.end() if gone else size
            continue
        if name not in _INLINE:
            open_.begin_block(name)
        if m[0].endswith("/>"):
            continue
        open_.push(name, _kinds(name, m[3], open_.zones[_ARTICLE] > 0))
    end_block()
    return out


def _next_token(page: str, pos: int, last: int) -> re.Match | None:
    """The next tag, comment or declaration. Nothing but a comment or declaration that runs to the end begins after the last `>`."""
    if pos > last:
        return _TAIL.search(page, pos)
    return _TOKEN.search(page, pos)


def features(found: list[Block]) -> np.ndarray:
    """FEATURES of each block; a page's edges have neighbours without words. Link: share of a block's words in links."""
    n = len(found)
    if not n:
        return np.zeros((0, len(FEATURES)))
    words = np.array([0, *(b[1] for b in found), 0], float)
    link = np.array([0, *(b[2] / b[1] for b in found), 0], float)
    heading, marked, beside, article = (np.array([b[i] for b in found]) for i in (3, 4, 5, 6))
    length = np.bincount(article, weights=words[1:-1] * (beside < 2))
    share = length[article] / max(1.0, length.max())
    return np.column_stack([words[1:-1], link[1:-1], words[:-2], link[:-2], words[2:], link[2:], heading, marked, beside, share])


#: A small labelled table: FEATURES and 1 for main text. Blocks as they stand in pages of several kinds, marked and unmarked.
LABELLED = [
    # in a marked article: headings, long and short paragraphs, lists of links and of sources
    (9, 0, 1, 1, 24, 0, 1, 2, 0, 1, 1), (24, 0, 9, 0, 30, 0, 0, 2, 0, 1, 1), (1, 0, 30, 0, 12, 0, 0, 2, 0, 1, 1), (60, 0.05, 1, 0, 8, 0, 0, 2, 0, 1, 1), (3, 0, 60, 0, 2, 0, 0, 2, 0, 1, 1), (2, 0, 1, 0, 9, 0, 0, 2, 0, 1, 1),
    (14, 0, 0, 0, 0, 0, 0, 2, 0, 1, 1), (7, 0.3, 22, 0, 4, 1, 0, 2, 0, 1, 1), (40, 0.6, 12, 0, 9, 0, 0, 2, 0, 1, 1), (1, 0, 1, 1, 1, 0, 1, 2, 0, 1, 1), (8, 1, 0, 0, 60, 0, 1, 2, 0, 1, 1), (30, 0.95, 12, 0, 25, 0, 0, 2, 0, 1, 1),
    (1, 1, 0, 0, 1, 1, 0, 2, 0, 1, 1), (2, 1, 1, 1, 2, 1, 0, 2, 0, 1, 1), (6, 0.9, 5, 1, 4, 1, 0, 2, 0, 1, 1), (3, 1, 12, 0, 0, 0, 0, 2, 0, 0.6, 1), (50, 0, 30, 0, 12, 0, 0, 2, 0, 0.5, 1), (2, 0, 9, 0, 30, 0, 1, 2, 0, 0.5, 1),
    (4, 0, 3, 0, 1, 0, 0, 2, 0, 1, 1), (9, 0, 26, 0, 2, 0, 0, 2, 0, 1, 1), (4, 0, 23, 0, 1, 0, 0, 2, 0, 1, 1), (5, 0, 9, 0, 0, 0, 0, 2, 0, 1, 1), (6, 0, 2, 0, 2, 0, 0, 2, 0, 1, 1), (8, 0, 4, 0, 1, 0, 0, 2, 0, 0.7, 1), (10, 0, 1, 0, 0, 0, 0, 2, 0, 1, 1),
    (3, 0.3, 5, 0, 2, 0, 0, 2, 0, 1, 1), (7, 0, 60, 0, 0, 0, 1, 2, 0, 1, 1), (5, 0, 1, 0, 1, 1, 0, 2, 0, 1, 1), (1, 0, 0, 0, 2, 1, 0, 2, 0, 1, 1), (18, 0.5, 3, 1, 2, 1, 0, 2, 0, 1, 1), (2, 0.5, 5, 0, 30, 0, 0, 2, 0, 1, 1), (6, 0, 0, 0, 1, 0, 1, 2, 0, 1, 1),
    (3, 0.33, 8, 0, 0, 0, 0, 2, 0, 1, 1), (2, 0, 30, 0, 0, 0, 0, 2, 0, 1, 1), (5, 0, 3, 0, 0, 0, 0, 2, 0, 1, 1), (4, 0, 12, 0, 0, 0, 0, 2, 0, 1, 1), (1, 0, 5, 0, 0, 0, 0, 2, 0, 1, 1), (6, 0.2, 20, 0, 0, 0, 0, 2, 0, 0.8, 1), (1, 1, 32, 0, 1, 1, 0, 2, 0, 1, 1), (3, 1, 40, 0, 2, 1, 0, 2, 0, 1, 1), (4, 1, 2, 1, 0, 0, 0, 2, 0, 1, 1),
    # in an article that is short beside the page's longest text: cards
    (8, 1, 3, 0, 18, 0, 1, 2, 0, 0.05, 0), (18, 0, 8, 1, 9, 1, 0, 2, 0, 0.05, 0), (25, 0.1, 6, 0, 5, 1, 0, 2, 0, 0.1, 0), (5, 0, 30, 0, 7, 0, 1, 2, 0, 0.08, 0), (35, 0, 4, 0, 6, 0, 0, 2, 0, 0.12, 0), (2, 1, 20, 0, 80, 0, 0, 2, 0, 0.04, 0),
    # in parts that stand for something else, within an article and elsewhere: menus, comments of any length, notices, adverts, forms
    (30, 0, 1, 1, 24, 0, 0, 2, 2, 1, 0), (14, 0, 60, 0, 20, 0, 0, 2, 2, 1, 0), (1, 1, 1, 1, 2, 1, 0, 2, 2, 1, 0), (3, 0, 40, 0, 0, 0, 0, 2, 2, 1, 0), (80, 0, 12, 0, 30, 0, 0, 2, 2, 1, 0), (5, 0, 0, 0, 8, 0, 1, 2, 2, 1, 0),
    (2, 1, 2, 1, 2, 1, 0, 0, 2, 1, 0), (40, 0, 9, 0, 60, 0, 0, 0, 2, 1, 0), (6, 0, 3, 0, 12, 0, 0, 0, 2, 1, 0), (12, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0), (25, 0, 50, 0, 2, 1, 0, 1, 2, 1, 0), (9, 0.2, 40, 0, 12, 0, 0, 1, 2, 1, 0), (3, 0, 0, 0, 400, 0, 0, 0, 2, 0.02, 0),
    # in elements of which a part of the name could stand for something else: prose stays, links and scraps go
    (48, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1), (48, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1), (30, 0.1, 8, 0, 40, 0, 0, 0, 1, 1, 1), (22, 0, 30, 0, 12, 0, 0, 1, 1, 1, 1), (60, 0.05, 2, 1, 9, 0, 0, 2, 1, 1, 1), (25, 0, 60, 0, 4, 0, 0, 2, 1, 1, 1),
    (3, 0, 30, 0, 2, 1, 0, 0, 1, 1, 0), (2, 1, 4, 1, 3, 1, 0, 0, 1, 1, 0), (7, 0.8, 60, 0, 5, 1, 0, 1, 1, 1, 0), (4, 0, 12, 0, 0, 0, 0, 2, 1, 1, 0), (1, 1, 30, 0, 1, 1, 0, 2, 1, 1, 0), (8, 0, 40, 0, 3, 1, 0, 1, 1, 1, 0), (14, 0.9, 20, 0, 3, 1, 0, 2, 1, 1, 0),
    # around a marked article, in no element that says so
    (5, 0, 2, 1, 9, 0, 0, 0, 0, 0.02, 0), (2, 1, 1, 1, 9, 0, 0, 0, 0, 0.03, 0), (12, 0, 30, 0, 0, 0, 0, 0, 0, 0.05, 0), (30, 0, 25, 0, 3, 0, 0, 1, 0, 0.1, 0), (3, 0, 0, 0, 8, 0, 1, 0, 0, 0.04, 0), (9, 0.5, 14, 0, 2, 1, 0, 1, 0, 0.06, 0),
    # pages that mark none, or name a part like an article: long blocks, and short ones among them
    (40, 0, 9, 0, 60, 0, 0, 0, 0, 1, 1), (60, 0.05, 40, 0, 3, 0, 0, 0, 0, 1, 1), (25, 0, 60, 0, 2, 0.5, 0, 0, 0, 1, 1), (12, 0, 40, 0, 35, 0, 0, 0, 0, 1, 1), (4, 0, 50, 0, 45, 0, 0, 0, 0, 1, 1), (7, 0, 3, 1, 48, 0, 1, 0, 0, 1, 1),
    (18, 0.1, 22, 0, 30, 0, 0, 0, 0, 1, 1), (90, 0.2, 2, 1, 5, 1, 0, 0, 0, 1, 1), (6, 0, 1, 1, 30, 0, 1, 0, 0, 1, 1), (16, 0, 12, 0, 14, 0, 0, 0, 0, 1, 1), (30, 0, 1, 1, 1, 1, 0, 0, 0, 1, 1), (45, 0, 4, 0, 0, 0, 0, 0, 0, 1, 1),
    (40, 0, 9, 0, 60, 0, 0, 1, 0, 1, 1), (4, 0, 50, 0, 45, 0, 0, 1, 0, 1, 1), (7, 0, 3, 1, 48, 0, 1, 1, 0, 1, 1), (36, 0, 0, 0, 2, 1, 0, 1, 0, 1, 1), (22, 0, 1, 1, 30, 0, 0, 1, 0, 1, 1),
    (40, 0, 48, 0, 2, 1, 0, 1, 0, 1, 1), (26, 0, 60, 0, 3, 1, 0, 0, 0, 1, 1), (70, 0.1, 30, 0, 1, 1, 0, 0, 0, 0.8, 1), (20, 0, 45, 0, 2, 1, 0, 1, 0, 1, 1), (35, 0, 22, 0, 5, 0.8, 0, 0, 0, 1, 1),
    # what stands around them: links, and short blocks beside links or at the edge
    (2, 1, 2, 1, 2, 1, 0, 0, 0, 1, 0), (1, 1, 0, 0, 1, 1, 0, 0, 0, 1, 0), (5, 0.8, 3, 1, 2, 1, 0, 0, 0, 1, 0), (3, 0, 2, 1, 2, 1, 0, 0, 0, 1, 0), (4, 0, 0, 0, 3, 1, 0, 0, 0, 1, 0), (8, 0.9, 50, 0, 4, 1, 0, 0, 0, 1, 0),
    (6, 0, 4, 1, 0, 0, 0, 0, 0, 1, 0), (14, 0.7, 6, 1, 5, 1, 0, 0, 0, 1, 0), (5, 0, 3, 1, 0, 0, 0, 0, 0, 1, 0), (4, 1, 3, 0, 2, 0, 0, 0, 0, 1, 0), (7, 0.6, 0, 0, 12, 0.5, 0, 0, 0, 1, 0), (2, 1, 2, 1, 2, 1, 0, 1, 0, 1, 0),
    (5, 1, 40, 0, 33, 0, 0, 0, 0, 1, 0), (30, 0.9, 20, 0, 25, 0, 0, 0, 0, 1, 0), (24, 1, 2, 0, 40, 0, 0, 0, 0, 1, 0), (40, 0.8, 9, 0, 30, 0, 0, 1, 0, 1, 0), (9, 1, 30, 0, 30, 0, 1, 0, 0, 1, 0), (3, 1, 8, 0, 26, 0, 0, 1, 0, 1, 0),
    (5, 0.8, 3, 1, 2, 1, 0, 1, 0, 1, 0), (1, 1, 36, 0, 0, 0, 0, 1, 0, 1, 0), (3, 0, 2, 1, 2, 1, 0, 1, 0, 1, 0),
]


def train_tree(table: list[tuple], depth: int = 8) -> tuple | float:
    """A binary tree of least Gini impurity: (feature, threshold, low, high) or the share of main text in a leaf."""
    data = np.array(table, float)
    x, y = data[:, :-1], data[:, -1]
    if depth == 0 or len(set(y)) == 1:
        return float(y.mean())
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, j] <= t
            cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, j, float(t))
    if best is None:
        return float(y.mean())
    _, j, t = best
    low = x[:, j] <= t
    return (j, t, train_tree([r for r, k in zip(table, low) if k], depth - 1), train_tree([r for r, k in zip(table, low) if not k], depth - 1))


def classify(tree: tuple | float, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, row in zip(found, features(found).tolist()) if classify(tree, row))


def extract_main_text(pages: DataFrame, labelled: list[tuple] = LABELLED) -> DataFrame:
    """page_id, url, text (empty if the page has none) and n_chars of each page.

    The page is split into flat text blocks, and a tree trained on the labelled table classifies all of them: by words and
    link densities, their own and their neighbours', by what the elements around them are or are called, and by how
    long their article is beside the page's longest.

    Null or empty html: empty. Pages of any length are read whole, in time that grows with the length; broken markup is
    read as far as it goes. A leaf with as many of either kind counts as main text. Rows that repeat are extracted each;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    tree = train_tree(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = [main_text(p, tree).encode("utf-8", "replace").decode() for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
