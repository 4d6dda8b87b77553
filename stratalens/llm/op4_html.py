"""Operator 4, HTML extraction.

A page becomes flat text blocks.  Each block has its word count and link
density, those of its neighbours, and what its surroundings say (names of
elements, classes and ids, in three degrees); a decision tree, grown from the
small labelled table below, tells the article from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

# Elements of HTML.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "select", "textarea", "head", "title", "button", "datalist"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a sibling of their kind ends, headings, and those inside a line that may be hidden.
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"span", "b", "i", "em", "strong", "font", "small", "label", "abbr", "cite", "code", "u", "s", "mark"}
#: Elements that are no part of a page by themselves.
SMALL_PARTS = ENDS_ITSELF | {"ul", "ol", "dl", "table", "tbody", "thead", "figure", "figcaption", "blockquote", "pre", "section"}
#: Elements that hold no article, and those that some pages wrap around one.
BOILER, WRAPPERS = {"nav", "aside", "footer", "menu"}, {"form", "fieldset", "dialog"}
#: Nouns that speak against what is named by them, in classes, ids and roles: a name is what its last part says.
AGAINST = {
    "ad", "ads", "adbox", "adslot", "adsbygoogle", "advert", "adverts", "advertisement", "advertisements", "advertising", "alert", "alerts", "aside", "banner", "banners", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer",
    "foot", "footer", "gdpr", "login", "masthead", "menu", "menubar", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promos", "promotion", "readmore", "recommendations", "recommended", "related",
    "search", "searchform", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "socials", "sponsor", "sponsored", "sponsors", "subscribe", "tags", "toc", "toolbar", "topbar", "widget", "widgets",
}
#: What readers write: however much there is of it, it isn't the article.
READERS = {"comment", "commentlist", "comments", "disqus", "replies", "reply", "respond", "responses"}
#: Of the nouns against, those that also begin names of other things: then they only hint.
SOFT = {"alert", "banner", "login", "menu", "nav", "notice", "promo", "related", "search", "share", "skip", "social", "tags", "toc"}
#: Nouns that speak for it.
FOR = {"article", "articles", "body", "content", "contents", "entry", "hentry", "main", "post", "prose", "story", "text", "articlebody", "maincontent", "entrycontent", "postcontent"}
#: Beginnings of names that tell what kind of thing an article or a page is, and ends that tell its state; neither says what a part is for.
KINDS = {"tag", "category", "cat", "type", "status", "format", "author", "has", "no", "with", "without", "is", "not", "lang", "js", "page", "single", "layout", "theme", "template", "col", "grid", "wp"}
STATES = {"open", "closed", "enabled", "disabled", "on", "off", "active", "visible", "left", "right"}
#: Parts of a name that say what shape a thing has, and nothing of what it is for.
SHAPES = {
    "slot", "box", "boxes", "wrap", "wrapper", "container", "area", "list", "body", "unit", "units", "link", "links", "bar", "section", "block", "content", "inner", "outer", "item", "items", "form", "panel", "region", "row", "group", "title", "text", "count", "meta", "author", "avatar", "date",
    "head", "header", "main", "zone", "placement", "holder", "frame", "top", "bottom", "thread", "entry", "node", "leaderboard", "mpu", "desktop", "mobile", "sticky", "info", "message", "policy", "law", "settings", "overview", "wide", "small", "large", "x", "id", "new", "threaded",
} | STATES
#: Shares of a page's unlinked words above which an element isn't a part of it beside the article.
SMALL, LARGE = 0.25, 0.6

#: An attribute as a browser reads it: a value without quotes may hold them, and ends at white space or the tag's end.
_ATTRIBUTE = r"""=?[^\s>/=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|$)|'[^']*+(?:'|$)|[^\s"'>][^\s>]*+)?+)?+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|$)", re.S)
_PAIR = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_PARTS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I) for name in RAW}


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case and values, the first of each name."""
    out: dict[str, str] = {}
    for m in _PAIR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


#: Letters of scripts that are written without spaces, and their punctuation; two such letters count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_UNSPACED_SIGNS = re.compile("[\u3000-\u303f\uff00-\uff65]")


def word_count(text: str) -> int:
    """Words of a text in any script."""
    if text.isascii():
        return len(text.split())
    bare, letters = _UNSPACED.subn(" ", text)
    return len(_UNSPACED_SIGNS.sub(" ", bare).split()) + (letters + 1) // 2


def says(names: str) -> tuple[int, bool, bool, bool]:
    """What classes, ids and roles say.

    2 if one is named by a noun against, 1 if one only begins with such a noun,
    else 0; whether readers are meant; whether one speaks for it; whether what
    speaks against it is only the beginning of a name of something else, as in
    ad-hoc-committee, which says nothing within an article.
    """
    against, readers, favour, weak = 0, False, False, False
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not parts or len(parts) > 1 and (parts[0] in KINDS or parts[-1] in STATES):
            continue
        whole, last = "".join(parts), parts[-1]
        other = len(parts) > 1 and any(p not in SHAPES and p not in AGAINST and p not in READERS for p in parts[1:])
        if READERS & {last, whole} or READERS & {*parts} and not (parts[0] in READERS and other):
            against, readers = 2, True
        elif whole in FOR or last in FOR and not AGAINST & {*parts[:-1]}:
            favour = True
        elif whole in AGAINST or last in AGAINST or parts[0] in AGAINST - SOFT and not other:
            against = 2
        elif parts[0] in SOFT:
            against = max(against, 1)
        elif parts[0] in AGAINST or parts[0] in READERS:
            against, weak = max(against, 1), True
    return against, readers, favour, weak and against == 1


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: int
    content: bool
    heading: bool
    element: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


class _Element:
    """An element: what it is called, the one around it, and what speaks against it or for it."""

    __slots__ = ("name", "above", "silent", "against", "readers", "favour", "weak", "head", "plain")

    def __init__(self, name: str, above: int, silent: bool, attributes: dict[str, str]):
        self.name, self.above, self.plain = name, above, 0
        unseen = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))
        self.silent = silent or unseen or name in SILENT
        names = " ".join(attributes[k] for k in ("class", "id", "role", "itemprop") if k in attributes)
        self.against, self.readers, self.favour, self.weak = says(names) if names else (0, False, False, False)
        if name in ("article", "main"):
            self.against = 2 if self.readers and name == "article" else 0
            self.favour = not self.against
        elif name in BOILER:
            self.against, self.favour = 2, False
        elif name in WRAPPERS:
            self.against = 2
        elif self.favour:
            self.against = 0
        parts = [[p.lower() for p in _PARTS.findall(x)] for x in names.split()]
        self.head = (name == "header" or any(p and p[-1] in ("header", "head") for p in parts)) and not any(FOR & {*p} for p in parts)


def _weigh(elements: list[_Element], blocks: list[Block]) -> None:
    """Give each block what its surroundings say, once it is known how much of the page each element holds."""
    for b in blocks:
        elements[b.element].plain += b.words - b.linked
    for e in reversed(elements[1:]):
        elements[e.above].plain += e.plain
    total = elements[0].plain or 1
    level: list[tuple[int, bool]] = []
    for e in elements:
        boiler, content = level[e.above] if e.above >= 0 else (0, False)
        share, own = e.plain / total, e.against
        if e.name in ("html", "body") or own == 1 and share > SMALL or own == 2 and share > LARGE and not e.readers and e.name not in BOILER:
            own = 0
        if e.weak and own == 1 and content:
            own = 0
        if e.head and not content and (share <= LARGE or e.name == "header"):
            own = 2  # the head of a page, but not that of an article
        level.append((max(boiler, own), e.favour and not boiler or content and not own))
    for b in blocks:
        b.boiler, b.content = level[b.element]


def _page_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Flat text blocks in page order, and the part of the page that each lies in (-1: the page itself); unclosed and misplaced tags are taken as a browser would, nearly."""
    elements = [_Element("", -1, False, {})]
    stack = [0]
    held: Counter[str] = Counter()  # open elements by name, so that a closing tag without one is known at once
    blocks: list[Block] = []
    parts: list[tuple[str, bool]] = []
    links, heading, at = 0, False, 0
    top = lambda: elements[stack[-1]]

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                linked = sum(word_count(x) for x, inside in parts if inside)
                words = max(word_count(text), 1)
                blocks.append(Block(text, words, min(linked, words), 0, False, heading, stack[-1]))
            parts = []

    def say(raw: str) -> None:
        if raw and not top().silent:
            parts.append((html.unescape(raw), links > 0))

    def enter(name: str, attributes: dict[str, str]) -> None:
        elements.append(_Element(name, stack[-1], top().silent, attributes))
        stack.append(len(elements) - 1)
        held[name] += 1

    def leave() -> None:
        held[elements[stack.pop()].name] -= 1

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, name = bool(m[1]), m[2].lower()
        if name == "br":
            parts.append((" ", False))
        elif name == "a":
            links = 0 if closing else 1
        elif name in RAW and not closing:
            end = _END[name].search(page, at)
            if name == "noscript" and end is None:
                continue
            at = end.end() if end else len(page)
        elif closing:
            if name in BLOCKS:
                flush()
                links = 0
            if top().name == name or (name in BLOCKS or name in SILENT) and held[name]:
                while top().name != name:
                    leave()
                leave()
            heading = top().name in HEADINGS
        elif name in BLOCKS or name in SILENT:
            if name in BLOCKS:
                flush()
            if name in VOID:
                continue
            if name in ENDS_ITSELF and top().name == ("p" if name[0] != "l" else "li"):
                leave()
            elif name in BLOCKS and top().name == "p":
                leave()
            if name == "body" and top().name == "head":
                leave()
            if not m[3].rstrip().endswith("/") or name in BLOCKS:
                enter(name, attributes_of(m[3]) if m[3] else {})
            heading = top().name in HEADINGS
        elif name in INLINE and (m[3] or top().silent):
            enter(name, attributes_of(m[3]))
            if not top().silent:
                leave()
    flush()
    _weigh(elements, blocks)
    inside: list[int] = []  # of each element, the part of the page: not itself a paragraph, a list or a table
    for i, e in enumerate(elements):
        inside.append(inside[e.above] if e.name in SMALL_PARTS and e.above > 0 else i)
    return blocks, [-1 if elements[inside[b.element]].name in ("", "html", "body") else inside[b.element] for b in blocks]


def blocks_of(page: str) -> list[Block]:
    return _page_blocks(page)[0]


#: The labelled table: words and link density of a block, of the one before and of the one after; 2 if it lies where
#: menus, notices or comments do, 1 if it may; 1 if in an article, 1 for a heading; last, 1 if it belongs to the article.
LABELLED = [
    # articles with markup that says so
    (9, 0.0, 4, 1.0, 60, 0.0, 0, 1, 1, 1), (60, 0.0, 9, 0.0, 45, 0.0, 0, 1, 0, 1), (3, 0.0, 60, 0.0, 80, 0.0, 0, 1, 0, 1), (120, 0.02, 30, 0.0, 90, 0.1, 0, 1, 0, 1),
    (1, 0.0, 20, 0.0, 12, 0.5, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 3, 0.0, 0, 1, 0, 1), (25, 0.3, 60, 0.0, 40, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (8, 0.0, 50, 0.0, 10, 0.2, 0, 1, 0, 1),
    (40, 0.0, 2, 0.0, 6, 0.4, 0, 1, 0, 1), (5, 0.2, 30, 0.0, 30, 0.0, 0, 1, 0, 1), (12, 0.4, 80, 0.0, 50, 0.0, 0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (5, 0.0, 7, 0.0, 4, 0.0, 0, 1, 0, 1), (3, 0.0, 0, 0.0, 2, 1.0, 0, 1, 0, 1), (4, 0.0, 3, 1.0, 3, 1.0, 0, 1, 0, 1), (2, 0.0, 3, 0.0, 4, 1.0, 0, 1, 1, 1), (30, 0.0, 5, 0.0, 3, 0.0, 0, 1, 0, 1), (6, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0, 1),
    (10, 0.0, 40, 0.0, 2, 0.0, 0, 1, 0, 1), (1, 0.0, 2, 1.0, 1, 1.0, 0, 1, 0, 1), (50, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1), (200, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1), (8, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1), (7, 0.0, 90, 0.0, 1, 0.0, 0, 1, 0, 1),
    (15, 0.0, 14, 0.0, 16, 0.0, 0, 1, 0, 1), (20, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 1), (9, 0.0, 1, 0.0, 60, 0.0, 0, 1, 0, 1), (2, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 1), (6, 0.5, 60, 0.0, 4, 1.0, 0, 1, 0, 1), (4, 0.0, 2, 0.5, 5, 0.6, 0, 1, 0, 1),
    # headings that are links
    (5, 1.0, 0, 0.0, 40, 0.0, 0, 1, 1, 1), (8, 1.0, 3, 1.0, 25, 0.0, 0, 1, 1, 1), (4, 1.0, 30, 0.0, 50, 0.0, 0, 1, 1, 1), (3, 1.0, 0, 0.0, 4, 0.0, 0, 1, 1, 1), (9, 0.9, 50, 0.0, 60, 0.0, 0, 1, 1, 1),
    # lists of links inside articles that no name speaks against: references
    (3, 1.0, 40, 0.0, 3, 1.0, 0, 1, 0, 1), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1), (6, 1.0, 4, 1.0, 5, 1.0, 0, 1, 0, 1), (5, 0.9, 3, 1.0, 12, 0.0, 0, 1, 0, 1),
    # menus, adverts, footers, notices, comments
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 2, 0, 0, 0), (14, 0.0, 60, 0.0, 0, 0.0, 2, 0, 0, 0), (40, 0.0, 5, 0.0, 30, 0.0, 2, 0, 0, 0),
    (90, 0.1, 40, 0.0, 60, 0.0, 2, 0, 0, 0), (30, 0.0, 80, 0.0, 2, 0.0, 2, 1, 0, 0), (5, 0.0, 8, 0.5, 3, 0.0, 2, 0, 1, 0), (20, 0.3, 30, 0.0, 0, 0.0, 2, 0, 0, 0), (150, 0.0, 100, 0.0, 90, 0.0, 2, 0, 0, 0),
    (70, 0.0, 50, 0.0, 40, 0.0, 2, 1, 0, 0), (3, 0.0, 3, 0.0, 3, 0.0, 2, 0, 0, 0), (1, 0.0, 4, 0.0, 0, 0.0, 2, 0, 0, 0),
    # places whose names only hint: long unlinked text is the article's, short and linked blocks aren't
    (60, 0.0, 5, 0.0, 50, 0.0, 1, 0, 0, 1), (40, 0.0, 60, 0.0, 3, 1.0, 1, 0, 0, 1), (120, 0.05, 30, 0.0, 80, 0.0, 1, 1, 0, 1), (35, 0.1, 0, 0.0, 40, 0.0, 1, 1, 0, 1), (55, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1),
    (4, 0.0, 60, 0.0, 3, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (12, 0.0, 5, 0.0, 6, 0.0, 1, 0, 0, 0), (18, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (30, 0.8, 20, 0.5, 8, 1.0, 1, 0, 0, 0), (6, 0.5, 50, 0.0, 4, 1.0, 1, 1, 0, 0), (20, 0.9, 3, 0.0, 2, 0.0, 1, 0, 0, 0), (3, 0.0, 3, 0.0, 2, 1.0, 1, 1, 0, 0),
    # pages without helpful markup: runs of plain text are the article, and short blocks between long ones
    (80, 0.0, 6, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.05, 80, 0.0, 60, 0.0, 0, 0, 0, 1), (18, 0.0, 60, 0.0, 75, 0.0, 0, 0, 0, 1), (6, 0.0, 90, 0.0, 50, 0.0, 0, 0, 0, 1), (30, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 1),
    (5, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 1), (25, 0.1, 50, 0.0, 8, 0.0, 0, 0, 0, 1), (100, 0.2, 20, 0.0, 4, 1.0, 0, 0, 0, 1), (35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (15, 0.0, 14, 0.0, 16, 0.0, 0, 0, 0, 1),
    (13, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (60, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (14, 0.2, 1, 0.0, 1, 0.0, 0, 0, 0, 1), (22, 0.4, 8, 0.0, 30, 0.0, 0, 0, 0, 1), (200, 0.0, 1, 0.0, 3, 0.0, 0, 0, 0, 1),
    (4, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1), (5, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1), (8, 0.0, 1, 1.0, 35, 0.0, 0, 0, 1, 1), (3, 0.0, 4, 0.0, 90, 0.0, 0, 0, 1, 1),
    (3, 0.0, 30, 0.0, 28, 0.0, 0, 0, 0, 1), (2, 0.0, 45, 0.0, 120, 0.0, 0, 0, 0, 1), (9, 0.0, 33, 0.0, 27, 0.0, 0, 0, 0, 1), (16, 0.0, 90, 0.0, 2, 0.0, 0, 0, 0, 1), (28, 0.0, 4, 0.0, 9, 0.0, 0, 0, 0, 1),
    # other short blocks and linked ones are not
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (4, 0.0, 2, 0.5, 5, 0.6, 0, 0, 0, 0), (10, 0.9, 8, 0.8, 12, 1.0, 0, 0, 0, 0), (30, 0.8, 20, 0.7, 25, 0.9, 0, 0, 0, 0),
    (5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (6, 0.5, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (8, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (4, 1.0, 70, 0.0, 60, 0.0, 0, 0, 0, 0), (2, 0.0, 3, 0.0, 4, 1.0, 0, 0, 1, 0), (10, 0.0, 40, 0.0, 2, 0.0, 0, 0, 0, 0), (9, 0.0, 1, 0.0, 6, 0.0, 0, 0, 0, 0), (2, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0),
    (7, 0.0, 90, 0.0, 1, 0.0, 0, 0, 0, 0), (6, 0.0, 3, 1.0, 65, 0.0, 0, 0, 0, 0), (40, 0.9, 60, 0.0, 80, 0.0, 0, 0, 0, 0), (15, 1.0, 2, 1.0, 50, 0.0, 0, 0, 0, 0), (80, 0.9, 3, 0.0, 2, 0.0, 0, 0, 0, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 7) -> tuple | int:
    """A binary tree by Gini impurity: (feature, threshold, lower, upper), or the label of a leaf."""
    if depth == 0 or labels.min() == labels.max():
        return int(2 * labels.sum() >= labels.size)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            cost = sum(x.size * x.mean() * (1 - x.mean()) for x in (labels[low], labels[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), low)
    if best is None:
        return int(2 * labels.sum() >= labels.size)
    _, f, cut, low = best
    return (f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def default_tree() -> tuple | int:
    data = np.array(LABELLED, float)
    return grow(data[:, :-1], data[:, -1])


def classify(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def _between(kept: list[bool], blocks: list[Block], roots: list[int]) -> None:
    """Keep unlinked blocks beside those of the article in one part of the page, as items of a list and last lines are.

    Between two of them in any part; before and after them only in a part that
    isn't the page itself.
    """
    plain = [b.boiler == 0 and b.density < 0.5 for b in blocks]
    found = list(kept)
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last, run = None, []
        for i in order:
            if found[i]:
                if last == roots[i]:
                    for j in run:
                        kept[j] = True
                last, run = roots[i], []
            elif last is not None and plain[i] and roots[i] == last:
                run.append(i)
                if last >= 0:
                    kept[i] = True
            else:
                last, run = None, []


def main_text(page: str, tree: tuple | int) -> str:
    """The blocks of the article, joined by empty lines.

    Where the tree finds none, a page of short blocks under a heading is its
    unlinked blocks from that heading on.
    """
    blocks, roots = _page_blocks(page)
    around = [(0, 0.0), *((b.words, b.density) for b in blocks), (0, 0.0)]
    kept = [bool(classify(tree, (b.words, b.density, *around[i], *around[i + 2], b.boiler, int(b.content), int(b.heading)))) for i, b in enumerate(blocks)]
    _between(kept, blocks, roots)
    if not any(kept):
        head = next((i for i, b in enumerate(blocks) if b.heading and b.boiler == 0), len(blocks))
        if any(not b.heading and b.boiler == 0 and b.density < 0.5 for b in blocks[head:]):
            kept = [i >= head and b.boiler == 0 and b.density < 0.5 for i, b in enumerate(blocks)]
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract_pages(pages: DataFrame, *, html_column: str = "html", tree: tuple | int | None = None) -> DataFrame:
    """The rows of pages, their markup replaced by text (empty if there is none) and n_chars, its code points.

    Null or empty markup gives an empty text.  Columns of pages named text or
    n_chars are replaced.
    """
    tree = default_tree() if tree is None else tree
    rest = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    names = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in rest)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*rest, F.col(html_column)).mapInArrow(lean(run), f"{names}text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
