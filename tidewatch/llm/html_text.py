"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block tags. The first pass decides a block by
where it stands, its length, and its densities of stop words and link text. Short
and doubtful blocks then take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewatch.llm.blocks import lean

SHORT = 70
LONG = 200
LINKS = 0.33
STOP_LOW = 0.15
STOP_HIGH = 0.30

# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this from have or by had not but what all were when "
    "der die das und den dem ein eine ist im nicht mit von auf für sich des auch es an werden aus er hat dass sie nach wird bei zu "
    "le la les de des du un une et est dans que qui pour pas sur au par avec ce il elle sont plus ou "
    "el los las y en que una su se del con por para como más no al lo fue ha sus".split()
)

# What HTML says about its elements.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "title", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "legend", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
#: Words of class and id that name what is not the article.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "aside", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "share", "sharing", "social", "related",
    "recommended", "widget", "pagination", "pager", "login", "search", "toolbar", "copyright", "disclaimer", "form",
}

#: Parts of compound names that make them a state or a topic of the element.
STATES = {"has", "no", "not", "with", "without", "is", "free", "offset", "category", "tag", "type", "format", "single"}
#: Names that speak for the article.
OWN = {"content", "post", "entry", "article", "story", "main", "body", "text"}
#: Elements that keep a new block from ending an open paragraph or item.
CONTAINERS = ("ul", "ol", "dl", "table", "div", "section", "article", "blockquote")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![^\s/])(hidden)(?![\w-])", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class _Open:
    tag: str
    outside: bool
    article: int


@dataclass
class _Block:
    text: str
    links: int
    outside: bool
    article: int
    heading: bool
    label: str = ""


def _named_outside(value: str, in_article: int) -> bool:
    """Whether class or id name what is not the article.

    A whole name counts as such. A name that is only part of a compound counts
    if nothing says that the compound is a state or a topic, and no other name of
    the element speaks for the article.
    """
    tokens = value.split()
    if any(t in NAMES or (t == "header" and not in_article) for t in tokens):
        return True
    for t in tokens:
        parts = set(re.split(r"[^a-z]+", t))
        named = parts & NAMES or ("header" in parts and not in_article)
        if named and not parts & STATES and not any(o != t and set(re.split(r"[^a-z]+", o)) & OWN for o in tokens):
            return True
    return False


def _is_outside(tag: str, attributes: str, in_article: int) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, double, single, bare, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (double or single or bare).lower()
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and _named_outside(value, in_article):
            return True
    return False


class _Stack:
    """The open elements, with the places of each tag, so that no step walks over all."""

    def __init__(self):
        self.items: list[_Open] = []
        self.places: dict[str, list[int]] = {}

    def push(self, item: _Open) -> None:
        self.places.setdefault(item.tag, []).append(len(self.items))
        self.items.append(item)

    def last(self, tag: str) -> int:
        """Place of the innermost open ``tag``, -1 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.items) > place:
            self.places[self.items.pop().tag].pop()

    @property
    def top(self) -> _Open:
        return self.items[-1] if self.items else _Open("", False, 0)


def cut_blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, with what the rules need to know of them."""
    blocks: list[_Block] = []
    stack = _Stack()
    parts: list[tuple[str, bool]] = []
    articles = 0
    heading = False

    def flush():
        nonlocal heading
        if parts:
            text = _SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                links = len(_SPACE.sub(" ", "".join(p for p, link in parts if link)).strip())
                blocks.append(_Block(text, links, stack.top.outside, stack.top.article, heading))
            parts.clear()
        heading = False

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append((html.unescape(page[at:]), stack.last("a") >= 0))
            break
        if m.start() > at:
            parts.append((html.unescape(page[at : m.start()]), stack.last("a") >= 0))
        at = max(m.end(), at + 1)
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                parts.append((m[0][9:].removesuffix("]]>"), False))
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if tag in BLOCKS:
                flush()
            if stack.last(tag) >= 0:
                stack.close(stack.last(tag))
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
            # A block ends an open paragraph; an item ends the one before it.
            for low in ("p",) + ((tag,) if tag in ("li", "dt", "dd", "td", "th", "tr", "option") else ()):
                last = stack.last(low)
                if last >= 0 and all(stack.last(c) <= last for c in CONTAINERS):
                    stack.close(last)
            heading = re.fullmatch("h[1-6]", tag) is not None
        if tag in VOID:
            continue
        above = stack.top
        inside = above.article
        if tag in ("article", "main"):
            articles += 1
            inside = articles
        stack.push(_Open(tag, above.outside or _is_outside(tag, attributes, above.article), inside))
    flush()
    return blocks


def label_blocks(blocks: list[_Block]) -> None:
    """Both passes; leaves ``good`` or ``bad`` in every block's label."""
    dense = {}
    inside = beside = 0
    for i, b in enumerate(blocks):
        words = _WORD.findall(b.text.lower())
        dense[i] = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if not b.outside and b.article:
            inside += len(b.text)
        elif not b.outside and b.links <= LINKS * len(b.text) and len(b.text) >= LONG and dense[i] >= STOP_HIGH:
            beside += len(b.text)
    # Where the marked article is less than the text beside it, it is but a teaser.
    some_article = inside >= beside and inside > 0
    for i, b in enumerate(blocks):
        stop = dense[i]
        if b.outside or b.links > LINKS * len(b.text):
            b.label = "bad"
        elif some_article and not b.article:
            # The page says where its article is.
            b.label = "bad"
        elif b.heading or len(b.text) < SHORT:
            b.label = "bad" if b.links and not b.article else "short"
        elif stop >= STOP_HIGH and len(b.text) >= LONG:
            b.label = "good"
        elif stop >= STOP_LOW:
            b.label = "good" if b.article else "near"
        else:
            b.label = "good" if b.article else ("near" if len(b.text) >= LONG else "bad")
    first = [b.label for b in blocks]

    def nearest(order: range) -> list[tuple[str, int]]:
        """The last decided label met before each block in this order, and how far."""
        out = [("", len(blocks))] * len(blocks)
        decided, own = -1, {}
        for i in order:
            # Links and notices within an article say nothing of its own blocks.
            j = own.get(blocks[i].article, -1) if blocks[i].article else decided
            if j >= 0:
                out[i] = first[j], abs(j - i)
            if first[i] in ("good", "bad"):
                decided = i
            if first[i] == "good":
                own[blocks[i].article] = i
        return out

    ahead, behind = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad"):
            continue
        (before, near_before), (after, near_after) = ahead[i], behind[i]
        if b.article and not before and not after:
            b.label = "good"
        elif b.heading:
            b.label = after or "bad"
        elif before == after or not before or not after:
            b.label = before or after or ("good" if first[i] == "near" else "bad")
        elif near_before != near_after:
            b.label = before if near_before < near_after else after
        else:
            b.label = "good" if first[i] == "near" else "bad"


def main_text(page: str | None) -> str:
    """The main text of one page, one line per block; empty if there is none."""
    blocks = cut_blocks(page or "")
    label_blocks(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points).

    One pass without shuffle; pages do not touch each other. A null or empty page
    and one without main text give an empty text. Broken markup is read as far as
    it goes. Columns of ``pages`` named like the added ones are replaced.
    """

    @pandas_udf("string")
    def text_of(source: pd.Series) -> pd.Series:
        return source.map(lambda p: main_text(p if isinstance(p, str) else None))

    return lean(pages).withColumn("text", text_of(F.col(column))).withColumn("n_chars", F.length("text").cast("long"))
