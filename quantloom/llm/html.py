"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a list of blocks. Each has its word count and link density, those of its neighbours, and where it stands
(in the article, outside it, in elements of boilerplate, in a container that names itself so). A small classification
tree, grown on the labelled pages of ``labelled_blocks.csv`` when first used, says which blocks are main text.
"""

from __future__ import annotations

import csv
import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# -- fixed values: what HTML elements are ----------------------------------------------------------

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("script style title textarea noscript iframe svg template select button object canvas head datalist audio video math".split())
#: Of these the content is raw text up to the end tag.
RAW = set("script style title textarea noscript iframe".split())
BOILERPLATE = set("nav header footer aside form menu dialog".split())
ARTICLE = set("article main".split())
#: Open elements that a start tag of the same group closes.
SIBLINGS = {t: g for g in ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}) for t in g}
HOLDERS = set("ul ol dl table tbody thead tfoot tr select menu".split())

#: Words in ``class``, ``id`` and ``role`` by which a container names itself boilerplate: regions of a page, which may
#: also be in the names of what wraps the article, and things that stay what they are inside an article.
REGIONS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar masthead header topbar banner footer bottombar sidebar rail complementary contentinfo overlay widget widgets".split())
THINGS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal copyright legal "
    "comment comments disqus reply replies respond discussion share sharing social follow related recommended newsletter subscribe subscription signup login search searchbox form".split()
)
#: First parts of names that say what state an element is in, not what it is.
STATES = set("has no with without is not js show hide toggle".split())

START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
#: Where a tag may end, or a quoted value begins.
TAG_STEP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    element: bool
    named: bool


class _Open:
    __slots__ = ("dropped", "element", "inside", "link", "region", "tag", "thing")

    def __init__(self, tag: str, up: _Open | None, dropped=False, inside=False, element=False, region=False, thing=False):
        self.tag, self.dropped, self.inside = tag, dropped or bool(up and up.dropped), inside or bool(up and up.inside)
        self.element, self.thing = element or bool(up and up.element), thing or bool(up and up.thing)
        # the article is not part of a region because what wraps it is named after one
        self.region = region or bool(up and up.region and tag not in ARTICLE)
        self.link = bool(up and up.link)


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """The place after the ``>`` of a tag. A quote that never closes is an ordinary character, looked for once a page."""
    while found := TAG_STEP.search(page, at):
        at, quote = found.end(), found[1]
        if not quote:
            return at
        if quote not in unclosed:
            close = page.find(quote, at)
            if close < 0:
                unclosed.add(quote)
            else:
                at = close + 1
    return len(page)


def _says(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes name a region, a thing, the main part, and whether they hide the element."""
    region = thing = main = hidden = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = NAME_PART.findall(token)
                if parts and parts[0] not in STATES:
                    region |= not REGIONS.isdisjoint(parts)
                    thing |= not THINGS.isdisjoint(parts)
                main |= name == "role" and token == "main"
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(UNSEEN.search(value))
    return region, thing, main, hidden


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, in time linear in its length.

    White space inside a block is one space; empty blocks are none. Inline elements matter only as links, unless they
    name themselves; so any number of them may stay open.
    """
    out: list[Block] = []
    stack = [_Open("", None)]
    counts: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    unclosed: set[str] = set()
    place = stack[0]

    def text(run: str) -> None:
        if run and not stack[-1].dropped:
            parts.append(entities.unescape(run) if "&" in run else run)
            if stack[-1].link:
                linked.append(parts[-1])

    def flush() -> None:
        nonlocal place
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(len(words), len(" ".join(linked).split())), place.inside, place.element, place.region or place.thing))
        parts.clear()
        linked.clear()
        place = stack[-1]

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            counts[stack.pop().tag] -= 1

    at, end = 0, len(page)
    while at < end:
        found = START.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        if found[3]:
            close = page.find("-->", found.end() - 2)  # "<!-->" is a whole comment
            at = close + 3 if close >= 0 else end
            continue
        at = _tag_end(page, found.end(), unclosed) if found[2] else (page.find(">", found.end()) + 1 or end)
        if not found[2]:  # a declaration
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                stack[-1].link = False
            if counts[tag]:
                flush()
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop_to(depth)
                place = stack[-1]
            elif tag not in INLINE:
                flush()
            continue
        attributes = page[found.end() : at - 1]
        region, thing, main, hidden = _says(attributes) if attributes.strip("/ ") else (False, False, False, False)
        if tag in INLINE and tag not in DROPPED and not (region or thing or hidden):
            if tag == "a":
                stack[-1].link = True
            continue
        flush()
        if tag not in INLINE:
            if stack[-1].tag == "p":  # a block ends an open paragraph, and an item the one before it
                pop_to(len(stack) - 1)
            group = SIBLINGS.get(tag)
            if group and any(counts[t] for t in group):
                depth = len(stack) - 1
                while depth and stack[depth].tag not in group and stack[depth].tag not in HOLDERS - group:
                    depth -= 1
                if stack[depth].tag in group:
                    pop_to(depth)
        if tag in VOID:
            place = stack[-1]
            continue
        up = stack[-1]
        if tag in ("html", "body"):
            region = thing = False
        stack.append(_Open(tag, up, tag in DROPPED or hidden, main or tag in ARTICLE, tag in BOILERPLATE and not (tag == "header" and up.inside), region and tag not in ARTICLE, thing))
        if tag == "a":
            stack[-1].link = True
        counts[tag] += 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
        place = stack[-1]
    flush()
    return out


# -- the tree -------------------------------------------------------------------------------------

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "outside", "named")


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block. ``inside``: in an article or main element; ``outside``: in an element of boilerplate, or not in
    the article of a page that has one; ``named``: in a container that names itself boilerplate.
    """
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], dtype=float)
    links = np.array([b.linked / b.words for b in blocks])
    inside = np.array([b.inside for b in blocks])
    outside = np.array([b.element for b in blocks]) | (inside.any() & ~inside)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), inside, outside, [b.named for b in blocks]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A tree of ``(feature, threshold, below, above)`` and leaves 0 or 1, split by Gini impurity; ties by feature."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            if least <= low.sum() <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(t))
    if best[0] >= len(y) * share * (1 - share) - 1e-12:
        return int(share >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, t, below, above = tree
    low, out = x[:, f] <= t, np.zeros(len(x), dtype=bool)
    out[low], out[~low] = predict(below, x[low]), predict(above, x[~low])
    return out


#: Stands in the words of blocks that are labelled main text, and for a number of words in the labelled pages.
MARK, FILLER = "\ue000", re.compile(r"\{(\d+)\}")


def labelled_pages() -> dict[str, str]:
    """The labelled pages by name. In the table a row is a piece of a page, in order, with the label of its blocks; ``{n}`` are n words."""
    pages: dict[str, str] = {}
    with open(Path(__file__).with_name("labelled_blocks.csv"), newline="") as file:
        for r in csv.DictReader(file):
            word = f"{MARK}w" if r["main"] == "1" else "w"
            pages[r["page"]] = pages.get(r["page"], "") + FILLER.sub(lambda n: " ".join([word] * int(n[1])), r["html"])  # noqa: B023
    return pages


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    blocks = [blocks_of(p) for p in pages]
    return np.concatenate([features(b) for b in blocks]), np.array([float(MARK in b.text) for page in blocks for b in page])


@cache
def trained():
    return grow(*labelled(list(labelled_pages().values())))


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    keep = predict(trained(), features(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


@F.pandas_udf(T.StringType())
def main_text_udf(page: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in page], dtype=object)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` (empty where there is no main text) and ``n_chars``, its code points.

    Null html is empty. Every row keeps a row; columns named like a result are replaced; an empty table gives an
    empty result.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html]
    out = pages.select(*(F.col(f"`{c}`") for c in kept), main_text_udf(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
