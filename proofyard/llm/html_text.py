"""Main text of web pages: flat blocks of text, told apart by a decision tree on the words and link density of a block
and its neighbours, with what the page's own markup says of the block as further features."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html_training

# A tag ends at its >, or where the next one begins, so that no search for an end goes beyond that; quotes that are never
# closed are characters. What may be repeated is possessive: the time is in proportion to the page.
_NAME = "(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
_STOP = r"(?:>|(?=<)|\Z)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<{_NAME}((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+){_STOP}|<{_NAME}([^<>]*+){_STOP}|<[!?/][^<>]*+{_STOP}", re.S)
# Elements without text of the page. Of those in RAW nothing but their own end tag is markup.
RAW = frozenset("script style textarea title".split())
DROPPED = frozenset("head template svg iframe audio video select".split())
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|data-main)\b(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
# Elements that end a block; those of CONTAINERS also hold others.
CONTAINERS = frozenset("html body main article section div nav header footer aside form menu dialog fieldset ul ol dl table figure details blockquote address".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot pre hr figcaption summary legend label button option center".split())
APART = frozenset("nav header footer aside form menu dialog fieldset button label".split())
WRAPS = frozenset("form fieldset header dialog menu".split())  # of these some hold the whole page
# Words of class and id names, and roles, by which authors set parts of a page apart: one feature among others.
APART_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay sidebar menu nav navbar navigation breadcrumb
    breadcrumbs footer header masthead comment comments disqus respond share sharing social related recommended newsletter subscribe signup login search toolbar pagination pager widget skip copyright
    complementary contentinfo alert dialog hidden""".split()
)

# Words that go with these in a name: a name sets apart if it has no other words.
BESIDES = frozenset("top bottom left right main site global primary secondary inner outer wrapper wrap container box area block bar list widget widgets links icons posts unit slot".split())

# What a head may hold; any other tag ends it.
IN_HEAD = frozenset("meta link base basefont bgsound noscript template script style title".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    apart: bool  # by the elements around it
    named: bool  # by the names of these
    main: bool  # inside an article or main element
    heading: bool
    label: bool  # marked in the labelled table


@lru_cache(1 << 14)
def _sets_apart(name: str) -> bool:
    """Whether a class, an id or a role as a whole is one of those that set apart."""
    parts = [w for w in re.split(r"[^a-z]+", name) if w]
    return not APART_NAMES.isdisjoint(parts) and all(w in APART_NAMES or w in BESIDES for w in parts)


def _names(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role set an element apart, whether it is hidden, and whether it is marked as main in the
    labelled table."""
    apart = hidden = label = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "data-main":
            label = True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none", value) is not None
        else:
            apart |= any(map(_sets_apart, value.split()))
    return apart, hidden, label


class Tag(NamedTuple):
    start: int
    end: int  # of a raw element that of the whole
    name: str  # empty for comments and the like
    closing: bool
    attributes: str


def _tags(page: str) -> list[Tag]:
    """Raw elements run to their end tag; where none follows they are a tag only."""
    out: list[Tag] = []
    at, endless = 0, set()
    while m := _TOKEN.search(page, at):
        name = (m[2] or m[5] or "").lower()
        at, closing = m.end(), bool(m[1] or m[4])
        if name in RAW and not closing and name not in endless:
            if end := _END[name].search(page, at):
                at = end.end()
            else:
                endless.add(name)
        out.append(Tag(m.start(), at, name, closing, m[3] or m[6] or ""))
    return out


def _dropped(tags: list[Tag]) -> dict[int, int]:
    """Where elements without text begin and end, as places in `tags`. A head ends at the first tag of a body. Of the
    others those that are closed in themselves, or have no end tag before the next edge of an article, a main element or
    the body, are dropped as a tag only."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, tag in enumerate(tags):
        if tag.name in ("article", "main", "body", "html"):
            opened.clear()
        elif tag.name in DROPPED and tag.name != "head":
            if not tag.closing and not tag.attributes.rstrip().endswith("/"):
                opened.setdefault(tag.name, []).append(i)
            elif tag.closing and opened.get(tag.name):
                ends[opened[tag.name].pop()] = i
    for i, tag in enumerate(tags):
        if tag.name == "head" and not tag.closing:
            j = i + 1
            while j < len(tags) and (not tags[j].name or not tags[j].closing and tags[j].name in IN_HEAD):
                j = ends.get(j, j) + 1
            ends[i] = j if j < len(tags) and tags[j].closing and tags[j].name == "head" else j - 1
    return ends


def _spared(page: str, tags: list[Tag], ends: dict[int, int]) -> set[int]:
    """Containers, as places in `tags`, whose names set nothing apart: html, body, those around an article or main element
    and those with most of the page's words."""
    out: set[int] = set()
    opened: Counter[str] = Counter()
    stack: list[tuple[str, int, int, int]] = []  # name, place, words and outermost articles before it
    spans: list[tuple[int, int]] = []
    words = inside = articles = at = 0
    until = -1

    def leave(entry: tuple[str, int, int, int]) -> int:
        name, i, before, had = entry
        opened[name] -= 1
        spans.append((i, words - before))
        if articles > had and name not in ("article", "main"):
            out.add(i)
        return name in ("article", "main")

    for i, tag in enumerate(tags):
        if i > until:
            words += len(page[at : tag.start].split())
            if tag.name in DROPPED:
                until = ends.get(i, -1)
            elif tag.name in CONTAINERS and not tag.closing:
                stack.append((tag.name, i, words, articles))
                opened[tag.name] += 1
                if tag.name in ("html", "body"):
                    out.add(i)
                elif tag.name in ("article", "main"):
                    articles += inside == 0
                    inside += 1
            elif tag.name in CONTAINERS and tag.closing and opened[tag.name]:
                while True:
                    left = stack.pop()
                    inside -= leave(left)
                    if left[0] == tag.name:
                        break
        at = tag.end
    words += len(page[at:].split())
    for x in stack:
        leave(x)
    return out | {i for i, n in spans if 2 * n > words}


def _linked(tags: list[Tag]) -> set[int]:
    """Links, as places in `tags`, that end before the next one begins."""
    out, last = set(), None
    for i, tag in enumerate(tags):
        if tag.name == "a":
            if tag.closing and last is not None:
                out.add(last)
            last = None if tag.closing else i
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Elements that are opened more often than closed set nothing apart."""
    tags = _tags(page)
    ends = _dropped(tags)
    spared = _spared(page, tags, ends)
    closed = _linked(tags)
    seen = Counter((tag.name, tag.closing) for tag in tags if tag.name)
    lost = {name for name in CONTAINERS if seen[name, False] > seen[name, True]}
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, apart, named, main
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, whole_link, own_apart, own_named, heading, label, at = False, False, False, False, False, False, 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split(" "))
            _, apart, named, main = stack[-1] if stack else ("", False, False, False)
            out.append(Block(text, n, min(n, len(html.unescape(" ".join(linked)).split())), apart or own_apart, named or own_named, main, heading, label))
        parts.clear()
        linked.clear()

    until = -1
    for i, (start, end, name, closing, attributes) in enumerate(tags):
        if i <= until:
            at = end
            continue
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked.append(page[at:start])
        at = end
        if name in DROPPED:
            until = ends.get(i, -1)
        elif name == "a":
            in_link = not closing
            whole_link = i in closed
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            in_link, own_apart, own_named, heading, label = in_link and whole_link, False, False, False, False
            if name in CONTAINERS and closing:
                while opened[name]:
                    left = stack.pop()[0]
                    opened[left] -= 1
                    if left == name:
                        break
            elif not closing:
                named, hidden, label = _names(attributes) if attributes.strip() else (False, False, False)
                named &= i not in spared
                hidden &= name not in ("html", "body")
                if name in CONTAINERS:
                    _, apart, outer_named, main = stack[-1] if stack else ("", False, False, False)
                    # the head of an article is not the page's
                    sets = name in APART and name not in lost and not (name == "header" and main) and not (name in WRAPS and i in spared) or hidden
                    stack.append((name, apart or sets, outer_named or named and name not in lost, main or name in ("article", "main")))
                    opened[name] += 1
                else:
                    own_apart, own_named, heading = hidden or name in APART, named, re.fullmatch("h[1-6]", name) is not None
    parts.append(page[at:])
    close()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "apart", "named", "in main", "page has main", "heading")


def features(page: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words) for b in page]).reshape(-1, 2)
    around = np.vstack([np.zeros((1, 2)), own, np.zeros((1, 2))])
    has = any(b.main for b in page)
    rest = np.array([(b.apart, b.named, b.main, has, b.heading) for b in page], dtype=float).reshape(-1, 5)
    return np.hstack([own, around[:-2], around[2:], rest])


class Node(NamedTuple):
    feature: int
    at_most: float
    left: Node | bool
    right: Node | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4, gain: float = 2.0) -> Node | bool:
    """A binary tree that splits by Gini impurity, first feature and lowest threshold on ties, while that lessens the
    impurity, summed over blocks, by `gain` or more."""
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = (2 * len(y) * y.mean() * (1 - y.mean()) - gain, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            n = low.sum()
            if least <= n <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                cost = 2 * n * p * (1 - p) + 2 * (len(y) - n) * q * (1 - q)
                if cost < best[0] - 1e-9:
                    best = (cost, f, float(at))
    if best[1] is None:
        return bool(y.mean() >= 0.5)
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[low], y[low], depth - 1, least, gain), grow(x[~low], y[~low], depth - 1, least, gain))


@cache
def trained() -> Node | bool:
    pages = [blocks(p) for p in html_training.PAGES]
    return grow(np.vstack([features(p) for p in pages]), np.array([b.label for p in pages for b in p]))


def is_main(tree: Node | bool, row) -> bool:
    while not isinstance(tree, bool):
        tree = tree.left if row[tree.feature] <= tree.at_most else tree.right
    return tree


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found).tolist()) if is_main(trained(), row)) if found else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["a", "b", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text (blocks of the article in order, joined by two line ends; empty if
    there is none), n_chars (code points).

    Scripts, styles, heads, comments and embedded elements are dropped, the tag alone where one never ends; character
    references are decoded, white space inside a block becomes one space. Null and empty html gives an empty text; pages of any length are read whole; broken markup never fails.
    Null ids and urls and repeated rows go through as they are. Other columns are ignored; an empty table gives none.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(id_col, url_col, html_col).mapInArrow(_extracted, f"a {kinds[0]}, b {kinds[1]}, text string, n_chars long")
    return rows.withColumnsRenamed({"a": id_col, "b": url_col})
