"""Benchmark decontamination by pigeonhole edit matching.

A test item that stands in a document with at most e errors, cut into e + 1 pieces, has one piece without an error: all
pieces of all items are looked for at once by an automaton, and around each hit the distance of item and text is taken
by Myers' bit-parallel algorithm. Items and texts are compared with a space at either end, so that an item is held by whole
words: half a word at an edge is an error like others, and short items, which may have none, stand as words or not at all.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import near, packed, saved, unpacked

ERRORS = 0.08  # of an item's characters may differ
BROADCAST_ROWS = 1_000_000  # contaminated documents up to which their ids are broadcast
ITEMS = 20_000  # of the benchmark matched at once; a larger one goes in blocks
ITEM_CHARS = 16 << 20  # of all items of a block, but for one item that is longer by itself
_SEPARATORS = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower-cased words with one space between: layout, case and punctuation do not hide a passage."""
    return _SEPARATORS.sub(" ", (text or "").lower()).strip()


def bounded(clean: str) -> str:
    """With the edges of its first and last word."""
    return f" {clean} " if clean else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    n = errors + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:]) if b > a]


def distance(item: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(least edit distance of `item` to a part of `text`, where the first such part ends), or None above `most`."""
    if masks is None:
        masks = bit_masks(item)
    m = len(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up, down = (minus | ~(d | plus)) & full, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
        up, down = up << 1, down << 1
        plus, minus = (down | ~(d | up)) & full, up & d
    return best


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


class Matcher:
    """Finds items of a benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERRORS):
        by_text: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            if clean := normalised(text):
                by_text[clean].append(item_id)
        self.items = [(ids, bounded(clean), int(rate * len(clean))) for clean, ids in by_text.items()]
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                where[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, errors allowed, end in the normalised text) of the nearest occurrence of each item."""
        clean = bounded(normalised(text))
        if self.empty or not clean:
            return
        spots: dict[int, set[int]] = defaultdict(set)  # item: places where it would begin
        for end, (n, places) in self.automaton.iter(clean):
            for i, at in places:
                spots[i].add(end + 1 - n - at)
        for i, begins in spots.items():
            ids, item, errors = self.items[i]
            best = None
            for lo, hi in _merged(sorted(begins), errors, len(item) + errors):
                at = clean.find(item, lo, hi)
                if at >= 0:
                    best = (0, at + len(item))
                    break
                if i not in self.masks:
                    self.masks[i] = bit_masks(item)
                got = distance(item, clean[lo:hi], errors if best is None else best[0] - 1, self.masks[i])
                if got:
                    best = (got[0], lo + got[1])
            if best:
                for item_id in ids:
                    yield item_id, best[0], errors, max(0, min(best[1], len(clean) - 1) - 1 - (clean[best[1] - 1] == " " and best[1] < len(clean)))


def _merged(begins: list[int], before: int, after: int) -> list[tuple[int, int]]:
    """Windows around sorted places, those that overlap as one: together no longer than the text."""
    out: list[tuple[int, int]] = []
    for at in begins:
        lo, hi = max(0, at - before), max(0, at + after)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _matches(shared, rate: float):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            rows = [(i, *hit) for i, text in enumerate(batch.column(1)) for hit in matcher.find(text.as_py())]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(1, 5))], ["id", "item_id", "distance", "errors", "end"])

    return matches


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERRORS, block: int = ITEMS) -> DataFrame:
    """One row per document and item that it holds: id, item_id, distance (the least edit distance of the item to a part
    of the text, both normalised and with a space at either end), errors (allowed: rate * characters of the item, rounded
    down), end (where the first such part of least distance that a piece led to ends in the normalised text).

    Texts are searched whole. Null, empty and punctuation-only texts hold nothing, such items are held nowhere. Items of
    equal normalised text are each reported; repeated documents and ids too. Rows without an item_id are ignored.
    Other columns are ignored; empty tables give none. The benchmark is the stated query set: it is read in blocks of
    about `block` items or ITEM_CHARS characters, whichever are fewer, each broadcast for one pass over the documents.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // block), -(-chars // ITEM_CHARS))
    out = None
    for part in range(parts):
        listed = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in listed])
        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_matches(shared, rate), f"id {kind}, item_id long, distance long, errors long, end long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """`docs` without the documents that hold an item of the benchmark; all columns kept. Rows without an id stay only
    if no such row holds an item."""
    held = saved(contaminated(docs, benchmark, id_col, **how).select(F.col(id_col).alias("held")).distinct())
    return unpacked(packed(docs).join(near(held, BROADCAST_ROWS), F.col("row")[id_col].eqNullSafe(F.col("held")), "left_anti"))
