"""Words of Arrow string columns as arrays of 64-bit hashes, computed over bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text worked on at once, or one document if that is longer
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_APART = np.ones(256, dtype=bool)  # all but letters, digits and what is beyond ASCII
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first bytes of eight


class Words(NamedTuple):
    lo: int  # first document of the chunk
    hi: int  # after the last
    hashes: np.ndarray  # uint64, one a word
    doc: np.ndarray  # document of each word, from lo
    first: np.ndarray  # hi - lo + 1 offsets of documents in hashes
    low: np.ndarray  # lower-cased bytes of the chunk
    start: np.ndarray  # of each word in these
    stop: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def words(column: pa.Array, bare: bool = False) -> Iterator[Words]:
    """Hashes of the lower-cased (A-Z) words of each document, chunk by chunk; documents are never split. Bare words are
    runs of letters and digits."""
    data, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        yield _words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo, hi, _APART if bare else _SPACE)
        lo = hi


def _words(data: np.ndarray, at: np.ndarray, lo: int, hi: int, apart: np.ndarray) -> Words:
    none = np.empty(0, np.int64)
    low = _LOWER[data]
    if not len(data):
        return Words(lo, hi, np.empty(0, np.uint64), none, np.zeros(hi - lo + 1, np.int64), low, none, none)
    space = apart[low]
    solid = ~space
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    edge = at[:-1][at[:-1] < len(data)]
    begin[edge] = solid[edge]
    edge = at[1:][at[1:] > 0] - 1
    end[edge] = solid[edge]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(start):
        return Words(lo, hi, np.empty(0, np.uint64), none, np.zeros(hi - lo + 1, np.int64), low, none, none)
    length = stop - start
    # eight bytes from every place on: a word is hashed eight bytes at a time, all words at once
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, np.dtype("<u8"), padded, strides=(1,))
    hashes = mix((eight[start] & _FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, done = np.flatnonzero(length > 8), 8
    while len(more):
        part = eight[start[more] + done] & _FIRST[np.minimum(length[more] - done, 8)]
        hashes[more] = mix(hashes[more] * np.uint64(0xD1B54A32D192ED03) + part)
        done += 8
        more = more[length[more] > done]
    first = np.searchsorted(start, at)
    return Words(lo, hi, hashes, np.searchsorted(at, start, side="right") - 1, first, low, start, stop)


def shingles(chunk: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each document its sorted distinct k-word shingles; with 1 to k-1 words the whole sequence is one."""
    h, first = chunk.hashes, chunk.first
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            rolled = mix(rolled * np.uint64(3) + h[i : len(h) - k + 1 + i])
    for i in range(chunk.hi - chunk.lo):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield chunk.lo + i, np.unique(rolled[a : b - k + 1])
        elif b > a:
            one = np.array([b - a], dtype=np.uint64)
            for x in h[a:b]:
                one = mix(one * np.uint64(5) + x)
            yield chunk.lo + i, one
        else:
            yield chunk.lo + i, np.empty(0, np.uint64)
