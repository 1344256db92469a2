"""Scores of texts under a probabilistic suffix tree over words.

Contexts of up to DEPTH words are states of the tree where they repeat and where the next symbol's distribution diverges
from that of the shorter context. Each state keeps the successors seen at least LEAST times; the discounted rest of its
mass goes to its parent, down to add-one unigrams over all words of the training texts. A token is scored in the longest
state that ends where it begins. A run of words is looked at in longer contexts only while these may gain by it: n
occurrences at probability p add at most n * ln(1 / p) to a divergence.

All decisions are by absolute counts, so the tree grows with the corpus; it stays in saved tables, keyed by 64-bit hashes of
runs of words. A token's log probability is that of its word plus one difference a length of context. The difference is
the logarithm of the mass a state leaves to its parent, plus a correction where the successor is kept: a text's score is
a sum over its runs of words of a value that belongs to the run.

Counts, and what texts ask of the tables, go to their keys as arrays: rows of Spark that hold thousands of entries each,
dealt by shards of the hash, so that an entry costs its bytes and tasks work on whole arrays. What is broadcast is bounded
and changes no result: words that hold a share of all tokens, values of the commonest runs, bit maps of runs that repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, saved
from .tokens import Words, mix, words

LOOKUP = 1 << 20  # most words, the commonest, that are looked up in a broadcast table
RUN_LOOKUP = 1 << 21  # most values of runs, the commonest, that are looked up so
BITS = 27  # of the bit maps' addresses; the map of values has one more
BLOCK = 18  # of these, inside a block of a bit map
LEAST = 2  # least count of a context and of a successor
GAIN = 4.0  # least Kullback-Leibler divergence of a state from its parent, times its count (nats)
DEPTH = 3  # words of the longest contexts
DISCOUNT = 0.75
HOT = 1000  # a key with more than this share of all tokens (one in HOT) is dealt by the whole run
SHARD = 1 << 21  # tokens a shard of counts has, about
END = np.uint64(0x5EED0FE0D0000001)
FLUSH = 1 << 21  # entries gathered before they are merged and sent
PASSES = 2  # in which documents, by partitions, ask the tables, so that the files of one go before the next
HALF = np.uint64(32)

U8, F8, U4, U2 = (np.dtype(x) for x in ("<u8", "<f8", "<u4", "<u2"))
_DEALT = "shard int, kind int, first long, data binary"


class Model(NamedTuple):
    """States of one and two words as arrays."""

    total: int
    distinct: int
    word: np.ndarray  # sorted hashes of the words that repeat
    count: np.ndarray
    alphabet: int
    stay1: np.ndarray  # per word: mass left to the root, 1 where it is no state
    next1: np.ndarray  # sorted word * alphabet + successor
    prob1: np.ndarray
    pair: np.ndarray  # keys of the states of two words
    stay2: np.ndarray
    next2: np.ndarray  # pair's place * alphabet + successor
    prob2: np.ndarray


class Tree(NamedTuple):
    total: int
    distinct: int
    vocabulary: DataFrame  # key, n of all words
    runs: list[DataFrame]  # if whole, by length of context from 1: ctx, suf, key, n, size, parent
    states: list[DataFrame]  # if whole: ctx, size, stay of those kept
    values: DataFrame  # key, n, value; a key may have two rows, whose values add up


def _tokens(chunk: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with one END after each document, and the document of each."""
    n = chunk.hi - chunk.lo
    return np.insert(chunk.hashes, chunk.first[1:], END), np.insert(chunk.doc, chunk.first[1:], np.arange(n))


def _find(where: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where absent. Fast if `what` is sorted too."""
    if not len(where):
        return np.full(len(what), -1, dtype=np.int64)
    at = np.searchsorted(where, what)
    at[at == len(where)] = 0
    return np.where(where[at] == what, at, -1)


class Lookup:
    """Places of hashes in an array of distinct ones: a table addressed by their low bits, and a sorted array of those
    that found their place taken."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.mask = keys, np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        slot = (keys & self.mask).astype(np.int64)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.table[slot] != np.arange(len(keys)))
        self.lost = lost[np.argsort(keys[lost])]

    def find(self, what: np.ndarray) -> np.ndarray:
        """Places, -1 where absent."""
        if not len(self.keys):
            return np.full(len(what), -1, np.int64)
        at = self.table[(what & self.mask).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != what))
        if len(wrong):
            there = _find(self.keys[self.lost], what[wrong])
            at[wrong] = np.where(there >= 0, self.lost[there] if len(self.lost) else -1, -1)
        return at


def _key(ctx: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Of a run of words, from those of all but its last and of all but its first."""
    return mix(ctx * np.uint64(0x9E3779B97F4A7C15) + mix(suf))


def _longer(run: np.ndarray) -> np.ndarray:
    """Keys of the runs one word longer that end at each token; the first has none."""
    return np.concatenate((run[:1], _key(run[:-1], run[1:])))


# Arrays as rows


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Which of `shards` ranges of equal width a key lies in: sorted keys come shard by shard."""
    return ((key >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def _deal(shard: np.ndarray, kind: int, first: int, cols: list[np.ndarray], whole: int | None = None) -> pa.RecordBatch:
    """One row for each run of equal shards: its entries of all columns, column after column, and of each column byte
    after byte, so that bytes that are alike lie together and compress; a column that repeats itself stays `whole`."""
    begins = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.empty(0, np.int64)
    ends = np.append(begins[1:], len(shard))
    planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T for c in cols]
    data = [b"".join((cols[i][a:b] if i == whole else c[:, a:b]).tobytes() for i, c in enumerate(planes)) for a, b in zip(begins, ends)]
    n = len(begins)
    return pa.RecordBatch.from_arrays([pa.array(shard[begins].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, first, np.int64)), pa.array(data, pa.binary())], ["shard", "kind", "first", "data"])


def _cut(data: bytes, kinds: tuple[np.dtype, ...], whole: int | None = None) -> list[np.ndarray]:
    n, at, out = len(data) // sum(k.itemsize for k in kinds), 0, []
    for i, k in enumerate(kinds):
        out.append(np.frombuffer(data, k, n, at) if i == whole else np.ascontiguousarray(np.frombuffer(data, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n).T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        for kind, first, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            yield kind, first, data.as_buffer()


def _shards_of(rows: DataFrame, total: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD + 1)


def _dealt_table(table: DataFrame, columns: list[tuple[str, np.dtype]], shards: int, kind: int = 0) -> DataFrame:
    """A table keyed by `key` as rows of arrays, dealt by key."""
    kinds = [k for _, k in columns]

    def sent(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate([h[i] for h in held]) for i in range(len(kinds))]
        order = np.argsort(cols[0])
        cols = [c[order] for c in cols]
        return _deal(_shard(cols[0], shards), kind, 0, cols)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64 if k == U8 else k, copy=False).view(k) for i, k in enumerate(kinds)])
                size += b.num_rows
            if size > FLUSH // 4:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    return table.select(*[c for c, _ in columns]).mapInArrow(deal, _DEALT)


def _sums(key: np.ndarray, count: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, sums of their counts, and what goes with them."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[new], np.add.reduceat(count[order].astype(np.int64), new) if len(new) else np.empty(0, np.int64), *[m[order][new] for m in more]


def _counted(keys_of: Callable, shards: int, hot: np.ndarray | None = None):
    """Counts of the keys that `keys_of` draws from each chunk, or of the runs that its pairs (ctx, suf) are, merged
    within FLUSH entries and dealt: keys by themselves, runs by suf, or by the whole run where suf is hot."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        if len(held[0]) == 1:
            key, n = _sums(np.concatenate([h[0] for h in held]), np.ones(sum(len(h[0]) for h in held), np.int64))
            return _deal(_shard(key, shards), 1, 0, [key, n.astype(U4)])
        ctx, suf = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        key = _key(ctx, suf)
        by = np.where(_find(hot, suf) >= 0, key, suf)
        order = np.argsort((by >> HALF << HALF) | (key >> HALF))  # equal runs side by side, but for rare ones that are counted in parts
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        at = order[new]
        return _deal(_shard(by[at], shards), 1, 0, [ctx[at], suf[at], np.diff(new, append=len(key)).astype(U4)], whole=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in words(batch.column(0)):
                held.append(keys_of(chunk))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    return counted


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of dealt counts."""
    keys, counts, size = [], [], 0
    for _, _, data in _rows(batches):
        key, n = _cut(data, (U8, U4))
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size > 2 * FLUSH:
            key, n = _sums(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [key], [n], 0
    if keys:
        key, n = _sums(np.concatenate(keys), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def _repeated(hot: np.ndarray, hot_p: np.ndarray):
    """(ctx, suf, key, n, parent) of runs counted LEAST times or more whose suf is in the table (key, p) of open runs
    that comes with them, or hot."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, size = [(hot, hot_p)], [], 0

        def merged() -> tuple[np.ndarray, ...]:
            ctx, suf, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            return _sums(_key(ctx, suf), n, ctx, suf)

        for kind, _, data in _rows(batches):
            if kind == 0:
                tables.append(tuple(_cut(data, (U8, F8))))
                continue
            held.append(_cut(data, (U8, U8, U4), whole=1))
            size += len(held[-1][0])
            if size > 2 * FLUSH:
                _, n, ctx, suf = merged()
                held, size = [(ctx, suf, n)], 0
        if not held:
            return
        key, n, ctx, suf = merged()
        known, p = (np.concatenate([t[i] for t in tables]) for i in (0, 1))
        order = np.argsort(known, kind="stable")
        known, p = known[order], p[order]
        where = _find(known, suf)
        ok = (where >= 0) & (n >= LEAST)
        key, n, ctx, suf, where = (x[ok] for x in (key, n, ctx, suf, where))
        for at in range(0, len(key), 1 << 16):
            part = slice(at, at + (1 << 16))
            longs = [pa.array(x[part].view(np.int64)) for x in (ctx, suf, key, n)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(p[where[part]])], ["ctx", "suf", "key", "n", "parent"])

    return repeated


# Bit maps


def _map_of(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit map of fixed size (BITS) that has two bits in one word for each key; others may share them."""
    bits = BITS if bits is None else bits
    inside = min(bits, BLOCK)

    def addresses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if got:
            key = np.concatenate(got)
            first = key & np.uint64((1 << bits) - 1)
            at = np.sort(np.concatenate((first, (first & ~np.uint64(63)) | _second(key))))
            at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
            yield _deal(at >> np.uint64(inside), 0, 0, [(at & np.uint64((1 << inside) - 1)).astype(U4)])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(3)):
                blocks.setdefault(shard, np.zeros(1 << inside, bool))[_cut(data.as_buffer(), (U4,))[0]] = True
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())], ["block", "bits"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keys.select("key").mapInArrow(addresses, _DEALT).repartition(parts, "shard").mapInArrow(merged, "block int, bits binary")
    out = np.zeros((1 << (bits - inside), 1 << (inside - 3)), dtype=np.uint8)
    for batch in found.toArrow().to_batches():
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            out[block] = np.frombuffer(data.as_buffer(), np.uint8)
    return out.reshape(-1).view(np.uint64)


def _second(key: np.ndarray) -> np.ndarray:
    """The second bit of a key in its word of a bit map: the first is told by the last bits of the key."""
    return key >> np.uint64(58)


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = bits[(keys >> np.uint64(6)) & np.uint64(len(bits) - 1)]
    return (word >> (keys & np.uint64(63))) & (word >> _second(keys)) & np.uint64(1) != 0


def _runs_of(shared, k: int):
    """Runs of k + 1 words: their first k may repeat, their last k may repeat and be open."""

    def keys_of(chunk: Words) -> tuple[np.ndarray, ...]:
        seen, open_ = shared.value
        run, doc = _tokens(chunk)
        for _ in range(k - 1):
            run = _longer(run)
        ctx, suf = run[k - 1 : -1], run[k:]
        at = np.flatnonzero(doc[k:] == doc[:-k])
        at = at[_in_map(open_, suf[at])]
        at = at[_in_map(seen, ctx[at])]
        return ctx[at], suf[at]

    return keys_of


def _common(table: DataFrame, least: float, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and a column of those whose count has a share of all, which bounds their number. Rows of one key
    add up."""
    got = table.where(F.col("n") >= max(LEAST, least)).select("key", column).toArrow()
    key, value = got["key"].to_numpy().view(np.uint64), got[column].to_numpy()
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, value, minlength=len(key)).astype(value.dtype)


def _commonest(values: DataFrame, most: int, column: str = "value") -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and a column of those that occur most often, `most` at most: those above the least count, an eighth of
    a power of two, that few enough reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = values.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for row in sizes:
        held += row["rows"]
        if held > most:
            break
        least = row["step"]
    return _common(values.where(step >= least if least is not None else F.lit(False)), 0, column)


def _freed(spark: SparkSession) -> None:
    """Let go of the files of shuffles that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def grown(texts: DataFrame, depth: int = DEPTH, whole: bool = False) -> Tree:
    """The tree of a table's `text` column; its runs and states are kept besides its values if it is asked for whole."""
    spark = texts.sparkSession
    texts = texts.select("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draw = _counted(lambda chunk: (_tokens(chunk)[0],), 4 * parts)
    vocabulary = saved(texts.mapInArrow(draw, _DEALT).repartition(parts, "shard").mapInArrow(_vocabulary, "key long, n long"))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    may_gain = lambda n, p: n * -F.log(p) >= GAIN
    shorter = vocabulary.where(F.col("n") >= LEAST).withColumn("p", (F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    shorter = shorter.select("key", "n", "p", may_gain(F.col("n"), F.col("p")).alias("open"))
    shards = _shards_of(texts, total)
    runs, states, values = [], [], []
    for k in range(1, depth + 1):
        may = spark.sparkContext.broadcast((_map_of(shorter), _map_of(shorter.where("open"))))
        _freed(spark)
        hot, hot_p = _common(shorter.where("open"), total / HOT, "p")
        counts = texts.mapInArrow(_counted(_runs_of(may, k), 4 * shards, hot), _DEALT)
        dealt = _dealt_table(shorter.where("open"), [("key", U8), ("p", F8)], 4 * shards).unionByName(counts).repartition(shards, "shard")
        rows = saved(dealt.mapInArrow(_repeated(hot, hot_p), "ctx long, suf long, key long, n long, parent double"))
        may.destroy()
        del counts, dealt
        _freed(spark)
        n = F.col("n").cast("double")
        tested = rows.groupBy("ctx").agg(
            F.sum(n * F.log(n / F.col("parent"))).alias("told"), F.sum("n").alias("held"), F.sum("parent").alias("above"), F.count("*").alias("times"))
        tested = tested.join(shorter.select(F.col("key").alias("ctx"), F.col("n").alias("size")), "ctx")
        held, size = F.col("held") / F.col("size"), F.col("size").cast("double")
        rest, rest_above = F.greatest(1 - held, F.lit(1e-12)), F.greatest(1 - F.col("above"), F.lit(1e-12))
        gain = F.col("told") - F.col("held") * F.log(size) + size * rest * F.log(rest / rest_above)
        kept = tested.where(gain >= GAIN).select("ctx", "size", (1 - (F.col("held") - DISCOUNT * F.col("times")) / size).alias("stay"))
        kept = saved(kept)
        p = F.when(F.col("stay").isNotNull(), (n - DISCOUNT) / F.col("size") + F.col("stay") * F.col("parent")).otherwise(F.col("parent"))
        value = F.when(F.col("stay").isNotNull(), F.log10(p / F.col("parent") / F.col("stay")))
        longer = rows.join(kept, "ctx", "left").select("key", "n", p.alias("p"), value.alias("value"))
        longer = saved(longer.withColumn("open", may_gain(n, F.col("p"))))
        valued = kept.select(F.col("ctx").alias("key"), F.col("size").alias("n"), F.log10("stay").alias("value")).unionByName(longer.where("value is not null").select("key", "n", "value"))
        values.append(saved(valued))
        if whole:
            runs.append(saved(rows.join(longer.select("key"), "key").join(kept.select("ctx", "size"), "ctx", "left")))
            states.append(kept)
        discard(rows, *([] if whole else [kept]), *([] if k == 1 else [shorter]))
        shorter = longer
        _freed(spark)  # those of the joins too, before the next pass writes its own
    if depth:
        discard(shorter)
    every = values[0] if values else vocabulary.where("false").select("key", "n", F.lit(0.0).alias("value"))
    for more in values[1:]:
        every = every.unionByName(more)
    return Tree(total, distinct, vocabulary, runs, states, every)


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """States of one and two words as arrays, for trees that fit into memory, and the table of all words' counts."""
    tree = grown(texts, 2, whole=True)
    found = tree.vocabulary.where(F.col("n") >= LEAST).toPandas().sort_values("key")
    word, count = found["key"].to_numpy(), found["n"].to_numpy()
    a = max(1, len(word))
    one, two = (r.drop("size").join(s.select("ctx", "size", "stay"), "ctx").toPandas() for r, s in zip(tree.runs, tree.states))
    stay1 = np.ones(a)
    stay1[_find(word, one["ctx"].to_numpy())] = one["stay"]
    code = _find(word, one["ctx"].to_numpy()) * a + _find(word, one["suf"].to_numpy())
    order = np.argsort(code)
    pair, place = np.unique(two["ctx"].to_numpy(), return_inverse=True)
    stay2 = np.ones(len(pair))
    stay2[place] = two["stay"]
    last = two[["suf"]].merge(tree.runs[0].select("key", F.col("suf").alias("last")).toPandas(), left_on="suf", right_on="key", how="left")["last"].to_numpy()
    prob1, prob2 = (((x["n"] - DISCOUNT) / x["size"]).to_numpy() for x in (one, two))
    return Model(tree.total, tree.distinct, word, count, a, stay1, code[order], prob1[order], pair, stay2, place * a + _find(word, last), prob2), tree.vocabulary


class Known(NamedTuple):
    """What each task has at hand."""

    bottom: int
    word: np.ndarray  # sorted hashes of the words looked up
    count: np.ndarray
    run: np.ndarray  # sorted keys of the runs looked up
    value: np.ndarray
    may: np.ndarray  # bit map of all runs with a value
    depth: int


WORD, RUN, ASKED_WORD, ASKED_RUN, SCORED = range(5)  # kinds of rows


def _asked(key: np.ndarray, doc: np.ndarray, kind: int, first: int, shards: int) -> pa.RecordBatch:
    """What documents ask of the tables, each occurrence by itself."""
    order = np.argsort(key)
    key = key[order]
    return _deal(_shard(key, shards), kind, first, [key, doc[order].astype(U4)])


def _scored(shared, shards: int):
    """Rows of a batch: kind SCORED with what is known at once (base, score, n_tokens, n_known by document), and what is
    asked of the tables; documents are numbered from `first`, their rid."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known_root = np.log10((m.count + 1) / m.bottom)
        of_words, of_runs = Lookup(m.word), Lookup(m.run)
        held: dict[int, list] = {ASKED_WORD: [], ASKED_RUN: []}
        start, size = None, 0

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    yield _asked(*(np.concatenate([x[i] for x in parts]) for i in (0, 1)), kind, start, shards)
                parts.clear()

        for batch in batches:
            rid = batch.column(0).to_numpy()
            for chunk in words(batch.column(1)):
                n, first = chunk.hi - chunk.lo, int(rid[chunk.lo])
                start = first if start is None else start
                hashes, doc = _tokens(chunk)
                place = of_words.find(hashes)
                known = place >= 0
                root = np.where(known, known_root[place] if len(known_root) else 0.0, 0.0)  # of others the part that is missing
                more, run = np.zeros(n), hashes
                for k in range(m.depth + 1):
                    at = np.flatnonzero(_in_map(m.may, run))
                    at = at[at >= k]
                    at = at[doc[at] == doc[at - k]]
                    where = of_runs.find(run[at])
                    have = where >= 0
                    more += np.bincount(doc[at[have]], m.value[where[have]], minlength=n)
                    at = at[~have]
                    held[ASKED_RUN].append((run[at], doc[at] + (first - start)))
                    size += len(at)
                    run = _longer(run)
                at = np.flatnonzero(~known)
                held[ASKED_WORD].append((hashes[at], doc[at] + (first - start)))
                size += len(at)
                base = np.bincount(doc, root, minlength=n)
                data = [base, base + more, np.bincount(doc, minlength=n), np.bincount(doc, known, minlength=n)]
                yield _deal(np.full(n, first % shards, np.int64), SCORED, first, [np.ascontiguousarray(d, F8) for d in data])
                if size > FLUSH:
                    yield from sent()
                    start, size = None, 0
        if size:
            yield from sent()

    return scored


_SUMS = "rid long, base double, score double, n_tokens double, n_known double"


def _answered(bottom: int):
    """(rid, base, score, n_tokens, n_known): parts of the documents' sums, from tables and what is asked of them."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list] = {WORD: [], RUN: []}
        asked = []

        def out(rid, *cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rid), *(pa.array(c) for c in cols)], [part.split()[0] for part in _SUMS.split(", ")])

        for kind, first, data in _rows(batches):
            if kind in tables:
                tables[kind].append(_cut(data, (U8, F8)))
            elif kind == SCORED:
                cols = _cut(data, (F8, F8, F8, F8))
                yield out(first + np.arange(len(cols[0])), *cols)
            else:
                asked.append((kind, first, data))
        ready = {}
        for kind, parts in tables.items():
            key, value = (np.concatenate([np.empty(0, d), *[x[i] for x in parts]]) for i, d in ((0, U8), (1, F8)))
            key, place = np.unique(key, return_inverse=True)
            ready[kind] = key, np.bincount(place, value, minlength=len(key))
        asked.sort(key=itemgetter(1))
        for first, rows in groupby(asked, itemgetter(1)):  # one row a document of each batch
            sums = np.zeros((4, 0))
            for kind, _, data in rows:
                key, doc = _cut(data, (U8, U4))
                if (n := int(doc.max()) + 1) > sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, n - sums.shape[1])))
                have, value = ready[WORD if kind == ASKED_WORD else RUN]
                where = _find(have, key)
                there = where >= 0
                found = np.where(there, value[where] if len(value) else 0.0, 0.0)
                if kind == ASKED_WORD:
                    log = np.bincount(doc, np.log10((found + 1) / bottom), minlength=n)
                    sums[0, :n] += log
                    sums[1, :n] += log
                    sums[3, :n] += np.bincount(doc, there, minlength=n)
                else:
                    sums[1, :n] += np.bincount(doc, found, minlength=n)
            some = np.flatnonzero(sums.any(0))
            yield out(first + some, *sums[:, some])

    return answered


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, depth: int = DEPTH) -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The tree learns from documents whose crc32(id as text) mod `folds` is not `held_fold`; a null id counts as the empty
    text. Null texts are empty: they consist of the end token alone. Unseen words get the add-one share of a count of 0.
    Repeated rows are each scored, and each learned from. Contexts are of up to `depth` words, any number. Other columns
    are ignored; an empty table gives none. `docs` is to come from files, whose rows keep their order when read again.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (fold == held_fold).alias("held"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    tree = grown(rows.where(~F.col("held")), depth)
    _freed(spark)
    bottom, vocabulary, values = tree.total + tree.distinct + 1, tree.vocabulary, tree.values
    known = Known(bottom, *_commonest(vocabulary, LOOKUP, "n"), *_commonest(values, RUN_LOOKUP), _map_of(values, BITS + 1), depth)
    shared = spark.sparkContext.broadcast(known)
    shards = _shards_of(docs, tree.total)
    sums = None
    for i in range(PASSES):
        _freed(spark)
        asking = rows.where(F.shiftright("rid", 33) % PASSES == i)  # whole partitions: numbers of rows stay without gaps
        dealt = asking.select("rid", "text").mapInArrow(_scored(shared, 4 * shards), _DEALT)
        dealt = dealt.unionByName(_dealt_table(vocabulary, [("key", U8), ("n", F8)], 4 * shards, WORD)).unionByName(_dealt_table(values, [("key", U8), ("value", F8)], 4 * shards, RUN))
        parts = dealt.repartition(shards, "shard").mapInArrow(_answered(bottom), _SUMS)
        part = parts.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("base", "score", "n_tokens", "n_known")])
        if i < PASSES - 1:
            part = saved(part)
        sums = part if sums is None else sums.unionByName(part)
        del dealt, parts, part
    return rows.select("rid", "id", "held").join(sums, "rid").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
