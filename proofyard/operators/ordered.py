"""Folds whose every step rests on the one before, key by key and in order.

Rows are dealt by key, sorted inside their partitions and read once, in batches: a key's state is carried from one batch
to the next, so that memory is that of one state, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, key: list[str], order: list[str], start: Callable[[], object], step: Callable, out: str) -> DataFrame:
    """What `step` (state, row of the columns of `rows` after `key`) -> (state, values of `out`) gives for every row, with
    the key's and the order's columns before it. Rows of one key are one sequence: they are read by one task."""
    wanted = [*key, *order, *[c for c in rows.columns if c not in (*key, *order)]]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*key, *order))
    names = [*key, *order, *[part.split()[0] for part in out.split(", ")]]
    k, lead = len(key), len(key) + len(order)

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            listed = []
            for row in frame.itertuples(index=False, name=None):
                if row[:k] != now:
                    now, state = row[:k], start()
                state, values = step(state, row[k:])
                listed.append((*row[:lead], *values))
            yield pd.DataFrame(listed, columns=names)

    dealt = rows.select(*wanted).repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, *order)
    return dealt.mapInPandas(folded, f"{kinds}, {out}")


def group_commits(rows: DataFrame, key: str, order: str, most_rows: int = 256, most_bytes: int = 5 << 20, most_ms: int = 10) -> DataFrame:
    """(key, order, flush): the number of the flush each row (key, order, n_bytes, at_ms) goes out with. A flush ends
    before the row that would exceed its rows or bytes, or comes more than `most_ms` after its first."""

    def step(state, row):
        flush, n, size, since = state
        _, n_bytes, at = row
        if n and (n >= most_rows or size + n_bytes > most_bytes or at - since > most_ms):
            flush, n, size = flush + 1, 0, 0
        since = at if n == 0 else since
        return (flush, n + 1, size + n_bytes, since), (flush,)

    return fold(rows.select(key, order, "n_bytes", "at_ms"), [key], [order], lambda: (0, 0, 0, 0), step, "flush long")


def breaker(calls: DataFrame, key: str, order: str, failures: int = 5, open_ms: int = 5000) -> DataFrame:
    """(key, order, state, allowed) of calls (key, order, at_ms, ok): closed until `failures` in a row fail, then open and
    refusing for `open_ms`, then half open for one call, which closes it or opens it again."""

    def step(state, row):
        kind, failed, since = state
        _, at, ok = row
        if kind == "open" and at - since >= open_ms:
            kind = "half_open"
        allowed = kind != "open"
        seen = kind
        if allowed:
            if ok:
                kind, failed = "closed", 0
            else:
                failed += 1
                if kind == "half_open" or failed >= failures:
                    kind, since = "open", at
        return (kind, failed, since), (seen, allowed)

    return fold(calls.select(key, order, "at_ms", "ok"), [key], [order], lambda: ("closed", 0, 0), step, "state string, allowed boolean")


WINDOW = 10


def delta_window(writes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(leaf, sequence_number, accepted, reason) of writes (leaf, sequence_number, prior, commutative) that name the tip
    they were made on.

    A write without a prior is accepted. A strict one is accepted if its prior is the leaf's tip; a commutative one also
    if it is among the last `window` tips. An accepted write is the new tip; before the first there is none, and any
    prior is stale."""

    def step(tips, row):
        seq, prior, commutative = row
        prior = None if pd.isna(prior) else int(prior)
        reason = "first" if prior is None else "tip" if tips and prior == tips[-1] else "window" if commutative and prior in tips else "stale"
        if reason != "stale":
            tips = (*tips, int(seq))[-window:]
        return tips, (reason != "stale", reason)

    return fold(writes.select("leaf", "sequence_number", "prior", "commutative"), ["leaf"], ["sequence_number"], tuple, step, "accepted boolean, reason string")
