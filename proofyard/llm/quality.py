"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - w . x): the weights of hashed text are shared by all grades, the thresholds are
ordered. The words a document holds, the endings of its words and how often a word repeats the one before are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import near, packed, saved, unpacked
from .tokens import Words, words

SAMPLE = 8000  # labelled documents that the model is fitted on, drawn by hash of the id
WORDS, ENDINGS = 1 << 18, 1 << 12
SIZE = WORDS + ENDINGS + 1
LEAST = 5  # labelled documents that must hold a feature
RIDGE = 5e-3
STEPS = 600
ACCEPT = 0.5  # probability of the top grade from which a document is selected

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = 97
_CLASS[48:58] = 48
_CLASS[128:] = 97


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: good but toxic, 2: good. Null without a rating of quality."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


def both(column: pa.Array) -> Iterator[tuple[Words, Words]]:
    """Chunks of a column as words and as bare words."""
    return zip(words(column), words(column, bare=True))


def features(chunk: Words, bare: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), each feature of a document once."""
    n = chunk.hi - chunk.lo
    count = np.maximum(np.diff(chunk.first), 1)
    key = np.unique(bare.doc * SIZE + (bare.hashes % np.uint64(WORDS)).astype(np.int64))
    kind = _CLASS[chunk.low]
    ending = np.zeros(len(chunk.stop), dtype=np.uint64)
    for back in (3, 2, 1):
        at = chunk.stop - back
        ending = ending * np.uint64(257) + np.where(at >= chunk.start, kind[np.maximum(at, 0)] if len(kind) else 0, np.uint64(1))
    ending = WORDS + (ending * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 12)).astype(np.int64)
    ends, times = np.unique(chunk.doc * SIZE + ending, return_counts=True)
    again = np.zeros(len(chunk.hashes), dtype=bool)
    again[1:] = (chunk.hashes[1:] == chunk.hashes[:-1]) & (chunk.doc[1:] == chunk.doc[:-1])
    repeats = np.bincount(chunk.doc[again], minlength=n)
    docs = np.flatnonzero(repeats)
    doc = np.concatenate([key // SIZE, ends // SIZE, docs])
    feature = np.concatenate([key % SIZE, ends % SIZE, np.full(len(docs), SIZE - 1)])
    value = np.concatenate([np.ones(len(key)), 3 * np.sqrt(times / count[ends // SIZE]), 3 * np.sqrt(repeats[docs] / count[docs])])
    return doc, feature, value


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, bare in both(batch.column(1)):
            n = chunk.hi - chunk.lo
            doc, feature, value = features(chunk, bare)
            order = np.argsort(doc, kind="stable")
            edge = pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.lo, n), batch.column(2).slice(chunk.lo, n), pa.ListArray.from_arrays(edge, pa.array(feature[order].astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(value[order].astype(np.float32)))],
                ["grade", "rated", "feature", "value"],
            )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model of the sample, which is one partition."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False), pc.list_flatten(b.column(1)).to_numpy(), pc.list_flatten(b.column(2)).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    grades, size, feature, value = (np.concatenate(x) for x in zip(*parts))
    model = fit(grades, np.repeat(np.arange(len(size), dtype=np.int32), size), feature, value)
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model.weights]), pa.array([model.thresholds])], ["weights", "thresholds"])


def fit(grades: np.ndarray, rows: np.ndarray, feature: np.ndarray, value: np.ndarray) -> Model | None:
    """Maximum likelihood with a ridge, by gradient steps with momentum and per-weight scaling. None below two grades.

    `rows` is the document of each (feature, value)."""
    levels = np.unique(grades)
    if len(levels) < 2:
        return None
    y = np.searchsorted(levels, grades)
    k, n = len(levels), len(y)
    held = np.bincount(feature, minlength=SIZE) >= min(LEAST, max(1, n // 20))
    keep = held[feature]
    rows, value = rows[keep], value[keep]
    used, feature = np.unique(feature[keep], return_inverse=True)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    base = np.log(share / (1 - share))
    # the first threshold and logarithms of the gaps, so that thresholds stay ordered
    state = np.concatenate([np.zeros(len(used)), [base[0]], np.log(np.maximum(np.diff(base), 1e-3))])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    logistic = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for step in range(1, STEPS + 1):
        w, gaps = state[: len(used)], np.exp(state[len(used) + 1 :])
        t = state[len(used)] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, value * w[feature], minlength=n)
        upper = np.where(y < k - 1, logistic(t[np.minimum(y, k - 2)] - z), 1.0)
        lower = np.where(y > 0, logistic(t[np.maximum(y - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = (du - dl) / n
        slope = np.concatenate([np.bincount(feature, value * dz[rows], minlength=len(used)) + RIDGE * w / 10, np.zeros(k - 1)])
        dt = np.array([(dl[y == j + 1].sum() - du[y == j].sum()) / n for j in range(k - 1)])
        slope[len(used)] = dt.sum()
        for j in range(k - 2):
            slope[len(used) + 1 + j] = gaps[j] * dt[j + 1 :].sum()
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        state = state - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(SIZE)
    weights[used] = state[: len(used)]
    return Model(weights, state[len(used)] + np.concatenate([[0], np.cumsum(np.exp(state[len(used) + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Model | None:
    """A model of the graded documents among `labels` (doc_id, quality, toxic), or None if they hold under two grades."""
    rated = labels.select(F.col("doc_id").alias("_rated"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null and _rated is not null")
    drawn = saved(rated.orderBy(F.xxhash64("_rated"), "_rated", "grade").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("_rated"))
    rows = rows.select("grade", "text", F.col("_rated").cast("string").alias("rated"))
    rows = rows.mapInArrow(_sampled, "grade int, rated string, feature array<int>, value array<float>")
    # the sample is bounded: one task fits it, in an order that reruns repeat
    rows = rows.repartition(1).sortWithinPartitions("rated", "grade").select("grade", "feature", "value")
    got = rows.mapInArrow(_fitted, "weights array<double>, thresholds array<double>").first()
    return None if got is None else Model(np.array(got["weights"]), np.array(got["thresholds"]))


def probabilities(model: Model, z: np.ndarray) -> np.ndarray:
    """P(grade >= j) for j = 1 to the top, a column each."""
    return 0.5 * (1 + np.tanh((z[:, None] - model.thresholds[None, :]) / 2))


def _scored(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk, bare in both(batch.column(1)):
                n = chunk.hi - chunk.lo
                doc, feature, value = features(chunk, bare)
                over = probabilities(model, np.bincount(doc, value * model.weights[feature], minlength=n))
                some = np.diff(chunk.first) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, n), pa.array(np.where(some, over.sum(axis=1), 0.0)), pa.array(np.where(some, over[:, -1], 0.0))], ["id", "expected_grade", "p_top"])

    return scored


def _rate(rows: DataFrame, kind: str, model: Model | None) -> DataFrame:
    if model is None:
        return rows.select("id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_top"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared), f"id {kind}, expected_grade double, p_top double")


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: id, expected_grade, p_top (probability of the top grade), accepted (p_top >= accept).

    Texts are read whole. Null, empty and blank texts have expected grade and p_top 0 and are not accepted. Where the
    labels rate no document or all alike there is no model: grades are null and all documents accepted. Labels of
    unknown documents or without a rating are ignored, repeated ones each count; null ids and repeated rows are rated
    like others. Other columns are ignored; an empty table gives none. The model is fitted on at most `sample` labelled
    documents, drawn by hash of their ids; every document is rated.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = train(docs, labels, id_col, text_col, sample)
    rated = _rate(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kind, model)
    return rated.select(F.col("id").alias(id_col), "expected_grade", "p_top", F.coalesce(F.col("p_top") >= accept, F.lit(True)).alias("accepted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, sample: int = SAMPLE, rejected_rows: int = 2_000_000) -> DataFrame:
    """The accepted rows of `docs` with all their columns; see `rate`. `docs` is to come from files, whose rows keep
    their order when read again."""
    rows = packed(docs)
    model = train(docs, labels, id_col, text_col, sample)
    rated = _rate(rows.select(F.col("rid").alias("id"), F.col("row")[text_col].alias("text")), "bigint", model)
    bad = saved(rated.where(F.col("p_top") < accept).select(F.col("id").alias("rid")))
    return unpacked(rows.join(near(bad, rejected_rows), "rid", "left_anti"))
