"""Near-duplicate embeddings by iterative quantisation: balanced binary codes from a learned rotation, multi-index
Hamming tables to retrieve, original vectors to decide.

The codes of several rotations are cut into tables of `width` bits. Vectors that agree on one table meet in its bucket,
where the Hamming distance of their whole codes picks pairs within the radius of neighbours; of these cosines are taken in
double precision and links counted. A pair that agrees on several tables counts in the first.
A bit of a rotation separates two centred vectors at angle t with probability t / pi, so a pair agrees on a table with
probability p = (1 - t / pi)^width and on one of n with 1 - (1 - p)^n. The angle is that seen from the mean, which is wider
than the pair's own where vectors share a direction. Pairs exactly at the threshold are made from sampled vectors; width
and number of tables follow from their angles, and tables are added until their codes meet as often as is aimed at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, runs
from .graph import components
from .shared import join_hot, saved

SAMPLE = 8192  # vectors that the rotations are learned from
ITERATIONS = 20
RECALL = 0.97  # aimed at for a pair exactly at the threshold
BLOCK = 1024
PAIRS = 2000  # made at the threshold, of each kind, to size tables by
ROW = 64  # cosines that cost as much as a row in a table
MOST_BITS = 62  # of a table: its keys are 64-bit numbers
DENSE = 0.1  # share of pairs within the radius from which all cosines of a block are taken at once


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): `bits` columns, from as many rotations of the principal axes as that takes.

    Each rotation alternates between the nearest codes and the nearest rotation (orthogonal Procrustes)."""
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.svd(centred.T @ centred)[0]
    rng, out, got = np.random.default_rng(seed), [], 0
    low = centred @ axes
    while got < max(bits, 1):
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(low.T @ np.where(low @ turn >= 0, 1.0, -1.0))
            turn = u @ vt
        out.append(axes @ turn)
        got += axes.shape[1]
    return mean, np.concatenate(out, axis=1)[:, :bits]


def _pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled vectors with made partners exactly at the threshold, away in any direction or in that of another vector."""
    rng, distinct = np.random.default_rng(5), np.unique(sample, axis=0)
    x, other = (distinct[rng.integers(len(distinct), size=PAIRS)] for _ in range(2))
    out = []
    for away in (rng.standard_normal(x.shape), other):
        away = away - (away * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(away, axis=1)
        ok = length > 1e-6
        if ok.any():
            out.append((x[ok], threshold * x[ok] + math.sqrt(max(0.0, 1 - threshold * threshold)) * away[ok] / length[ok, None]))
    return out


def _tables(agree: list[np.ndarray], width: int, most: int) -> int:
    """Least number of tables with the recall aimed at for each kind of pairs, given how likely they agree on a bit."""
    recall = lambda n: min((np.mean(1 - (1 - a**width) ** n) for a in agree), default=1.0)
    low, high = 1, 1
    while high < most and recall(high) < RECALL:
        low, high = high + 1, high * 2
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(mid) >= RECALL else (mid + 1, high)
    return low


def fitted(sample: np.ndarray, threshold: float, rows: int, width: int | None = None) -> tuple[tuple[np.ndarray, np.ndarray], int, int, int]:
    """((mean, projections), tables, width, radius). The width is that of least work unless it is given: a row in each
    table and a cosine with each other vector of its bucket. It follows the number of rows, with no upper bound but
    MOST_BITS. A width of 0 compares all with all. The radius is the most bits by which whole codes of made pairs differ,
    and four deviations."""
    mean, pairs, agree = sample.mean(axis=0), _pairs(sample, threshold), []
    for x, y in pairs:
        a, b = x - mean, y - mean
        size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        cosine = np.divide((a * b).sum(axis=1), size, out=np.zeros(len(a)), where=size > 1e-12)
        agree.append(1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi)
    work = lambda w: _tables(agree, w, ROW + rows) * (ROW + rows / 2**w)
    if width is None:
        width = min(range(min(MOST_BITS, max(12, math.ceil(math.log2(rows + 1)))), -1, -1), key=work)
    tables = _tables(agree, width, ROW + rows)
    while True:
        mean, projections = learn_rotations(sample, tables * width)
        met = [np.zeros(len(x), bool) for x, _ in pairs]
        far = [np.zeros(len(x), np.int64) for x, _ in pairs]
        for t in range(0, tables * width, max(width, 1)):
            part = projections[:, t : t + width]
            for m, d, (x, y) in zip(met, far, pairs):
                other = ((x - mean) @ part >= 0) != ((y - mean) @ part >= 0)
                m |= ~other.any(axis=1)
                d += other.sum(axis=1)
        if width == 0 or tables >= ROW + rows or min((m.mean() for m in met), default=1.0) >= RECALL:
            radius = max((int(d.max() + 4 * d.std()) for d in far), default=0) if width else 0
            return (mean, projections), tables, width, radius
        tables += math.ceil(tables / 8)


def _units(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double) of those rows that have a direction."""
    rows, out = [], []
    for i, v in enumerate(column):
        if v is None or len(v) != dim:
            continue
        x = np.asarray(v, dtype=np.float64)  # a null component becomes NaN
        if np.isfinite(x).all() and (top := np.abs(x).max(initial=0)) > 0:
            x = x / top
            rows.append(i)
            out.append(x / math.sqrt(float(x @ x)))
    return np.array(rows, dtype=np.int64), np.array(out).reshape(-1, dim)


def _codes(dim: int, tables: int, width: int, model):
    """For each row its unit vector, code and keys, all null for vectors without a direction and rows without an id."""
    weight = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projections = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n = part.num_rows
                has_id = part.column(1).is_valid().to_numpy(zero_copy_only=False)
                rows, x = _units([v if ok else None for v, ok in zip(part.column(2).to_pylist(), has_id)], dim)
                bit = (x - mean) @ projections >= 0
                key = (bit.reshape(len(x), tables, width) * weight).sum(axis=2, dtype=np.uint64).view(np.int64)
                code = np.packbits(bit, axis=1)
                unit, codes, keys = [None] * n, [None] * n, [None] * n
                for i, r in enumerate(rows.tolist()):
                    unit[r], codes[r], keys[r] = x[i].tobytes(), code[i].tobytes(), key[i]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(unit, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "id", "unit", "code", "keys"])

    return codes


_FAR = np.iinfo(np.int64).max


def _least(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.where(linked, labels[None, :], _FAR).min(axis=1, initial=_FAR)


def _roots_within(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links: the smallest node that each one reaches."""
    roots = np.arange(len(linked))
    while True:
        new = np.minimum(roots, _least(linked, roots))
        if (new == roots).all():
            return roots
        roots = new


def _roots_between(linked: np.ndarray) -> np.ndarray:
    """The same where rows are linked with columns; columns are numbered after the rows."""
    n = len(linked)
    rows, cols = np.arange(n), n + np.arange(linked.shape[1])
    while True:
        new_rows = np.minimum(rows, _least(linked, cols))
        new_cols = np.minimum(cols, _least(linked.T, new_rows))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return np.concatenate([rows, cols])
        rows, cols = new_rows, new_cols


def _words(codes, width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes as 64-bit lanes, for distances, and their keys by table, for what met before."""
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    lanes = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
    bits = np.unpackbits(packed, axis=1, count=tables * width).reshape(len(codes), tables, width)
    return lanes, (bits * (np.uint64(1) << np.arange(width, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _linked(unit: np.ndarray, lanes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, radius: int) -> np.ndarray:
    """Which of `left` and `right` are linked: within the Hamming radius, and by cosine."""
    near = np.empty((len(left), len(right)), bool)
    for at in range(0, len(left), 64):
        far = np.zeros((len(left[at : at + 64]), len(right)), np.int32)
        for lane in lanes.T:
            far += np.bitwise_count(lane[left[at : at + 64], None] ^ lane[None, right])
        near[at : at + 64] = far <= radius
    if near.mean() > DENSE:
        return near & (unit[left] @ unit[right].T >= threshold)
    x, y = np.nonzero(near)
    for at in range(0, len(x), 1 << 14):
        part = slice(at, at + (1 << 14))
        near[x[part], y[part]] = (unit[left[x[part]]] * unit[right[y[part]]]).sum(axis=1) >= threshold
    return near


def _links(threshold: float, width: int, tables: int, radius: int):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames):
            unit = np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), -1)
            lanes, keys = _words(f["code"], width, tables)
            ids, weight, side, t = f["rep"].to_numpy(), f["weight"].to_numpy(), f["side"].to_numpy(), int(f["t"].iloc[0])
            same = f["i"].iloc[0] == f["j"].iloc[0]
            left = np.arange(len(f)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            linked = _linked(unit, lanes, left, right, threshold, radius)
            if same:
                np.fill_diagonal(linked, False)
            x, y = np.nonzero(linked)
            if t and len(x):  # pairs that met in an earlier table counted there
                for at in range(0, len(x), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    before = (keys[left[x[part]], :t] == keys[right[y[part]], :t]).any(axis=1)
                    linked[x[part][before], y[part][before]] = False
            if not linked.any():
                continue
            if same:
                out = {"rep": ids, "links": linked @ weight, "root": ids[_roots_within(linked)]}
            else:
                node = np.concatenate([ids[left], ids[right]])
                out = {"rep": node, "links": np.concatenate([linked @ weight[right], weight[left] @ linked]), "root": node[_roots_between(linked)]}
            out = pd.DataFrame(out)
            yield out[out["links"] > 0]

    return links


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, width: int | None = None) -> DataFrame:
    """One row per row of `vectors`: id, n_links (other vectors with cosine >= threshold that were found), component_id
    (smallest id reachable by links, itself included), kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do those of another
    length than the table's most common one (of equally common ones the longest). Rows without an id link with nothing:
    component_id null, kept true. Equal vectors, also under one id, are separate vectors and linked; different vectors
    under one id are linked only by their cosine. Other columns are ignored; an empty table gives none.

    No pair below the threshold is ever linked. Of those above, recall at the threshold itself is RECALL or more on the pairs
    made from the sample, also where vectors share a direction, and nearer pairs miss less: the tests measure it against
    brute force. Equal vectors are folded into one with a weight
    before anything meets; buckets of any size are compared whole, in blocks, as counts and not as pairs.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = plain.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    lonely = plain.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if sizes is None:
        return lonely.withColumnRenamed("id", id_col)
    dim = sizes["d"]
    drawn = plain.where("id is not null").where(F.size("v") == dim).orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("v").toPandas()["v"]
    sample = _units(drawn, dim)[1]
    if not len(sample):
        return lonely.withColumnRenamed("id", id_col)
    model, tables, width, radius = fitted(sample, threshold, sizes["count"], width)
    model = spark.sparkContext.broadcast(model)
    coded = saved(plain.mapInArrow(_codes(dim, tables, width, model), "rid long, id long, unit binary, code binary, keys array<long>"))
    total = coded.count()
    usable = coded.where("unit is not null")
    # a class of equal vectors is named by a row number, as ids may repeat
    classes = saved(usable.groupBy("unit").agg(F.min("rid").alias("rep"), F.min("id").alias("least"), F.count("*").alias("weight"), F.first("code").alias("code"), F.first("keys").alias("keys")))
    keyed = classes.select("rep", F.posexplode("keys").alias("t", "key"))
    shared = saved(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.count("*").alias("held")).where("n > 1"))
    rows = join_hot(keyed, shared, ["t", "key"], "held", total * tables).join(classes.select("rep", "unit", "code", "weight"), "rep")
    rows = blocked(rows, ["t", "key"], "rep", "n", BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = saved(rows.select("bucket", "i", "j", "side", "rep", "t", "unit", "code", "weight").mapInPandas(_links(threshold, width, tables, radius), "rep long, links long, root long"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), F.col("component_id").alias("root"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = classes.select("rep", "least", "weight").join(counts, "rep", "left").join(comp, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    reps = saved(reps.select("rep", "least", "root", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    groups = saved(reps.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("held")))
    reps = join_hot(reps, groups, ["root"], "held", total).select("rep", "n_links", "component_id")
    reps = saved(classes.select("rep", "unit", "weight").join(reps, "rep").select("unit", "weight", "n_links", "component_id"))
    out = join_hot(usable.select("id", "unit"), reps, ["unit"], "weight", total).select("id", "n_links", "component_id")
    rest = coded.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)
