"""Mixing sources to target weights by fitting each source's budget of words exactly.

Whole copies of a source come first. What remains of its budget is a bounded knapsack over the counts of its documents by
exact length, solved by dynamic programming. Where that is more than WORK allows, every length first gives its share of
all but the last WINDOW words, and the programme fills these. Documents of each length are then drawn in seeded order: for
each source and length one document, the last that is drawn, decides for all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words, near, packed, saved

WORK = 1 << 32  # sums times steps up to which the programme runs over the whole budget
WINDOW = 1 << 18  # words of a larger budget left to the programme
BROADCAST_ROWS = 100_000  # sources, or sources and lengths, up to which their table is broadcast


def best_sum(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most `free`, so that their sum is the largest possible up to `budget`.

    Sums that can be reached are the bits of one number. Counts go in powers of two; numbers are kept at every so many
    steps, and those between worked out again on the way back, so that memory is in proportion to the square root of the
    number of steps."""
    take, mask, steps = np.zeros(len(sizes), dtype=np.int64), (1 << (budget + 1)) - 1, []
    for i in np.argsort(sizes, kind="stable"):
        size, left, part = int(sizes[i]), min(int(free[i]), budget // int(sizes[i])), 1
        while left > 0:
            part = min(part, left)
            steps.append((int(i), part, part * size))
            left -= part
            part *= 2
    every = max(1, math.isqrt(len(steps)))
    kept, reach, done = [], 1, 0
    for n, (_, _, words) in enumerate(steps):
        if reach >> budget & 1:
            break
        if n % every == 0:
            kept.append(reach)
        reach |= reach << words & mask
        done = n + 1
    at = reach.bit_length() - 1
    for first in range((len(kept) - 1) * every, -1, -every):
        before = [kept[first // every]]
        for _, _, words in steps[first : min(first + every, done) - 1]:
            before.append(before[-1] | before[-1] << words & mask)
        for (i, part, words), held in reversed(list(zip(steps[first : min(first + every, done)], before))):
            if not held >> at & 1:
                take[i] += part
                at -= words
    return take


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most `counts`, so that their sum comes near `budget` from below. Sizes are
    positive and distinct.

    The sum is the largest that any choice gives wherever the sums up to the budget times the steps (the logarithms of
    the counts) are within WORK. Beyond, it is the largest for what is left after each length has given its share, rounded
    down, of the budget less WINDOW, and the longest documents have brought the rest down to WINDOW."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    steps = int(np.ceil(np.log2(counts.astype(float) + 1)).sum())
    if steps * budget <= WORK:
        return best_sum(sizes, counts, budget)
    take = np.array([int(n) * max(0, budget - WINDOW) // total for n in counts], dtype=np.int64)
    left = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        more = min(int(counts[i] - take[i]), max(0, left - WINDOW) // int(sizes[i]))
        take[i] += more
        left -= more * int(sizes[i])
    return take + best_sum(sizes, counts - take, min(left, 2 * WINDOW)) if left > 0 else take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    return group[["sid", "size"]].assign(n=counts, extra=fill(sizes, counts, int(group["rest"].iloc[0])))


def targets(sources: DataFrame, weights: tuple[float, ...], times: int) -> DataFrame:
    """(source, source_size) with sid, target: weights repeat over the sources in code point order, null last; a target
    stops at `times` its source's size, and what is over goes to the others by weight until none is above."""
    schema = sources.schema
    ranked = sources.sort(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    ranked = sources.sparkSession.createDataFrame(ranked, schema.add("sid", "long"))
    ranked = saved(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * float(times)
    share, capped = 0.0, -1
    while True:
        full = cap < F.col("weight") * share
        total, held, free, now = ranked.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(full),
        ).first()
        if now == capped or not free:
            break
        share, capped = (total - held) / free, now
    return ranked.withColumn("target", F.least(cap, F.col("weight") * share)).select("source", "sid", "source_size", "target")


def _order(id_col: Column, rid: Column, seed: int) -> Column:
    """What documents of a source and length are drawn by: the hash of the id, then that of the row. Rows without an id
    are alike."""
    return F.struct(F.coalesce(F.xxhash64(id_col, F.lit(seed)), F.lit(0)).alias("hash"), F.xxhash64(rid).alias("row"))


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Of rows (rid, id, source, size, order): (sid, size, source, source_size, target, whole, cut): documents of a source
    and length up to the cut in order are drawn once more than the whole times; cut is null where none is.

    Counts by parts of the order find the part that holds the last one, so that only its rows are ranked."""
    part = F.shiftright("order.hash", 56).cast("int")
    sub = F.shiftright("order.row", 56).cast("int")
    rows = rows.withColumnRenamed("source", "of").join(near(sources, BROADCAST_ROWS), F.col("of").eqNullSafe(F.col("source"))).where("size > 0").select("sid", "size", "rest", "order")
    counts = saved(rows.groupBy("sid", "size", part.alias("part")).agg(F.count("*").alias("n"), F.first("rest").alias("rest")))
    lengths = counts.groupBy("sid", "size").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).where("rest > 0")
    quota = saved(lengths.groupBy("sid").applyInPandas(_fit, "sid long, size long, n long, extra long").where("extra > 0"))
    all_of, some = quota.where("extra = n"), quota.where("extra < n").drop("n")

    def level(counts: DataFrame, some: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        """Of each group of `keys`, the part that holds number `extra`, and its number inside that part."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.join(near(some, BROADCAST_ROWS), keys).withColumn("before", before).where("before < extra and extra <= before + n")
        return found.select(*keys, *by, (F.col("extra") - F.col("before")).alias("extra"))

    some = saved(level(counts.drop("rest"), some, ["sid", "size"], ["part"]))
    last = saved(rows.withColumn("part", part).join(near(some, BROADCAST_ROWS), ["sid", "size", "part"]).select("sid", "size", "part", "order", "extra"))
    keys = ["sid", "size", "part"]
    counts = last.groupBy(*keys, F.col("order.hash").alias("hash"), sub.alias("sub")).agg(F.count("*").alias("n"))
    some = saved(level(counts, some, keys, ["hash", "sub"]).withColumnRenamed("extra", "at"))
    last = last.withColumn("hash", F.col("order.hash")).withColumn("sub", sub).join(near(some, BROADCAST_ROWS), [*keys, "hash", "sub"])
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "hash", "sub").orderBy("order")))
    cuts = ranked.where("rank = at").select("sid", "size", F.col("order").alias("cut"))
    most = F.struct(F.lit((1 << 63) - 1).alias("hash"), F.lit((1 << 63) - 1).alias("row"))
    return saved(cuts.unionByName(all_of.select("sid", "size", most.alias("cut"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), times: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of `docs`: id, size (its words), source_size (of its source), target (of its source), taken (words
    the mix takes of it, repeats counted: size times copies), copies (0 to `times`).

    Words are runs of other than ASCII white space; null and empty texts have size 0 and give nothing. A null source is a
    source, the last. Equal rows are separate documents, of which a number is taken; documents are drawn in the order of
    a hash of id and seed, those with equal or null ids in that of their rows. Reruns agree. Other columns are ignored; an
    empty table gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = saved(rows.withColumn("order", _order(F.col("id"), F.col("rid"), seed)))
    out = _drawn(rows, *_shares(rows, weights, times))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _shares(rows: DataFrame, weights: tuple[float, ...], times: int) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets and whole copies, and the cuts of their lengths."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, times)
    budget = F.round("target").cast("long")
    sources = saved(sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
                    .withColumn("rest", budget - F.col("whole") * F.col("source_size")))
    return sources, _cuts(rows, sources)


def _drawn(rows: DataFrame, sources: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with source, size and order, and the copies the mix takes of each: by broadcast while the tables of sources
    and lengths are small, so that rows stay where they are."""
    sources = near(sources.select(F.col("source").alias("s_source"), "sid", "source_size", "target", "whole"), BROADCAST_ROWS)
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    rows = rows.join(near(cuts.withColumnsRenamed({"sid": "c_sid", "size": "c_size"}), BROADCAST_ROWS), (F.col("sid") == F.col("c_sid")) & (F.col("size") == F.col("c_size")), "left")
    extra = F.coalesce((F.col("order") <= F.col("cut")).cast("long"), F.lit(0))
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.col("whole"))).drop("c_sid", "c_size", "cut")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), times: int = 3, seed: int = 17) -> DataFrame:
    """Those rows of `docs` of which the mix takes something, with taken and copies beside their columns; columns of
    these names get a leading underscore. What is drawn follows from a row's own source, length and order, so texts are
    read a second time and never shuffled. `docs` is to come from files, whose rows keep their order when read again."""
    rows = packed(docs)
    own = lambda c: F.col("row")[c]
    order = _order(own(id_col), F.col("rid"), seed)
    rows = rows.select("row", F.col("rid"), own(source_col).cast("string").alias("source"), n_words(own(text_col)).alias("size"), order.alias("order"))
    out = _drawn(rows, *_shares(saved(rows.drop("row")), weights, times)).where("copies > 0 and size > 0")
    names = []
    for c in docs.columns:
        name = c
        while name in ("taken", "copies") or name != c and name in docs.columns:
            name = "_" + name
        names.append(own(c).alias(name))
    return out.select(*names, (F.col("size") * F.col("copies")).alias("taken"), "copies")
