"""Pairs inside buckets without a group of unbounded size: large buckets are cut into blocks, and every two blocks meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, key: list[str], member: str, count: str, size: int, partitions: int) -> DataFrame:
    """Adds bucket (one long), i, j and side: rows of one (bucket, i, j) are to be compared, side 0 with side 1 if i < j,
    all with each other if i = j. `count` holds the bucket's size; of a bucket of n rows each goes to n / size blocks."""
    n = F.ceil(F.col(count) / size).cast("int")
    rows = rows.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_s", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        F.xxhash64(*key).alias("bucket"), F.least("_s", "_t").alias("i"), F.greatest("_s", "_t").alias("j"),
        F.when(F.col("_s") > F.col("_t"), 1).otherwise(0).alias("side"),
    )
    return rows.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", member)


def _parts(rest: str, size: int) -> tuple[Column, Column]:
    """Blocks that those outside a bucket's largest group fill, and those inside."""
    return tuple(F.greatest(F.ceil(x / size).cast("int"), F.lit(1)) for x in (F.col(rest), F.col("n") - F.col(rest)))


def copies_across(rest: str, size: int) -> Column:
    """Rows that `blocked_across` makes of a bucket."""
    small, large = _parts(rest, size)
    return (F.col("n") - F.col(rest)) * small + F.col(rest) * (large + small)


def blocked_across(rows: DataFrame, key: list[str], member: str, rest: str, most: str, size: int, partitions: int) -> DataFrame:
    """As `blocked`, for buckets whose members fall into groups, where only members of different groups are compared.

    `most` marks members of the bucket's largest group, `rest` and `n` hold how many are in it and in the bucket.
    Members of the largest group are not compared with each other: each goes to as many blocks as the others fill, each
    other to as many as the bucket fills. A stranger in a bucket of n is copied n / size times, the n only once."""
    small, large = _parts(rest, size)
    own = F.pmod(F.xxhash64(member), F.when(F.col(most), large).otherwise(small)).cast("int")
    rows = rows.withColumns({"_own": own, "_small": small, "_large": large})
    # blocks of the largest group have negative numbers
    meets = F.when(F.col(most), F.sequence(F.lit(0), F.col("_small") - 1)).otherwise(F.concat(F.sequence(-F.col("_large"), F.lit(-1)), F.sequence(F.lit(0), F.col("_small") - 1)))
    rows = rows.withColumn("_own", F.when(F.col(most), -1 - F.col("_own")).otherwise(F.col("_own"))).withColumn("_t", F.explode(meets))
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        F.xxhash64(*key).alias("bucket"), F.least("_own", "_t").alias("i"), F.greatest("_own", "_t").alias("j"),
        F.when(F.col("_own") > F.col("_t"), 1).otherwise(0).alias("side"),
    )
    return rows.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", member)


def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of one (bucket, i, j) each, with two rows or more, from a partition that `blocked` has sorted."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        cols = [frame[c].to_numpy() for c in ("bucket", "i", "j")]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cut = np.concatenate(([0], new, [len(frame)]))
        for a, b in zip(cut[:-2], cut[1:-1]):
            if b - a > 1:
                yield frame.iloc[a:b]
        rest = frame.iloc[cut[-2] :]
    if rest is not None and len(rest) > 1:
        yield rest
