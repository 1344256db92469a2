"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_hot, saved


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component_id): for every node the smallest node reachable from it, where that is not the node itself.

    Each round joins every node with the smallest of its neighbours, which a grouped minimum (combined before the
    shuffle) finds; the edges of a hub stay where they are. The graph shrinks to stars in a number of rounds that grows with the logarithm of its diameter.
    Nothing but two numbers a round reaches the driver. Null ends and loops are dropped; an empty table gives none.
    """
    now = saved(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen, n = None, now.count()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree")))
        large = join_hot(both, least, ["u"], "degree", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large)
        discard(least)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))
        small = join_hot(large, least, ["u"], "degree", n).where("v <> m").select(F.col("v").alias("x"), F.col("m"))
        small = small.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v"))
        after = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(now, large, least)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        n = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
