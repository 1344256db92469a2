"""Counts, quorums, histograms and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GHOST, LIVE, TOMBSTONE

# Upper bounds of the latency buckets, in microseconds; the last bucket is open.
BUCKETS_US = [1000, 5000, 10_000, 50_000, 100_000, 500_000, 1_000_000]


def leaf_count(leaves: DataFrame) -> DataFrame:
    return leaves.agg(F.count("*").alias("leaves"))


def cursor_lag(entries: DataFrame, cursor: int) -> DataFrame:
    """max(sequence), 0 for an empty log, minus the cursor, at least 0."""
    return entries.agg(F.greatest(F.coalesce(F.max("sequence_number"), F.lit(0)) - cursor, F.lit(0)).alias("lag"))


def next_expected_seq(entries: DataFrame) -> DataFrame:
    return entries.agg((F.coalesce(F.max("sequence_number"), F.lit(-1)) + 1).alias("next_seq"))


def conservation_counts(entries: DataFrame, cursor: int, leaves: int = 0) -> DataFrame:
    """One row: entries, ghosts and others, first and last sequence, gaps, and what the cursor has passed beyond leaves
    and ghosts. All over one scan."""
    total, ghosts = F.count("*"), F.count_if(F.col("status") == GHOST)
    last = F.coalesce(F.max("sequence_number"), F.lit(-1))
    return entries.agg(
        total.alias("total"), ghosts.alias("ghosts"), F.count_if(F.col("status") != GHOST).alias("primaries"), F.min("sequence_number").alias("first_seq"),
        F.max("sequence_number").alias("last_seq"), (last + 1 - total).alias("gaps"), (F.lit(cursor + 1 - leaves) - ghosts).alias("leapfrog"))


def quorum_heads(heads: DataFrame, sigs: DataFrame, k: int) -> DataFrame:
    """Heads with at least k different signers: counted by head first, then joined."""
    counts = sigs.groupBy("tree_size", "hash_algo").agg(F.countDistinct("signer").alias("signers")).where(F.col("signers") >= k)
    return heads.join(counts, ["tree_size", "hash_algo"])


def hash_distinctness(entries: DataFrame) -> DataFrame:
    """Rows and distinct hashes, of all entries and of those that are no ghosts (which must agree)."""
    primary = F.when(F.col("status") != GHOST, F.col("canonical_hash"))
    return entries.agg(F.count("*").alias("total"), F.countDistinct("canonical_hash").alias("distinct_hashes"), F.count(primary).alias("primaries"), F.countDistinct(primary).alias("distinct_primaries"))


def min_max_contiguity(entries: DataFrame) -> DataFrame:
    n, lo, hi = F.count("*"), F.min("sequence_number"), F.max("sequence_number")
    return entries.agg(n.alias("n"), lo.alias("lo"), hi.alias("hi"), F.coalesce((lo == 0) & (hi == n - 1), F.lit(True)).alias("contiguous"))


def gossip_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("originator").agg(F.count("*").alias("events"), F.max("lamport").alias("head")).agg(
        F.sum("events").alias("events"), F.count("*").alias("originators"), F.max("head").alias("highest"))


def latency_histogram(samples: DataFrame, us: str = "us") -> DataFrame:
    """(bucket, n): samples below each bound and not below the one before; the last bucket is open."""
    bucket = F.lit(len(BUCKETS_US))
    for i in reversed(range(len(BUCKETS_US))):
        bucket = F.when(F.col(us) < BUCKETS_US[i], i).otherwise(bucket)
    return samples.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def latency_summary(samples: DataFrame, us: str = "us") -> DataFrame:
    return samples.agg(F.count("*").alias("n"), F.sum(us).alias("total"), F.min(us).alias("least"), F.max(us).alias("most"), F.expr(f"sum({us}) div count(*)").alias("mean"))


def approx_p99(histogram: DataFrame) -> DataFrame:
    """The upper bound of the first bucket whose running count reaches n - n div 100; null for the open one. The window
    is over eight buckets."""
    w = Window.orderBy("bucket")
    run = histogram.withColumn("running", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    first = run.where(F.expr("running >= total - total div 100")).agg(F.min("bucket").alias("bucket"))
    bounds = F.array(*[F.lit(b).cast("long") for b in BUCKETS_US])
    return first.select("bucket", F.get(bounds, F.col("bucket")).alias("p99_us"))


def nearest_rank_quantiles(samples: DataFrame, us: str = "us", per_mille: tuple[int, ...] = (500, 950, 990, 999)) -> DataFrame:
    """(per_mille, value): sorted[n * p div 1000], at most the last. Ranks come from running counts of the distinct
    values, so that the samples themselves are never in one window."""
    counts = samples.groupBy(us).agg(F.count("*").alias("n"))
    parts = counts.withColumn("_part", F.shiftright(F.col(us).cast("long"), 16))
    before = parts.groupBy("_part").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = parts.join(before.select("_part", "before"), "_part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("_part").orderBy(us)))
    total = samples.agg(F.count("*").alias("total"))
    asked = samples.sparkSession.createDataFrame([(p,) for p in per_mille], "per_mille int").join(F.broadcast(total))
    asked = asked.withColumn("rank", F.expr("least(total * per_mille div 1000, total - 1)"))
    found = run.join(F.broadcast(asked), F.col("upto") > F.col("rank")).groupBy("per_mille").agg(F.min(us).alias("value"))
    return found


def reservoir(samples: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """k rows drawn by hash of a key: the same on every run."""
    return samples.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)


def baseline_delta(now: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Change in per cent against a baseline, 0 where that is 0."""
    rows = now.select(key, F.col(value).alias("now")).join(base.select(key, F.col(value).alias("base")), key)
    return rows.select(key, "now", "base", F.when(F.col("base") == 0, F.lit(0.0)).otherwise(F.round((F.col("now") - F.col("base")) * 100.0 / F.col("base"), 6)).alias("change"))


def throughput(events: DataFrame, seconds: int, least_in: float, least_out: float, most_failed: float) -> DataFrame:
    """Rates of submitted and drained events and the failed share, against their floors."""
    n, out, bad = F.count("*"), F.count_if(F.col("state") == 3), F.count_if(F.col("state") == 4)
    share = F.coalesce(bad / (n - bad + bad), F.lit(0.0))
    return events.agg(
        n.alias("submitted"), out.alias("drained"), bad.alias("failed"),
        ((n / seconds >= least_in) & (out / seconds >= least_out) & (share <= most_failed)).alias("ok"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def backpressure(responses: DataFrame) -> DataFrame:
    """Whether and how often a server asked to wait."""
    return responses.agg(F.coalesce(F.bool_or(F.col("status") == 503), F.lit(False)).alias("any_503"), F.count_if(F.col("status") == 503).alias("n_503"), F.coalesce(F.bool_or(F.col("retry_after").isNotNull()), F.lit(False)).alias("any_retry_after"))


def status_counts(entries: DataFrame, width: int) -> DataFrame:
    """Live entries, tombstones and ghosts by batch of sequences."""
    return entries.groupBy(F.expr(f"sequence_number div {width}").alias("batch")).agg(
        F.count_if(F.col("status") == LIVE).alias("live"), F.count_if(F.col("status") == TOMBSTONE).alias("tombstones"), F.count_if(F.col("status") == GHOST).alias("ghosts"))


def path_counts(entries: DataFrame, width: int) -> DataFrame:
    """Entries of each path by batch."""
    kinds = ["new_leaf", "commentary", "path_a", "path_b", "path_c", "path_d"]
    return entries.groupBy(F.expr(f"sequence_number div {width}").alias("batch")).agg(*[F.count_if(F.col("path") == k).alias(k) for k in kinds])


def table_sizes(table: DataFrame, name: str) -> DataFrame:
    """Rows, columns and the mean length of the rows as JSON; a columnar table has no dead rows."""
    return table.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(table.columns)).alias("columns"), F.expr("0L").alias("dead_rows"))
