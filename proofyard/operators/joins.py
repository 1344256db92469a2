"""Joins of the log's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GHOST, LIVE


def hydrate(index: DataFrame, store: DataFrame) -> DataFrame:
    """Index rows with their bytes, by (sequence_number, canonical_hash), in sequence order. The wide side is joined
    last, so that filters on the index have cut it down."""
    return index.join(store, ["sequence_number", "canonical_hash"]).orderBy("sequence_number")


def first_hit(refs: DataFrame, journal: DataFrame, store: DataFrame) -> DataFrame:
    """Bytes from the journal, else from the store; null where neither has them."""
    rows = refs.join(journal.select("canonical_hash", F.col("data").alias("_j")), "canonical_hash", "left").join(store.select("canonical_hash", F.col("data").alias("_s")), "canonical_hash", "left")
    return rows.select(*refs.columns, F.coalesce("_j", "_s").alias("data"), F.when(F.col("_j").isNotNull(), "journal").when(F.col("_s").isNotNull(), "store").alias("origin"))


def commitment_entries(splits: DataFrame, entries: DataFrame, after: int | None = None, n: int | None = None) -> DataFrame:
    """Split index with entries, by sequence; the rows after a replay mark, at most n, if asked."""
    if after is not None:
        splits = splits.where(F.col("sequence_number") > after)
    rows = splits.join(entries, "sequence_number").orderBy("sequence_number")
    return rows.limit(n) if n else rows


def ghost_redirect(entries: DataFrame) -> DataFrame:
    """(ghost_seq, primary_seq): ghosts with the entry that holds their hash."""
    ghosts = entries.where(F.col("status") == GHOST).select(F.col("sequence_number").alias("ghost_seq"), "canonical_hash")
    primary = entries.where(F.col("status") != GHOST).select(F.col("sequence_number").alias("primary_seq"), "canonical_hash")
    return ghosts.join(primary, "canonical_hash").select("ghost_seq", "primary_seq")


def heads_with_sigs(heads: DataFrame, sigs: DataFrame) -> DataFrame:
    """Heads with their signatures nested, ordered by algorithm (falling) and signer."""
    nested = sigs.groupBy("tree_size", "hash_algo").agg(F.collect_list(F.struct((-F.col("sig_algo")).alias("o"), "signer", "sig_algo", "signature")).alias("s"))
    nested = nested.withColumn("sigs", F.transform(F.array_sort("s"), lambda x: F.struct(x["signer"].alias("signer"), x["sig_algo"].alias("sig_algo"), x["signature"].alias("signature")))).drop("s")
    return heads.join(nested, ["tree_size", "hash_algo"], "left")


def covering(points: DataFrame, ranges: DataFrame, seq: str = "sequence_number", width: int = 1000) -> DataFrame:
    """Every point with the latest range that covers it (ties: highest id): ranges are cut into buckets of `width`,
    so that the join is by equality and the bounds only filter."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.expr(f"range_start_seq div {width}"), F.expr(f"range_end_seq div {width}"))))
    rows = points.withColumn("_b", F.expr(f"{seq} div {width}")).join(cut, "_b").where(F.col(seq).between(F.col("range_start_seq"), F.col("range_end_seq")))
    best = rows.groupBy(*points.columns).agg(F.max_by(F.struct("id", "range_start_seq", "range_end_seq"), F.struct("created_at", "id")).alias("r"))
    return best.select(*points.columns, "r.*")


def resolve_shard(points: DataFrame, shards: DataFrame, width: int = 1000) -> DataFrame:
    """Every position with its shard: an exact match of the log's name first, else a range that holds the sequence (the
    lowest start). `shards` is a small configuration table."""
    exact = points.join(shards.select(F.col("shard_did").alias("log_did"), F.col("shard_did").alias("_exact")), "log_did", "left")
    cut = shards.withColumn("_b", F.explode(F.sequence(F.expr(f"range_start_seq div {width}"), F.expr(f"range_end_seq div {width}"))))
    loose = exact.withColumn("_b", F.expr(f"sequence_number div {width}")).join(
        cut.select("_b", F.col("shard_did").alias("_in"), "range_start_seq", "range_end_seq"), "_b", "left")
    holds = F.col("sequence_number").between(F.col("range_start_seq"), F.col("range_end_seq"))
    best = loose.groupBy(*points.columns, "_exact").agg(F.min_by(F.when(holds, F.col("_in")), F.when(holds, F.col("range_start_seq"))).alias("_in"))
    return best.select(*points.columns, F.coalesce("_exact", "_in").alias("shard_did"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_in").isNotNull(), "range").otherwise("none").alias("how"))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys that are not there."""
    return expected.select(key).join(present.select(key), key, "left_anti")


def existing(hashes: DataFrame, entries: DataFrame) -> DataFrame:
    """Given hashes with the primary that already holds them."""
    primary = entries.where(F.col("status") != GHOST).select("canonical_hash", F.col("sequence_number").alias("existing_seq"))
    return hashes.join(primary, "canonical_hash")


def wal_vs_tree(wal: DataFrame, tree: DataFrame) -> DataFrame:
    """(sequence, verdict) for all sequences of either side: equal, diverged, or skipped where one has no hash."""
    both = wal.select("sequence", F.col("hash").alias("w")).join(tree.select("sequence", F.col("hash").alias("t")), "sequence", "full_outer")
    return both.select("sequence", F.when(F.col("w").isNull() | F.col("t").isNull(), "skipped").when(F.col("w") == F.col("t"), "equal").otherwise("diverged").alias("verdict"))


def root_vs_head(roots: DataFrame, heads: DataFrame) -> DataFrame:
    """Roots of the state tree against the head that covers them: the one of size committed_through_seq + 1."""
    rows = roots.withColumn("tree_size", F.col("committed_through_seq") + 1).join(heads.select("tree_size", "smt_root"), "tree_size", "left")
    return rows.select("committed_through_seq", F.when(F.col("smt_root").isNull(), "no head").when(F.col("smt_root") == F.col("current_root"), "equal").otherwise("diverged").alias("verdict"))


def head_conflicts(local: DataFrame, peer: DataFrame) -> DataFrame:
    """(originator, tree_size, root_a, root_b): heads of one size whose roots differ."""
    rows = local.select("originator", "tree_size", F.col("root_hash").alias("root_a")).join(peer.select("originator", "tree_size", F.col("root_hash").alias("root_b")), ["originator", "tree_size"])
    return rows.where("root_a <> root_b")


def policy_candidates(entries: DataFrame) -> DataFrame:
    """Entries with the sequence they target, the schema of that target, and its live cosigners: a chain of lookups."""
    own = entries.select("sequence_number", "position", "target_root")
    target = entries.select(F.col("position").alias("target_root"), F.col("sequence_number").alias("primary_seq"), F.col("schema_ref").alias("primary_schema"))
    cosigners = entries.where((F.col("status") == LIVE) & F.col("cosignature_of").isNotNull()).groupBy(F.col("cosignature_of").alias("target_root")).agg(F.array_sort(F.collect_set("signer_did")).alias("cosigners"))
    return own.where("target_root is not null").join(target, "target_root").join(cosigners, "target_root", "left").select(
        "sequence_number", "primary_seq", "primary_schema", F.coalesce("cosigners", F.array().cast("array<string>")).alias("cosigners"))


def delegation_of(entries: DataFrame) -> DataFrame:
    """Every live entry with the newest earlier live delegation to its signer: an as-of lookup by sequence, as a running
    maximum within the signer's rows."""
    grants = entries.where((F.col("status") == LIVE) & F.col("delegate_did").isNotNull()).select(F.col("delegate_did").alias("did"), "sequence_number", F.col("sequence_number").alias("grant"))
    uses = entries.where(F.col("status") == LIVE).select(F.col("signer_did").alias("did"), "sequence_number", F.lit(None).cast("long").alias("grant"))
    before = Window.partitionBy("did").orderBy("sequence_number").rangeBetween(Window.unboundedPreceding, -1)
    rows = grants.withColumn("use", F.lit(False)).unionByName(uses.withColumn("use", F.lit(True))).withColumn("delegation_seq", F.max("grant").over(before))
    return rows.where("use and delegation_seq is not null").select("sequence_number", F.col("did").alias("signer_did"), "delegation_seq")


def cosig_binding(entries: DataFrame, local_did: str) -> DataFrame:
    """(sequence_number, verdict) of cosignatures: bound, unbound, or foreign where the target is in another log."""
    rows = entries.where("cosignature_of is not null").select("sequence_number", "cosignature_of")
    known = entries.select(F.col("position").alias("cosignature_of"), F.lit(True).alias("_known"))
    local = F.startswith("cosignature_of", F.lit(local_did + ":"))
    return rows.join(known, "cosignature_of", "left").select("sequence_number", F.when(~local, "foreign").when(F.col("_known"), "bound").otherwise("unbound").alias("verdict"))


def wal_index_outer(wal: DataFrame, entries: DataFrame) -> DataFrame:
    """Counts of hashes by state of the journal and presence in the index."""
    both = wal.select("hash", "state").join(entries.where(F.col("status") != GHOST).select(F.col("canonical_hash").alias("hash"), F.lit(True).alias("_in")), "hash", "full_outer")
    return both.groupBy(F.coalesce("state", F.lit(0)).cast("int").alias("state"), F.coalesce("_in", F.lit(False)).alias("indexed")).agg(F.count("*").alias("n"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two readings has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def with_inputs(column: str, given: Column) -> Column:
    """Membership in an array given as a column."""
    return F.array_contains(given, F.col(column))
