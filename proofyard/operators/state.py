"""Keyed state folded out of ordered events: the journal's state machine, the state tree's leaves, metrics of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MANUAL, PENDING, SEQUENCED, SHIPPED


def fold_journal(operations: DataFrame, key: str = "hash", order: str = "ord") -> DataFrame:
    """(key, state, sequence, attempts, refused): operations submit, sequence, ship, retry and manual, in order.

    Submit starts at pending and is idempotent; pending becomes sequenced (again with the same sequence: no change);
    sequenced or manual becomes shipped; anything but shipped becomes manual; a retry of what is pending or sequenced
    counts an attempt. All else is refused and counted."""
    ops = operations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "op", "sequence"))).alias("ops"))
    zero = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("sequence"), F.lit(0).alias("attempts"), F.lit(0).alias("refused"))

    def step(s, o):
        def to(state, sequence=None, attempts=None, refused=None):
            return F.struct(
                (s["state"] if state is None else F.lit(state)).alias("state"), (s["sequence"] if sequence is None else sequence).alias("sequence"),
                (s["attempts"] if attempts is None else attempts).alias("attempts"), (s["refused"] if refused is None else refused).alias("refused"))

        refuse = to(None, refused=s["refused"] + 1)
        return (
            F.when(o["op"] == "submit", F.when(s["state"] == 0, to(PENDING)).otherwise(to(None)))
            .when(s["state"] == 0, refuse)
            .when(o["op"] == "sequence", F.when(s["state"] == PENDING, to(SEQUENCED, sequence=o["sequence"])).when((s["state"] == SEQUENCED) & (s["sequence"] == o["sequence"]), to(None)).otherwise(refuse))
            .when(o["op"] == "ship", F.when(s["state"].isin(SEQUENCED, MANUAL) & s["sequence"].isNotNull(), to(SHIPPED)).otherwise(refuse))
            .when(o["op"] == "manual", F.when(s["state"] == SHIPPED, refuse).otherwise(to(MANUAL)))
            .when(o["op"] == "retry", F.when(s["state"].isin(PENDING, SEQUENCED), to(None, attempts=s["attempts"] + 1)).otherwise(refuse))
            .otherwise(refuse)
        )

    return ops.select(key, F.aggregate("ops", zero, step).alias("s")).select(key, "s.*")


def classified_failures(failures: DataFrame, most: int = 10) -> DataFrame:
    """(hash, attempts, action): retried below the most attempts, then handed to a person."""
    return failures.select("hash", "attempts", F.when(F.col("attempts") >= most, "manual").otherwise("retry").alias("action"))


def tombstones(entries: DataFrame, system_did: str) -> DataFrame:
    """Entries whose dispatch failed, as rows of status 1 in the system's name; others as they are."""
    failed = F.col("dispatch_error").isNotNull()
    return entries.withColumns({"status": F.when(failed, 1).otherwise(F.col("status")).cast("int"), "signer_did": F.when(failed, F.lit(system_did)).otherwise(F.col("signer_did"))}).drop("dispatch_error")


def cursor_commit(seqs: DataFrame, pending) -> DataFrame:
    """The cursor after a batch: the pending advance if there is one, else the batch's highest sequence."""
    return seqs.agg(F.coalesce(F.lit(pending).cast("long"), F.max("sequence_number")).alias("cursor"))


def paths(entries: DataFrame) -> DataFrame:
    """Adds path to entries (sequence_number, signer_did, authority, target_seq, foreign, delegation_seq, scope_seq):
    new_leaf, commentary, path_a (own leaf), path_b (by delegation), path_c (by scope), path_d (no effect).

    A delegation is dead once another entry of path A has moved its leaf; a scope's members are those of the scope entry
    itself or its last amendment before. Both are as-of conditions on the sequence, found by joins."""
    moved = entries.where("authority = 'same_signer' and target_seq is not null and not foreign").groupBy(F.col("target_seq").alias("delegation_seq")).agg(F.min("sequence_number").alias("_moved"))
    amends = entries.where("authority_set is not null").select(F.coalesce(F.when(F.col("authority") == "scope", F.col("target_seq")), F.col("sequence_number")).alias("scope_seq"), F.col("sequence_number").alias("_at"), F.col("authority_set").alias("_set"))
    uses = entries.where("authority = 'scope'").select("sequence_number", "scope_seq", "signer_did").join(amends, "scope_seq").where("_at < sequence_number")
    member = uses.groupBy("sequence_number", "signer_did").agg(F.max_by("_set", "_at").alias("_set")).select("sequence_number", F.array_contains("_set", F.col("signer_did")).alias("_member"))
    rows = entries.join(moved, "delegation_seq", "left").join(member, "sequence_number", "left")
    live = F.col("delegation_seq").isNotNull() & (F.col("delegation_seq") < F.col("sequence_number")) & (F.col("_moved").isNull() | (F.col("_moved") > F.col("sequence_number")))
    target = F.col("target_seq").isNotNull()
    path = (
        F.when(F.col("authority").isNull() & ~target, "commentary").when(F.col("foreign"), "path_d")
        .when(F.col("authority") == "same_signer", F.when(target, "path_a").otherwise("new_leaf"))
        .when((F.col("authority") == "delegation") & target, F.when(live, "path_b").otherwise("path_d"))
        .when((F.col("authority") == "scope") & target, F.when(F.coalesce("_member", F.lit(False)), "path_c").otherwise("path_d"))
        .otherwise("path_d")
    )
    return rows.withColumn("path", path).drop("_moved", "_member")


def leaf_writes(entries: DataFrame) -> DataFrame:
    """(sequence_number, leaf_seq, origin_tip, authority_tip): the writes of tips that entries of `paths` make, null where
    a tip stays.

    Paths A and B move the target's origin tip (an intermediate target's too); path C moves its authority tip, but an
    amendment of the scope itself its origin tip."""
    seq = F.col("sequence_number")
    amendment = (F.col("path") == "path_c") & (F.col("target_seq") == F.col("scope_seq")) & F.col("authority_set").isNotNull()
    write = lambda leaf, origin, authority: F.struct(leaf.alias("leaf_seq"), origin.alias("origin_tip"), authority.alias("authority_tip"))
    none = F.lit(None).cast("long")
    writes = (
        F.when(F.col("path") == "new_leaf", F.array(write(seq, seq, seq)))
        .when(F.col("path").isin("path_a", "path_b") | amendment, F.array(write(F.col("target_seq"), seq, none), write(F.col("intermediate_seq"), seq, none)))
        .when(F.col("path") == "path_c", F.array(write(F.col("target_seq"), none, seq)))
    )
    return entries.select("sequence_number", F.inline(writes)).where("leaf_seq is not null")


def fold_leaves(entries: DataFrame) -> DataFrame:
    """(leaf_seq, origin_tip, authority_tip) after all entries of `paths`. Sequences only rise, so the last write of a tip
    is its maximum: the ordered fold is a grouped maximum, whatever batches the entries come in."""
    leaves = leaf_writes(entries).groupBy("leaf_seq").agg(F.max("origin_tip").alias("origin_tip"), F.max("authority_tip").alias("authority_tip"))
    return leaves.where("authority_tip is not null")


def commitments(writes: DataFrame, width: int) -> DataFrame:
    """(id, range_start_seq, range_end_seq, mutations_json, prior_root, post_root) of every batch of `width` sequences that
    moves a leaf, of writes as `leaf_writes` gives. Roots are those of the state tree over all leaves after the batch,
    and after the batch before; see `merkle.versioned_roots`. A leaf without an authority tip is none yet."""
    from .merkle import EMPTY, versioned_roots
    from .windows import carried

    rows = writes.withColumn("id", F.expr(f"sequence_number div {width}"))
    per = rows.groupBy("id", "leaf_seq").agg(F.max("origin_tip").alias("o"), F.max("authority_tip").alias("a"))
    over = Window.partitionBy("leaf_seq").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = per.select("id", "leaf_seq", F.max("o").over(over).alias("origin_tip"), F.max("a").over(over).alias("authority_tip")).where("authority_tip is not null")
    leaf = F.concat_ws("|", "leaf_seq", F.coalesce("origin_tip", F.lit(-1)), "authority_tip")
    roots = versioned_roots(now.select(F.col("leaf_seq").alias("index"), F.col("id").alias("version"), F.sha2(leaf, 256).alias("hash")))
    listed = now.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("leaf_seq", "origin_tip", "authority_tip")))).alias("mutations_json"))
    ends = rows.groupBy("id").agg(F.min("sequence_number").alias("range_start_seq"), F.max("sequence_number").alias("range_end_seq"))
    out = ends.join(listed, "id").join(roots.select(F.col("version").alias("id"), F.col("root").alias("post_root")), "id")
    out = carried(out.withColumn("prior_root", F.col("post_root")), [], "id", ["prior_root"], inclusive=False)
    return out.withColumn("prior_root", F.coalesce("prior_root", F.lit(EMPTY)))


def cosign_age(heads: DataFrame, now) -> DataFrame:
    return heads.agg((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.max("created_at").cast("timestamp"))).alias("seconds"))


def redriven(journal: DataFrame, now_ns, age_ns: int, most: int = 10) -> DataFrame:
    """(hash, op, attempts) for rows that have been pending for longer than `age_ns`: submitted to the sequencer again
    with one attempt more, or handed to a person once there have been `most`."""
    stale = journal.where((F.col("state") == PENDING) & (F.lit(now_ns) - F.col("last_err_ns") > age_ns))
    again = F.col("attempts") + 1
    return stale.select("hash", F.when(again >= most, "manual").otherwise("sequence").alias("op"), again.cast("int").alias("attempts"))


def replayed(rows: DataFrame, mark: int, fails, limit: int = 1000) -> DataFrame:
    """Of rows after the mark, the next `limit` in order up to the first that fails, each with mark: where the next replay
    begins. The failing row and all after it wait."""
    batch = rows.where(F.col("sequence_number") > mark).orderBy("sequence_number").limit(limit).withColumn("_fails", fails)
    stop = batch.agg(F.min(F.when(F.col("_fails"), F.col("sequence_number"))).alias("_stop"))
    done = batch.join(F.broadcast(stop)).where("_stop is null or sequence_number < _stop").drop("_fails", "_stop")
    return done.join(F.broadcast(done.agg(F.max("sequence_number").alias("mark"))))
