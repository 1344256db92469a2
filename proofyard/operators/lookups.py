"""Point lookups, filters and ordered scans. Every scan is a filter that reaches the file reader, then an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import GHOST, LIVE, MANUAL, PENDING, SEQUENCED, SHIPPED

HEADER = ("sequence_number", "log_time", "canonical_hash")


def by_column(entries: DataFrame, column: str, value, live_only: bool = False, newest_first: bool = False) -> DataFrame:
    """Headers of entries whose column equals a value, by sequence; null and empty values match nothing."""
    if value is None or value == "":
        return entries.where("false").select(*HEADER)
    found = entries.where(F.col(column) == value)
    if live_only:
        found = found.where(F.col("status") == LIVE)
    return found.select(*HEADER).orderBy(F.desc("sequence_number") if newest_first else F.asc("sequence_number"))


def scan_from(entries: DataFrame, start: int, count: int, default: int = 100, cap: int = 10_000) -> DataFrame:
    """At most `count` headers from a sequence on; a count of 0 or less means the default."""
    n = min(cap, count if count > 0 else default)
    return entries.where(F.col("sequence_number") >= start).select(*HEADER).orderBy("sequence_number").limit(n)


def in_range(entries: DataFrame, first: int, last: int, cap: int = 1000) -> DataFrame:
    """Headers of a closed range; a span above `cap` is refused."""
    if last < first or last - first + 1 > cap:
        raise ValueError(f"the range {first}..{last} is empty or spans over {cap}")
    return entries.where(F.col("sequence_number").between(first, last)).select(*HEADER).orderBy("sequence_number")


def by_sequence(entries: DataFrame, sequence: int, log_did: str, local_did: str) -> DataFrame:
    """The entry at a position; nothing for another log."""
    return entries.where(F.col("sequence_number") == sequence).where(F.lit(log_did == local_did))


def hash_by_seq(entries: DataFrame, sequences: DataFrame) -> DataFrame:
    """(sequence_number, canonical_hash, log_time, is_ghost, found) for every asked sequence."""
    found = entries.select("sequence_number", "canonical_hash", "log_time", "status")
    return sequences.join(found, "sequence_number", "left").select(
        "sequence_number", "canonical_hash", "log_time", F.coalesce(F.col("status") == GHOST, F.lit(False)).alias("is_ghost"), F.col("status").isNotNull().alias("found"))


def primary_by_hash(entries: DataFrame) -> DataFrame:
    """(canonical_hash, sequence_number) of the entries that are no ghosts."""
    return entries.where(F.col("status") != GHOST).select("canonical_hash", "sequence_number")


def seq_by_hash(entries: DataFrame) -> DataFrame:
    """(canonical_hash, sequence_number): the primary where there is one, else the first of any status."""
    return entries.groupBy("canonical_hash").agg(F.min_by("sequence_number", F.struct(F.col("status") == GHOST, "sequence_number")).alias("sequence_number"))


def latest_per(entries: DataFrame, key: str, live_only: bool = True) -> DataFrame:
    """The newest entry of every key (delegate, signer): a grouped maximum, combined before the shuffle."""
    rows = entries.where(F.col(key).isNotNull())
    rows = rows.where(F.col("status") == LIVE) if live_only else rows
    return rows.groupBy(key).agg(F.max("sequence_number").alias("sequence_number"), F.max_by("canonical_hash", "sequence_number").alias("canonical_hash"), F.count("*").alias("entries"))


def cosignatures_live(entries: DataFrame, position: str) -> DataFrame:
    return by_column(entries, "cosignature_of", position, live_only=True)


def hash_lookup_state(wal: DataFrame, entries: DataFrame) -> DataFrame:
    """(hash, answer) for every hash known to either side: found, pending, manual, missing, or broken where the journal
    says sequenced or shipped but the index has no row."""
    index = primary_by_hash(entries).select(F.col("canonical_hash").alias("hash"), "sequence_number")
    both = wal.select("hash", "state").join(index, "hash", "full_outer")
    answer = (
        F.when(F.col("sequence_number").isNotNull(), "found").when(F.col("state") == PENDING, "pending").when(F.col("state") == MANUAL, "manual")
        .when(F.col("state").isin(SEQUENCED, SHIPPED), "broken").otherwise("missing")
    )
    return both.select("hash", "sequence_number", answer.alias("answer"))


def raw_entry_route(entries: DataFrame, wal: DataFrame) -> DataFrame:
    """(sequence_number, route, target): ghosts redirect to their primary, entries still in the journal are served
    inline, the rest redirect to the object store."""
    primary = primary_by_hash(entries).withColumnRenamed("sequence_number", "primary_seq")
    rows = entries.select("sequence_number", "canonical_hash", "status").join(primary, "canonical_hash", "left").join(wal.select(F.col("hash").alias("canonical_hash"), "state"), "canonical_hash", "left")
    ghost, inline = F.col("status") == GHOST, F.col("state").isin(PENDING, SEQUENCED, MANUAL)
    return rows.select(
        "sequence_number", F.when(ghost, "primary").when(inline, "inline").otherwise("store").alias("route"), F.when(ghost, F.col("primary_seq")).otherwise(F.col("sequence_number")).alias("target"))


def keyed_batch(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows for asked keys (ord, key) in the order asked, with an exists flag."""
    return keys.join(table.withColumn("_there", F.lit(True)), key, "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there").orderBy("ord")


def newest(table: DataFrame, order: list[Column], n: int) -> DataFrame:
    return table.orderBy(*order).limit(n)


def session_lookup(sessions: DataFrame, tokens: DataFrame, now) -> DataFrame:
    """(token, exchange_did, answer): authenticated, expired or unknown."""
    rows = tokens.join(sessions, "token", "left")
    answer = F.when(F.col("exchange_did").isNull(), "unknown").when(F.col("expires_at") > now, "authenticated").otherwise("expired")
    return rows.select("token", F.when(answer == "authenticated", F.col("exchange_did")).alias("exchange_did"), answer.alias("answer"))


def balance(credits: DataFrame, dids: DataFrame) -> DataFrame:
    """Balance of every asked exchange, 0 for unknown ones."""
    return dids.join(credits.select("exchange_did", "balance"), "exchange_did", "left").select("exchange_did", F.coalesce("balance", F.lit(0)).cast("long").alias("balance"))


def cursor_next(entries: DataFrame, cursor: int, n: int) -> DataFrame:
    return entries.where(F.col("sequence_number") > cursor).select("sequence_number", "status").orderBy("sequence_number").limit(n)


def split_lookup(splits: DataFrame, schema_id: str, split_id: str) -> DataFrame:
    return splits.where((F.col("schema_id") == schema_id) & (F.col("split_id") == split_id)).select("sequence_number").orderBy("sequence_number")


def commitment_lookup(splits: DataFrame, asked: DataFrame, schemas: list[str]) -> DataFrame:
    """(schema_id, split_id, n, answer) for every asked pair: refused for an unknown schema or an id that is not 64 hex
    digits, else missing, ok, or equivocation where two or more entries share it."""
    counts = splits.groupBy("schema_id", "split_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    valid = F.col("schema_id").isin(schemas) & F.col("split_id").rlike("^[0-9a-f]{64}$")
    answer = F.when(~valid, "refused").when(n == 0, "missing").when(n == 1, "ok").otherwise("equivocation")
    return asked.join(counts, ["schema_id", "split_id"], "left").select("schema_id", "split_id", n.cast("long").alias("n"), answer.alias("answer"))


def iterate_sequenced(wal: DataFrame, start: int) -> DataFrame:
    """Sequenced rows after a sequence, in order; a start of 0 takes 0 too."""
    after = F.col("sequence") >= 0 if start == 0 else F.col("sequence") > start
    return wal.where(after & (F.col("state") == SEQUENCED)).select("sequence", "hash").orderBy("sequence")


def iterate_inflight(wal: DataFrame) -> DataFrame:
    return wal.where(F.col("state") == PENDING).select("hash", "attempts").orderBy("hash")


def gossip_heads(events: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(originator, event_id, lamport) of each chain's end; asked originators without events get zeros."""
    heads = events.groupBy("originator").agg(F.max_by("event_id", "lamport").alias("event_id"), F.max("lamport").alias("lamport"))
    if asked is None:
        return heads
    return asked.join(heads, "originator", "left").select("originator", F.coalesce("event_id", F.lit("0" * 64)).alias("event_id"), F.coalesce("lamport", F.lit(0)).cast("long").alias("lamport"))


def gossip_iterate(events: DataFrame, originator: str | None = None, kind: str | None = None) -> DataFrame:
    """Events in chain order, of one originator, of one kind, or all."""
    if originator is not None:
        events = events.where(F.col("originator") == originator)
    if kind is not None:
        events = events.where(F.col("kind") == kind)
    return events.orderBy("originator", "lamport")


def gossip_since(events: DataFrame, originator: str, lamport: int, limit: int) -> DataFrame:
    """The next page after (originator, lamport), in that order: the cursor is of both, so no chain is skipped."""
    after = (F.col("originator") > originator) | ((F.col("originator") == originator) & (F.col("lamport") > lamport))
    return events.where(after).orderBy("originator", "lamport").limit(limit)


def gossip_by_binding(events: DataFrame, binding: str, kind: str | None = None, since: int = 0) -> DataFrame:
    """Events that bind a value, by event id."""
    found = events.where(F.array_contains("bindings", binding) & (F.col("lamport") > since))
    return (found.where(F.col("kind") == kind) if kind else found).orderBy("event_id")


def latest_of_kind(events: DataFrame, kind: str) -> DataFrame:
    """The last event of a kind of every originator."""
    return gossip_heads(events.where(F.col("kind") == kind))


def present_count(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """How many entries have one of the given hashes."""
    return entries.join(hashes.select("canonical_hash").distinct(), "canonical_hash", "left_semi").agg(F.count("*").alias("present"))


def decoded_deltas(buffers: DataFrame, decode) -> DataFrame:
    """Tip histories of rows with a 32-byte key and a history that decodes; others are left out."""
    return buffers.where(F.octet_length("leaf_key") == 32).withColumn("tips", decode(F.col("tip_history"))).where("tips is not null").drop("tip_history")
