"""Order-sensitive operators over sequences: prefixes, gaps, chains, top rows.

None puts a whole log into one window. Sequences are dealt into buckets of `width`; whole buckets are judged by their
counts, neighbours meet through one row a bucket, and only rows inside a bucket share a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..saving import saved
from ..schemas import GHOST, LIVE

WIDTH = 65_536


def _bucket(seq: str, width: int) -> Column:
    return F.expr(f"{seq} div {width}")


def with_previous(rows: DataFrame, seq: str, width: int = WIDTH) -> DataFrame:
    """Adds prev: the next lower sequence of the table, null for the lowest."""
    rows = rows.withColumn("_b", _bucket(seq, width))
    last = rows.groupBy("_b").agg(F.max(seq).alias("_last")).select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_before"))
    inside = F.lag(seq).over(Window.partitionBy("_b").orderBy(seq))
    return rows.withColumn("prev", inside).join(last, "_b").withColumn("prev", F.coalesce("prev", "_before")).drop("_b", "_before")


def carried(rows: DataFrame, keys: list[str], order: str | list[str], columns: list[str], inclusive: bool = True, width: int = 4096) -> DataFrame:
    """`rows` with null `columns` filled from the last row before that has them, in an order that begins with whole
    numbers; if not `inclusive`, all of them so. Buckets of `width` numbers share a window, and one row a bucket carries
    over."""
    order = [order] if isinstance(order, str) else order
    rows = rows.withColumn("_b", F.expr(f"{order[0]} div {width}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = rows.groupBy(*keys, "_b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}") for c in columns])
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_b", *[F.last(f"_{c}", ignorenulls=True).over(over).alias(f"_{c}") for c in columns])
    out = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).join(before, [*keys, "_b"])
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_b", *[f"_{c}" for c in columns])


def delegation_asof(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """(ord, did, at, sequence_number) of lookups (ord, did, at): the latest live delegation to the DID before sequence
    `at`, null where there is none; a later delegation counts from its own sequence on, so nothing is to be invalidated."""
    given = entries.where("delegate_did is not null and status = 0").select(F.col("delegate_did").alias("did"), F.col("sequence_number").alias("at"), F.col("sequence_number").alias("found"), F.lit(None).cast("long").alias("ord"))
    asked = lookups.select("did", "at", F.lit(None).cast("long").alias("found"), "ord")
    # a delegation counts for what is after it: lookups come first at a sequence
    both = given.withColumn("at", F.col("at") * 2 + 1).unionByName(asked.withColumn("at", F.col("at") * 2))
    both = both.groupBy("did", "at").agg(F.max("found").alias("found"), F.collect_list("ord").alias("ords"))
    filled = carried(both, ["did"], "at", ["found"])
    return filled.select(F.explode("ords").alias("ord"), "did", F.expr("at div 2").alias("at"), F.col("found").alias("sequence_number"))


def prefix_end(rows: DataFrame, cursor: int, seq: str = "sequence_number", width: int = WIDTH) -> DataFrame:
    """One row, last: the highest s such that all of cursor + 1 .. s are there; the cursor itself if there is none."""
    ahead = rows.where(F.col(seq) > cursor).select(seq).distinct()
    first = (cursor + 1) // width
    full = ahead.groupBy(_bucket(seq, width).alias("b")).agg(F.count("*").alias("n"), F.max(seq).alias("hi"))
    needed = F.when(F.col("b") == first, F.lit((first + 1) * width - (cursor + 1))).otherwise(width)
    ranked = full.withColumn("ok", (F.col("b") == F.lit(first) + F.row_number().over(Window.orderBy("b")) - 1) & (F.col("n") == needed))
    stop = ranked.agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("b"))), F.max("b") + 1, F.lit(first)).alias("b"))
    # the first bucket in order that is not full, or that comes after a missing one
    reach = ranked.join(F.broadcast(stop.withColumnRenamed("b", "stop"))).where("b < stop").agg(F.max("b").alias("done"), F.coalesce(F.max("hi"), F.lit(cursor)).alias("base"))
    edge = ahead.join(F.broadcast(reach)).where(f"{seq} > base and {seq} <= base + {width}")
    inside = edge.withColumn("k", F.row_number().over(Window.orderBy(seq))).where(f"{seq} = base + k")
    return inside.agg(F.max(seq).alias("hi")).join(F.broadcast(reach)).select(F.coalesce("hi", "base").alias("last"))


def prefix_ends(rows: DataFrame, key: str, first: str, seq: str = "sequence_number", width: int = WIDTH) -> DataFrame:
    """(key, next, again), one row a key: the lowest sequence that is not there from `first` on, a column that is the same in
    all rows of a key, and how many rows from there on repeat a sequence. Whole buckets are judged by their counts; of each
    key only the bucket after these has its rows in a window."""
    rows = rows.where(F.col(seq) >= F.col(first)).select(key, F.col(first).alias("_f"), F.col(seq).alias("_s"))
    ahead = rows.groupBy(key, "_f", "_s").agg(F.count("*").alias("_c"))
    full = ahead.groupBy(key, "_f", _bucket("_s", width).alias("_b")).agg(F.count("*").alias("_n"), F.sum("_c").alias("_c"))
    by = Window.partitionBy(key).orderBy("_b")
    nth = F.expr(f"_f div {width}") + F.row_number().over(by) - 1
    ok = (F.col("_b") == nth) & (F.col("_n") == (F.col("_b") + 1) * width - F.greatest(F.col("_b") * width, F.col("_f")))
    whole = full.withColumn("_ok", ok).withColumn("_ok", F.min("_ok").over(by))
    end = F.coalesce(F.max(F.when(F.col("_ok"), (F.col("_b") + 1) * width)), F.col("_f"))
    base = saved(whole.groupBy(key, "_f").agg(end.alias("next"), F.sum(F.col("_c") - F.col("_n")).alias("again")).drop("_f"))
    edge = rows.join(base.select(F.col(key).alias("_key"), "next"), F.col(key).eqNullSafe(F.col("_key"))).where(f"_s >= next and _s < next + {width}")
    inside = edge.select(key, "next", "_s").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_s")) - 1)
    reach = inside.where("_s = next + _k").select(key, (F.col("_s") + 1).alias("next"), F.lit(0).cast("long").alias("again"))
    return base.unionByName(reach).groupBy(key).agg(F.max("next").alias("next"), F.max("again").alias("again"))


def contiguous_prefix(rows: DataFrame, cursor: int, seq: str = "sequence_number", width: int = WIDTH) -> DataFrame:
    """Rows from cursor + 1 up to the first gap; none if that is missing."""
    end = prefix_end(rows, cursor, seq, width)
    return rows.where(F.col(seq) > cursor).join(F.broadcast(end)).where(f"{seq} <= last").drop("last")


def live_prefix(entries: DataFrame, cursor: int, width: int = WIDTH) -> DataFrame:
    """The live rows of the prefix, each with advance_to: its last sequence of any status."""
    end = prefix_end(entries, cursor, width=width)
    return entries.where((F.col("sequence_number") > cursor) & (F.col("status") == LIVE)).join(F.broadcast(end)).where("sequence_number <= last").withColumnRenamed("last", "advance_to")


def gap_ranges(rows: DataFrame, seq: str = "sequence_number", width: int = WIDTH) -> DataFrame:
    """(gap_start, gap_end) of missing sequences between those that are there."""
    gaps = with_previous(rows.select(seq).distinct(), seq, width).where(F.col(seq) > F.col("prev") + 1)
    return gaps.select((F.col("prev") + 1).alias("gap_start"), (F.col(seq) - 1).alias("gap_end"))


def chain_check(events: DataFrame) -> DataFrame:
    """(originator, lamport, verdict) of events that break their chain: a previous hash that is not the event before (64
    zeros for the first), or a clock that does not rise from above 0."""
    rows = carried(events.withColumns({"_id": F.col("event_id"), "_clock": F.col("lamport")}), ["originator"], ["lamport", "event_id"], ["_id", "_clock"], inclusive=False)
    link = F.col("prev_hash") == F.coalesce("_id", F.lit("0" * 64))
    clock = F.col("lamport") > F.coalesce("_clock", F.lit(0))
    return rows.select("originator", "lamport", F.when(~clock, "clock").when(~F.coalesce(link, F.lit(False)), "link").alias("verdict")).where("verdict is not null")


def chained(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Events (originator, ord, kind, body) as rows to append to their chains, after `heads` (originator, event_id,
    lamport): with lamport, event_id (hash of what the row says) and prev_hash (the id before; 64 zeros for the first)."""
    rows = events.join(heads.select("originator", F.col("event_id").alias("_head"), F.col("lamport").alias("_clock")), "originator", "left")
    nth = F.row_number().over(Window.partitionBy("originator").orderBy("ord"))
    rows = rows.withColumn("lamport", (F.coalesce("_clock", F.lit(0)) + nth).cast("long"))
    rows = rows.withColumn("event_id", F.sha2(F.concat_ws("|", "originator", F.col("lamport").cast("string"), "kind", "body"), 256))
    rows = carried(rows.withColumn("prev_hash", F.col("event_id")), ["originator"], "lamport", ["prev_hash"], inclusive=False)
    return rows.withColumn("prev_hash", F.coalesce("prev_hash", "_head", F.lit("0" * 64))).drop("_head", "_clock")


def ghost_classify(rows: DataFrame) -> DataFrame:
    """(sequence_number, canonical_hash, class): of the rows of one hash the lowest sequence is primary, later ones are
    ghosts; a repeated (sequence, hash) is a replay and is reported once more as such. The lowest of a hash is a grouped
    minimum joined back, so that one hash with many rows is no single window."""
    seen = rows.groupBy("sequence_number", "canonical_hash").agg(F.count("*").alias("times"))
    first = seen.groupBy("canonical_hash").agg(F.min("sequence_number").alias("first"))
    kind = F.when(F.col("sequence_number") == F.col("first"), "primary").otherwise("ghost")
    kinds = seen.join(first, "canonical_hash").select("sequence_number", "canonical_hash", F.explode(F.concat(F.array(kind), F.array_repeat(F.lit("replay"), (F.col("times") - 1).cast("int")))).alias("class"))
    return kinds


def equivocation_pairs(splits: DataFrame) -> DataFrame:
    """(schema_id, split_id, seq_a, seq_b) of the two earliest entries of a key, where one signer made both. The two
    earliest come from a minimum and the minimum above it."""
    key = ["schema_id", "split_id"]
    first = splits.groupBy(*key).agg(F.min(F.struct("sequence_number", "signer_did")).alias("a"))
    rest = splits.join(first, key).where(F.col("sequence_number") > F.col("a.sequence_number"))
    second = rest.groupBy(*key, "a").agg(F.min(F.struct("sequence_number", "signer_did")).alias("b"))
    return second.where("a.signer_did = b.signer_did").select(*key, F.col("a.sequence_number").alias("seq_a"), F.col("b.sequence_number").alias("seq_b"))


def tip_history(tips: DataFrame, key: str, seq: str, n: int = 10) -> DataFrame:
    """(key, history): the last n sequences of every key, oldest first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    last = tips.withColumn("_r", rank).where(F.col("_r") <= n)
    return last.groupBy(key).agg(F.array_sort(F.collect_list(seq)).alias("history"))


def latest_head(heads: DataFrame) -> DataFrame:
    return heads.orderBy(F.desc("tree_size"), F.desc("hash_algo")).limit(1)


def head_by_size(heads: DataFrame, size: int) -> DataFrame:
    return heads.where(F.col("tree_size") == size).orderBy("hash_algo").limit(1)


def failing_streaks(batches: DataFrame, limit: int = 3) -> DataFrame:
    """(log_did, batch_id) where the same first sequence failed with the same error `limit` times in a row."""
    w = Window.partitionBy("log_did").orderBy("batch_id")
    same = [(F.lag("first_seq", i).over(w) == F.col("first_seq")) & (F.lag("error", i).over(w) == F.col("error")) for i in range(1, limit)]
    hit = F.col("error").isNotNull()
    for s in same:
        hit = hit & F.coalesce(s, F.lit(False))
    return batches.withColumn("_hit", hit).where("_hit").select("log_did", "batch_id")


def shipped_mark(wal: DataFrame, mark: int, width: int = WIDTH) -> DataFrame:
    """The highest s such that all of mark + 1 .. s are shipped."""
    return prefix_end(wal.where("state = 3"), mark, "sequence", width)


def drained(heap: DataFrame, next_expected: int, width: int = WIDTH) -> DataFrame:
    """What a reorder buffer gives out: rows from next_expected up to the first gap, repeated ones once."""
    return contiguous_prefix(heap.dropDuplicates(["sequence_number"]), next_expected - 1, width=width)


def is_ghost() -> Column:
    return F.col("status") == GHOST


def ranked(rows: DataFrame, order: str, base: int = 0) -> DataFrame:
    """Adds place: base plus the rank by a column without ties. Rows are dealt by ranges of the order, ranges are counted,
    and only rows inside one share a window."""
    rows = rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()).persist()
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return rows.withColumn("_k", inside).join(F.broadcast(counts), "_p").withColumn("place", F.col("_before") + F.col("_k") + base).drop("_p", "_k", "_before")


def appended(tree: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """(index, canonical_hash) of the leaves that new rows add to a dense tree: each hash once, in order of its first
    row, after those that are there; a hash that is there already adds nothing."""
    first = new.groupBy("canonical_hash").agg(F.min(order).alias(order)).join(tree.select("canonical_hash"), "canonical_hash", "left_anti")
    size = tree.agg(F.count("*").alias("_size"))
    return ranked(first, order).join(F.broadcast(size)).select((F.col("place") + F.col("_size")).alias("index"), "canonical_hash")


def pulled(local: DataFrame, peer: DataFrame, limit: int) -> DataFrame:
    """What an anti-entropy round takes from a peer: of each originator the next events after the local head, at most
    `limit`, with continues: whether the first of them follows that head."""
    heads = local.groupBy("originator").agg(F.max("lamport").alias("_clock"), F.max_by("event_id", "lamport").alias("_head"))
    ahead = peer.join(heads, "originator", "left").where(F.col("lamport") > F.coalesce("_clock", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("originator").orderBy("lamport"))
    rows = ahead.withColumn("_k", nth).where(F.col("_k") <= limit)
    follows = F.when(F.col("_k") == 1, F.col("prev_hash") == F.coalesce("_head", F.lit("0" * 64))).otherwise(True)
    return rows.select("originator", "lamport", "event_id", follows.alias("continues"))
