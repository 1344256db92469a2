"""Prefixes, gaps, chains, classes (survey W, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as w
from . import fixtures as fx
from .registry import query

_PREFIX = "SELECT sequence_number - row_number() OVER (ORDER BY sequence_number) AS shift, * FROM {} WHERE sequence_number > {}"


@query("SELECT sequence_number, canonical_hash FROM (" + _PREFIX.format("f_holed", 20) + ") WHERE shift = 20")
def contiguous_prefix(spark, d):
    return w.contiguous_prefix(fx.holed(spark, d), 20, width=16).select("sequence_number", "canonical_hash")


@query("WITH p AS (SELECT * FROM (" + _PREFIX.format("f_holed", 114) + ") WHERE shift = 114) SELECT sequence_number, max(sequence_number) OVER () AS advance_to FROM (SELECT sequence_number, status, max(sequence_number) OVER () AS m FROM p) q WHERE false UNION ALL SELECT p.sequence_number, m.m FROM p, (SELECT max(sequence_number) AS m FROM p) m WHERE status = 0")
def live_prefix(spark, d):
    return w.live_prefix(fx.holed(spark, d), 114, width=64).select("sequence_number", "advance_to")


@query("SELECT coalesce(max(sequence), 0) AS last FROM (SELECT sequence, sequence - row_number() OVER (ORDER BY sequence) AS shift FROM f_journal WHERE state = 3 AND sequence > 19) WHERE shift = 19")
def shipped_hwm(spark, d):
    return w.shipped_mark(fx.journal(spark, d), 19).select(F.when(F.col("last") > 19, F.col("last")).otherwise(0).alias("last"))


@query("SELECT sequence_number FROM (" + _PREFIX.format("f_holed", 13) + ") WHERE shift = 13")
def heap_drain(spark, d):
    h = fx.holed(spark, d).select("sequence_number")
    return w.drained(h.unionByName(h.where("sequence_number % 5 = 0")), 14, width=32)


@query("SELECT p + 1 AS gap_start, sequence_number - 1 AS gap_end FROM (SELECT sequence_number, lag(sequence_number) OVER (ORDER BY sequence_number) AS p FROM f_holed) WHERE sequence_number > p + 1")
def gap_ranges(spark, d):
    return w.gap_ranges(fx.holed(spark, d), width=50)


_BROKEN = "SELECT originator, CASE WHEN originator = 'did:conv:7' AND lamport = 2 THEN 1 ELSE lamport END AS lamport, event_id, CASE WHEN originator = 'did:conv:5' AND lamport = 2 THEN 'x' ELSE prev_hash END AS prev_hash FROM f_gossip"


@query(f"""SELECT originator, lamport, CASE WHEN lamport <= coalesce(c, 0) THEN 'clock' WHEN prev_hash <> coalesce(i, '{fx.ZERO}') THEN 'link' END AS verdict
FROM (SELECT *, lag(event_id) OVER v AS i, lag(lamport) OVER v AS c FROM ({_BROKEN}) WINDOW v AS (PARTITION BY originator ORDER BY lamport, event_id)) WHERE lamport <= coalesce(c, 0) OR prev_hash <> coalesce(i, '{fx.ZERO}')""")
def chain_check(spark, d):
    at = (F.col("originator") == "did:conv:7") & (F.col("lamport") == 2)
    g = fx.gossip(spark, d).withColumn("prev_hash", F.when((F.col("originator") == "did:conv:5") & (F.col("lamport") == 2), "x").otherwise(F.col("prev_hash")))
    return w.chain_check(g.withColumn("lamport", F.when(at, 1).otherwise(F.col("lamport")).cast("long")))


@query("""SELECT sequence_number, canonical_hash, CASE WHEN sequence_number = min(sequence_number) OVER (PARTITION BY canonical_hash) THEN 'primary' ELSE 'ghost' END AS class FROM f_documents
UNION ALL SELECT sequence_number, canonical_hash, 'replay' FROM f_documents WHERE sequence_number % 20 = 3""")
def ghost_classify(spark, d):
    docs = fx.documents(spark, d).select("sequence_number", "canonical_hash")
    return w.ghost_classify(docs.unionByName(docs.where("sequence_number % 20 = 3")))


@query("""SELECT schema_id, split_id, a AS seq_a, b AS seq_b FROM (SELECT schema_id, split_id, sequence_number AS a, lead(sequence_number) OVER v AS b, signer_did AS s, lead(signer_did) OVER v AS t, row_number() OVER v AS r
FROM f_splits WINDOW v AS (PARTITION BY schema_id, split_id ORDER BY sequence_number)) WHERE r = 1 AND s = t""")
def equivocation_pairs(spark, d):
    return w.equivocation_pairs(fx.splits(spark, d))


@query("SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS history FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10) GROUP BY 1")
def tip_history(spark, d):
    h = w.tip_history(fx.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")
    return h.select("user_id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("""SELECT log_did, batch_id FROM (SELECT *, lag(first_seq) OVER v AS f1, lag(first_seq, 2) OVER v AS f2, lag(error) OVER v AS e1, lag(error, 2) OVER v AS e2 FROM (SELECT 'did:log:' || (event_id % 4) AS log_did, event_id AS batch_id, event_id // 20 AS first_seq,
CASE WHEN event_id // 20 % 3 = 1 THEN 'e' END AS error FROM events) WINDOW v AS (PARTITION BY log_did ORDER BY batch_id)) WHERE error IS NOT NULL AND first_seq = f1 AND first_seq = f2 AND error = e1 AND error = e2""")
def identical_batch_breaker(spark, d):
    i = F.col("event_id")
    b = fx.table(spark, d, "events").select(F.concat(F.lit("did:log:"), (i % 4).cast("string")).alias("log_did"), i.alias("batch_id"), F.expr("event_id div 20").alias("first_seq"), F.when(F.expr("event_id div 20") % 3 == 1, "e").alias("error"))
    return w.failing_streaks(b)


@query("""WITH old AS (SELECT canonical_hash, count(*) OVER () AS n FROM f_documents WHERE status = 0 AND sequence_number % 2 = 0), new AS (SELECT canonical_hash, min(sequence_number) AS o FROM f_documents GROUP BY 1)
SELECT (SELECT count(*) FROM old) + row_number() OVER (ORDER BY o) - 1 AS index, canonical_hash FROM new WHERE canonical_hash NOT IN (SELECT canonical_hash FROM old)""")
def append_leaf(spark, d):
    docs = fx.documents(spark, d)
    return w.appended(docs.where("status = 0 and sequence_number % 2 = 0"), docs.select("canonical_hash", F.col("sequence_number").alias("ord")))


@query("""SELECT p.originator, p.lamport, p.event_id, CASE WHEN p.lamport = coalesce(m, 0) + 1 THEN true WHEN p.lamport > coalesce(m, 0) + 1 THEN true END AS continues FROM f_gossip p
LEFT JOIN (SELECT originator AS o, max(lamport) AS m FROM f_gossip WHERE lamport <= 2 AND originator < 'did:conv:5' GROUP BY 1) ON o = p.originator WHERE p.lamport > coalesce(m, 0) AND p.lamport <= coalesce(m, 0) + 3""")
def anti_entropy(spark, d):
    g = fx.gossip(spark, d)
    return w.pulled(g.where("lamport <= 2 and originator < 'did:conv:5'"), g, 3)
