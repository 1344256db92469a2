"""Admission (survey G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as a
from ..operators import joins
from . import fixtures as fx
from .registry import query


QUORUM = 2


def submissions(spark, d):
    """Events as submissions, most of them faulty in one way or another; heads, chains, policies and credits come from
    the tables that hold them."""
    i = F.col("sequence_number")
    e = fx.entries(spark, d)
    verdicts = joins.cosig_binding(fx.holed(spark, d), fx.LOG).withColumnRenamed("verdict", "cosig_verdict")
    policy = a.policy_met(joins.policy_candidates(e), {"click": 1, "purchase": 2}).select("sequence_number", F.col("met").alias("policy_met"))
    chains = _chains(spark, d).select(F.col("start").alias("sequence_number"), F.col("depth").alias("chain_depth"), F.col("complete").alias("chain_complete"))
    rows = e.join(verdicts, "sequence_number", "left").join(policy, "sequence_number", "left").join(chains, "sequence_number", "left")
    rows = rows.select(
        i, F.when(i % 31 == 1, 3).otherwise(i * 1000 % 2_000_000 + 100).alias("n_bytes"), F.when(i % 37 == 2, 2).otherwise(1).alias("version"), (i % 41 != 3).alias("decodes"), (i % 29 != 5).alias("invariants"),
        (i % 43 != 4).alias("normalised"), F.when(i % 47 == 5, "did:log:other").otherwise(fx.LOG).alias("destination"), F.when(i % 53 == 6, 0).otherwise(1000 + i % 200).alias("event_time_s"), (i % 59 != 7).alias("signature_ok"),
        "cosig_verdict", F.when(i % 23 == 9, i + 1).alias("embedded_size"), "chain_depth", "chain_complete", F.when(i % 2 == 0, F.col("policy_met")).alias("policy_met"),
        F.when(i % 61 == 8, "unknown").when(i % 2 == 0, "click").alias("schema_id"), (i % 13).alias("n_pointers"), (i % 3 != 0).alias("session_ok"), F.when(i % 6 == 0, (i % 12).cast("int") + 2).alias("stamp_bits"),
        F.concat(F.lit("did:x:"), F.col("user_id").cast("string")).alias("exchange_did"))
    return a.with_heads(rows, fx.sigs(spark, d))


def _chains(spark, d):
    i = F.col("sequence_number")
    e = fx.holed(spark, d).select(i, F.when(i % 12 != 0, i - 1).alias("evidence_seq"))
    return a.evidence_chain(e, e.where("sequence_number % 7 = 2"))


def judged(spark, d, off=()):
    rows = a.judge(submissions(spark, d), a.gates(fx.LOG, F.lit(1100), ["click", "view"], off=off, quorum=QUORUM, difficulty=8))
    return a.deduct(rows, fx.credits(spark, d))


_CHAINS = """WITH RECURSIVE p AS (SELECT sequence_number AS spot, CASE WHEN sequence_number % 12 <> 0 THEN sequence_number - 1 END AS next FROM f_holed), w AS (SELECT sequence_number AS start, sequence_number AS spot, 0 AS depth FROM f_holed WHERE sequence_number % 7 = 2
UNION ALL SELECT start, p.next, depth + 1 FROM w JOIN p USING (spot) WHERE p.next IS NOT NULL AND depth < 9),
chain AS (SELECT start, CAST(least(max(depth), 9) AS INT) AS depth, CASE WHEN max(depth) = 9 THEN false ELSE arg_max(p.spot IS NOT NULL, depth) END AS complete FROM w LEFT JOIN p USING (spot) GROUP BY start)"""
_SUBMISSIONS = f"""{_CHAINS},
pol AS (SELECT e.sequence_number, count(DISTINCT c.signer_did) >= CASE t.schema_ref WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS met
FROM f_entries e JOIN f_entries t ON t.position = e.target_root LEFT JOIN f_entries c ON c.status = 0 AND c.cosignature_of = e.target_root GROUP BY e.sequence_number, t.schema_ref),
q AS (SELECT tree_size, count(DISTINCT signer) AS k FROM f_sigs GROUP BY 1),
s AS (SELECT e.sequence_number AS i, e.user_id, CASE WHEN e.sequence_number % 97 <> 13 AND starts_with(e.cosignature_of, 'did:log:main:') AND t.sequence_number % 97 = 13 THEN 'unbound' END AS v,
coalesce(q.k, 0) AS k, chain.depth AS cd, chain.complete AS cc, CASE WHEN e.sequence_number % 2 = 0 THEN pol.met END AS met
FROM f_entries e LEFT JOIN f_entries t ON t.position = e.cosignature_of LEFT JOIN chain ON chain.start = e.sequence_number LEFT JOIN pol ON pol.sequence_number = e.sequence_number LEFT JOIN q ON q.tree_size = e.sequence_number + 1),
j AS (SELECT *, CASE WHEN i % 31 = 1 THEN 'too_short' WHEN i % 37 = 2 THEN 'bad_version' WHEN i % 41 = 3 THEN 'undecodable' WHEN i % 29 = 5 THEN 'bad_invariant' WHEN i % 43 = 4 THEN 'not_normalised' WHEN i % 47 = 5 THEN 'wrong_destination'
WHEN i % 53 = 6 OR abs(1100 - 1000 - i % 200) > 300 THEN 'stale' WHEN i % 59 = 7 THEN 'bad_signature' WHEN v = 'unbound' THEN 'unbound_cosignature' WHEN i % 23 = 9 AND k < {QUORUM} THEN 'head_quorum'
WHEN cd > 8 THEN 'lost_chain' WHEN NOT cc THEN 'broken_chain' WHEN NOT met THEN 'policy' WHEN i % 61 = 8 THEN 'bad_schema' WHEN i * 1000 % 2000000 + 100 > 1048576 THEN 'too_large' WHEN i % 13 > 10 THEN 'too_many_pointers'
WHEN i % 3 = 0 AND i % 6 <> 0 THEN 'unauthenticated' WHEN i % 3 = 0 AND i % 12 + 2 < 8 THEN 'bad_stamp' END AS c FROM s),
g AS (SELECT j.*, CASE WHEN c IS NULL AND i % 3 <> 0 AND row_number() OVER (PARTITION BY user_id, c IS NULL AND i % 3 <> 0 ORDER BY i) > coalesce(balance, 0) THEN 'no_credit' ELSE c END AS reject_class
FROM j LEFT JOIN f_credits ON exchange_did = 'did:x:' || user_id)"""


@query(f"{_SUBMISSIONS} SELECT i AS sequence_number, reject_class FROM g")
def admission_gates(spark, d):
    return judged(spark, d).select("sequence_number", "reject_class")


_STATUS = ", ".join(f"('{k}', '{e}', {n})" for k, (e, n) in sorted(a.CLASSES.items()))


@query(f"""{_SUBMISSIONS}, st(reject_class, error_class, status) AS (VALUES {_STATUS})
SELECT reject_class, error_class, CAST(status AS INT) AS status, count(*) AS n FROM g JOIN st USING (reject_class) GROUP BY 1, 2, 3""")
def reject_counts(spark, d):
    return judged(spark, d).where("reject_class is not null").groupBy("reject_class").agg(F.count("*").alias("n")).join(F.broadcast(a.classes(spark)), "reject_class").select("reject_class", "error_class", "status", "n")


@query(f"{_SUBMISSIONS.replace('WHEN i % 53 = 6 OR abs(1100 - 1000 - i % 200) > 300 THEN', 'WHEN false THEN')} SELECT i AS sequence_number, reject_class FROM g")
def gates_without_freshness(spark, d):
    return judged(spark, d, off=("stale",)).select("sequence_number", "reject_class")


@query("SELECT e AS error_class, CAST(s AS INT) AS status, CAST(count(c) AS INT) AS gates FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in sorted(a.ERRORS.items())) + ") t(e, s) LEFT JOIN (VALUES "
       + ", ".join(f"('{e}', '{k}')" for k, (e, _) in sorted(a.CLASSES.items())) + ") u(ee, c) ON ee = e GROUP BY 1, 2")
def error_classes(spark, d):
    return a.errors(spark)


@query("""SELECT sequence_number, CASE schema_ref WHEN 'click' THEN sequence_number % 4 <> 1 WHEN 'view' THEN starts_with(signer_did, 'did:user:1') WHEN 'purchase' THEN false ELSE false END AS valid FROM f_entries""")
def registry_validates(spark, d):
    """A closed registry: clicks need a count, views a signer of a kind; purchases' validator fails on missing fields."""
    rows = fx.entries(spark, d).select("sequence_number", F.col("schema_ref").alias("schema_id"), F.when(F.col("sequence_number") % 4 != 1, F.lit('{"n":1}')).otherwise(F.lit("{}")).alias("payload"), "signer_did")
    validators = {"click": F.get_json_object("payload", "$.n").isNotNull(), "view": F.col("signer_did").startswith("did:user:1"), "purchase": F.get_json_object("payload", "$.price") > 0}
    return rows.select("sequence_number", a.registry(validators).alias("valid"))


@query("SELECT sequence_number AS ord, canonical_hash AS hash, sequence_number > min(sequence_number) OVER w AS replay, first_value(log_time) OVER (PARTITION BY canonical_hash ORDER BY sequence_number) AS log_time FROM f_documents WINDOW w AS (PARTITION BY canonical_hash)")
def idempotent_replay(spark, d):
    return a.replays(fx.documents(spark, d).select(F.col("sequence_number").alias("ord"), F.col("canonical_hash").alias("hash"), "log_time"))


@query("""SELECT e.sequence_number, count(DISTINCT c.signer_did) >= CASE t.schema_ref WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS met
FROM f_entries e JOIN f_entries t ON t.position = e.target_root LEFT JOIN f_entries c ON c.status = 0 AND c.cosignature_of = e.target_root GROUP BY e.sequence_number, t.schema_ref""")
def attestation_policy(spark, d):
    return a.policy_met(joins.policy_candidates(fx.entries(spark, d)), {"click": 1, "purchase": 2}).select("sequence_number", "met")


@query(f"{_CHAINS} SELECT start, depth, complete FROM chain")
def evidence_chain(spark, d):
    return _chains(spark, d)
