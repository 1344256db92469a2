"""Admission: gates in a fixed order, the first that fails naming the reject class. Signature checks and envelope codecs
lie outside what can be known here and come in as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 6
VERSION = 1
MAX_PAYLOAD = 1 << 20
MAX_POINTERS = 10
TOLERANCE_S = 300
MAX_CHAIN = 8

DIFFICULTY = 8

# What a gate's failure is called on the wire, and the status that answers it.
CLASSES = {
    "too_short": ("envelope_rejected", 422), "bad_version": ("envelope_rejected", 422), "undecodable": ("envelope_rejected", 422), "bad_invariant": ("envelope_rejected", 422),
    "not_normalised": ("envelope_rejected", 422), "wrong_destination": ("destination_mismatch", 403), "stale": ("freshness_expired", 422), "bad_signature": ("signature_invalid", 401),
    "unbound_cosignature": ("cosignature_binding_mismatch", 422), "head_quorum": ("signature_invalid", 401), "broken_chain": ("evidence_chain_broken", 422), "lost_chain": ("evidence_chain_unavailable", 503),
    "policy": ("attestation_policy_not_met", 403), "bad_schema": ("envelope_rejected", 422), "too_large": ("body_too_large", 413), "too_many_pointers": ("envelope_rejected", 422),
    "unauthenticated": ("admission_proof_invalid", 403), "bad_stamp": ("difficulty_too_low", 403), "no_credit": ("insufficient_credits", 402),
}
# All classes of errors on the wire, with their statuses.
ERRORS = {
    "unknown": 500, "malformed_body": 400, "malformed_json": 400, "body_too_large": 413, "bad_hex_encoding": 400, "bad_hex_length": 400, "missing_path_param": 400, "missing_query_param": 400,
    "invalid_query_param": 400, "unsupported_schema": 400, "batch_too_large": 413, "empty_batch": 400, "insufficient_credits": 402, "duplicate_entry": 409, "invalid_session": 401,
    "expired_session": 401, "signature_invalid": 401, "envelope_rejected": 422, "freshness_expired": 422, "destination_mismatch": 403, "admission_proof_invalid": 403, "difficulty_too_low": 403,
    "not_found": 404, "wal_backpressure": 503, "wal_persist_failed": 500, "sct_signing_failed": 500, "db_query_failed": 500, "read_projection_failed": 500, "fetcher_failed": 500, "proof_gen_failed": 500,
    "credit_deduct_failed": 500, "escrow_override_failed": 502, "db_unavailable": 503, "cosignature_binding_mismatch": 422, "attestation_policy_not_met": 403, "evidence_chain_broken": 422, "evidence_chain_unavailable": 503,
}


def classes(spark: SparkSession) -> DataFrame:
    """(reject_class, error_class, status) of the gates."""
    return spark.createDataFrame([(k, *v) for k, v in sorted(CLASSES.items())], "reject_class string, error_class string, status int")


def errors(spark: SparkSession) -> DataFrame:
    """(error_class, status, gates): every class on the wire, and how many gates answer with it."""
    used = [c for c, _ in CLASSES.values()]
    return spark.createDataFrame([(k, v, used.count(k)) for k, v in sorted(ERRORS.items())], "error_class string, status int, gates int")


def gates(destination: str, now: Column, schemas: list[str], off: tuple[str, ...] = (), quorum: int = 1, difficulty: int = DIFFICULTY) -> list[tuple[str, Column]]:
    """(class, passes) in order; gates named in `off` are left out.

    Gates that ask for something only some submissions carry pass without it: an embedded head (embedded_size) needs
    `quorum` different signers, an evidence chain (chain_depth) must be complete and not end in the dark, an attestation
    (policy_met) must be met."""
    c = F.col
    listed = [
        ("too_short", c("n_bytes") >= MIN_BYTES), ("bad_version", c("version") == VERSION), ("undecodable", c("decodes")), ("bad_invariant", c("invariants")), ("not_normalised", c("normalised")),
        ("wrong_destination", c("destination") == destination), ("stale", F.abs(now - c("event_time_s")) <= TOLERANCE_S), ("bad_signature", c("signature_ok")),
        ("unbound_cosignature", c("cosig_verdict").isNull() | (c("cosig_verdict") != "unbound")), ("head_quorum", c("embedded_size").isNull() | (F.coalesce("head_signers", F.lit(0)) >= quorum)),
        ("lost_chain", c("chain_depth").isNull() | (c("chain_depth") <= MAX_CHAIN)), ("broken_chain", c("chain_depth").isNull() | c("chain_complete")), ("policy", c("policy_met").isNull() | c("policy_met")),
        ("bad_schema", c("schema_id").isNull() | c("schema_id").isin(schemas)), ("too_large", c("n_bytes") <= MAX_PAYLOAD),
        ("too_many_pointers", c("n_pointers") <= MAX_POINTERS), ("unauthenticated", c("session_ok") | c("stamp_bits").isNotNull()),
        ("bad_stamp", c("session_ok") | (c("stamp_bits") >= difficulty)),
    ]
    return [(name, ok) for name, ok in listed if name not in off]


def with_heads(submissions: DataFrame, sigs: DataFrame) -> DataFrame:
    """Adds head_signers: how many different witnesses have signed the head that a submission embeds."""
    signers = sigs.groupBy(F.col("tree_size").alias("embedded_size")).agg(F.count_distinct("signer").alias("head_signers"))
    return submissions.join(signers, "embedded_size", "left")


def deduct(judged: DataFrame, credits: DataFrame, order: str = "sequence_number") -> DataFrame:
    """Judged submissions after each that has passed and came with a session has taken one of its exchange's credits, in
    order: those that find none are rejected as no_credit."""
    from .changes import admit_by_credit

    asks = judged.where(F.col("reject_class").isNull() & F.col("session_ok")).select(order, "exchange_did")
    refused = admit_by_credit(asks, credits, order).where("not admitted").select(order, F.lit("no_credit").alias("_late"))
    return judged.join(refused, order, "left").withColumn("reject_class", F.coalesce("reject_class", "_late")).drop("_late")


def registry(validators: dict[str, Column]) -> Column:
    """Whether a submission's payload passes the validator of its schema, of a closed set; one without a schema passes,
    one of another schema fails."""
    known = F.coalesce(*[F.when(F.col("schema_id") == s, F.coalesce(v, F.lit(False))) for s, v in sorted(validators.items())])
    return F.when(F.col("schema_id").isNull(), True).otherwise(F.coalesce(known, F.lit(False)))


def judge(submissions: DataFrame, listed: list[tuple[str, Column]]) -> DataFrame:
    """Adds reject_class, null where all gates pass; a gate that cannot be decided fails."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in listed]
    return submissions.withColumn("reject_class", F.coalesce(*failed))


def replays(submissions: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, hash, replay, log_time): a repeated hash keeps the log time of its first submission."""
    first = submissions.groupBy("hash").agg(F.min_by("log_time", order).alias("first_time"), F.min(order).alias("first"))
    return submissions.select(order, "hash").join(first, "hash").select(order, "hash", (F.col(order) > F.col("first")).alias("replay"), F.col("first_time").alias("log_time"))


def policy_met(candidates: DataFrame, least: dict[str, int]) -> DataFrame:
    """Adds met: as many different cosigners as the policy of the primary's schema asks for; none asked is met."""
    need = F.coalesce(*[F.when(F.col("primary_schema") == s, n) for s, n in sorted(least.items())], F.lit(0))
    return candidates.withColumn("met", F.size("cosigners") >= need)


def evidence_chain(entries: DataFrame, start: DataFrame, most: int = 8) -> DataFrame:
    """(start, depth, complete): how far the chain of evidence pointers of each start leads, at most `most` steps; it is
    complete if it ends at an entry without a pointer. A bounded loop of joins over the open ends."""
    pointers = entries.select(F.col("sequence_number").alias("at"), F.col("evidence_seq").alias("next"), F.lit(True).alias("known"))
    open_, done = start.select(F.col("sequence_number").alias("start"), F.col("sequence_number").alias("at")), None
    for depth in range(most + 1):
        rows = open_.join(pointers, "at", "left")
        end = rows.where("next is null").select("start", F.lit(depth).alias("depth"), F.col("known").isNotNull().alias("complete"))
        done = end if done is None else done.unionByName(end)
        open_ = rows.where("next is not null").select("start", F.col("next").alias("at"))
    return done.unionByName(open_.select("start", F.lit(most + 1).alias("depth"), F.lit(False).alias("complete")))
