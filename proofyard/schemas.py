"""Schemas of the log's tables, declared and never inferred, and the versions they came in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIVE, TOMBSTONE, GHOST = 0, 1, 2
PENDING, SEQUENCED, SHIPPED, MANUAL = 1, 2, 3, 4

_DDL = {
    "entry_index": "sequence_number bigint, canonical_hash binary, log_time timestamp, signer_did string, target_root string, cosignature_of string, schema_ref string, status smallint, delegate_did string",
    "smt_leaves": "leaf_key binary, origin_tip struct<log_did:string,sequence:bigint>, authority_tip struct<log_did:string,sequence:bigint>, updated_at timestamp",
    "jellyfish_nodes": "node_hash binary, payload binary, created_at timestamp",
    "smt_root_state": "id int, current_root binary, committed_through_seq bigint, updated_at timestamp",
    "builder_cursor": "id int, last_processed_sequence bigint, updated_at timestamp",
    "delta_window_buffers": "leaf_key binary, tip_history binary, updated_at timestamp",
    "tree_heads": "tree_size bigint, hash_algo smallint, root_hash binary, smt_root binary, created_at timestamp",
    "tree_head_sigs": "tree_size bigint, hash_algo smallint, signer string, sig_algo smallint, signature binary, created_at timestamp",
    "derivation_commitments": "id bigint, range_start_seq bigint, range_end_seq bigint, prior_smt_root binary, post_smt_root binary, mutations_json string, commentary_seq bigint, created_at timestamp",
    "commitment_split_id": "sequence_number bigint, schema_id string, split_id binary",
    "witness_sets": "version bigint, set_hash binary, keys_json string, scheme_tag int, created_at timestamp",
    "equivocation_proofs": "id bigint, head_a binary, head_b binary, tree_size bigint, detected_at timestamp",
    "credits": "exchange_did string, balance bigint, total_purchased bigint, total_consumed bigint",
    "sessions": "token string, exchange_did string, expires_at timestamp",
    "schema_migrations": "version int, applied_at timestamp, description string",
    "wal": "hash binary, state tinyint, sequence bigint, attempts int, last_err_ns bigint, log_time_micros bigint",
    "gossip_events": "event_id binary, originator string, kind string, lamport_time bigint, prev_hash string, bindings array<string>, body string",
}


def schema(name: str) -> T.StructType:
    """A table's schema; a session must be there to read it."""
    return T.StructType.fromDDL(_DDL[name])



# Versions of the schema: what each added. A version is applied once, in order.
MIGRATIONS = [
    (1, "initial tables"), (2, "root state"), (3, "content-addressed nodes"), (4, "signed cursor sentinel"),
    (5, "entry status"), (6, "ghost leaves"), (7, "root of the state tree in heads"), (8, "delegate column"),
]


def require_schema(df: DataFrame, name: str, types: bool = True) -> DataFrame:
    """`df` if it has the table's columns (and types), else an error that names what is missing."""
    wrong = []
    for field in schema(name):
        got = df.schema[field.name].dataType if field.name in df.columns else None
        if got is None or types and got != field.dataType:
            wrong.append(f"{field.name}: {field.dataType.simpleString()}, not {got.simpleString() if got else 'there'}")
    if wrong:
        raise ValueError(f"{name}: " + "; ".join(wrong))
    return df


def migrations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIGRATIONS, "version int, description string")


def pending_migrations(known: DataFrame, applied: DataFrame) -> DataFrame:
    """Known versions that have not been applied, in order."""
    return known.join(applied.select("version"), "version", "left_anti").orderBy("version")


def length_checked(column: str, n: int = 32):
    """The column where it has n bytes, else null."""
    return F.when(F.octet_length(column) == n, F.col(column))
