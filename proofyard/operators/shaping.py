"""Responses: what a caller gets of an entry, a position, a commitment, a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import rfc3339_nano


def entry_response(entries: DataFrame) -> DataFrame:
    """Sequence, hash of the bytes, time, signer, sizes."""
    return entries.select(
        "sequence_number", F.sha2("data", 256).alias("canonical_hash"), rfc3339_nano(F.col("log_time")).alias("log_time"), "signer_did",
        F.octet_length("data").cast("long").alias("canonical_size"), F.octet_length("payload").cast("long").alias("payload_size"))


def index_rows(envelopes: DataFrame) -> DataFrame:
    """Nested headers flattened; an empty delegate is none."""
    h = lambda f: F.col(f"header.{f}")
    position = lambda f: F.when(h(f).isNotNull(), F.concat_ws(":", h(f"{f}.log_did"), h(f"{f}.sequence").cast("string")))
    return envelopes.select(
        "sequence_number", h("signer_did").alias("signer_did"), position("target_root").alias("target_root"), position("cosignature_of").alias("cosignature_of"),
        h("schema_ref").alias("schema_ref"), F.nullif(h("delegate_did"), F.lit("")).alias("delegate_did"))


def position_response(did: Column, seq: Column) -> Column:
    """A position as JSON; one without a log is null."""
    return F.when(did != "", F.to_json(F.struct(did.alias("log_did"), seq.alias("sequence"))))


def schema_id(payload: Column, known: list[str]) -> Column:
    """The payload's schema_id if it is one of a closed set; text that is no JSON has none."""
    found = F.get_json_object(payload, "$.schema_id")
    return F.when(found.isin(known), found)


def commitment_response(ranges: DataFrame) -> DataFrame:
    return ranges.select("id", F.to_json(F.struct("range_start_seq", "range_end_seq", "prior_root", "post_root")).alias("json"))


def split_response(splits: DataFrame, log_did: str) -> DataFrame:
    return splits.select("sequence_number", F.to_json(F.struct(F.lit(log_did).alias("log_did"), F.col("sequence_number").alias("sequence"))).alias("position"), "schema_id", "split_id")


def entries_json(rows: DataFrame) -> DataFrame:
    """{entries: [...], count} of a bounded page."""
    row = F.struct(*sorted(rows.columns))
    return rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("entries"), F.count("*").alias("count"))).alias("json"))


def log_info(spark: SparkSession, log_did: str, delay_s: int, version: str) -> DataFrame:
    return spark.createDataFrame([(log_did, delay_s, version)], "log_did string, max_merge_delay_s int, version string")


def genesis(shards: DataFrame) -> DataFrame:
    """The first payload of each shard; a shard without a name or with a negative start is left out."""
    ok = (F.col("shard_did") != "") & (F.col("range_start_seq") >= 0)
    return shards.where(ok).select("shard_did", F.to_json(F.struct(F.lit("genesis").alias("type"), "shard_did", "range_start_seq")).alias("payload"))
