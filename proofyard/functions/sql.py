"""The codecs under names for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import codecs

# SQL bodies of functions that are plain expressions: (name, arguments, type, body).
FUNCTIONS = [
    ("serialize_position", "did STRING, seq BIGINT", "BINARY", "concat(unhex(lpad(hex(octet_length(encode(did, 'UTF-8'))), 4, '0')), encode(did, 'UTF-8'), unhex(lpad(hex(seq), 16, '0')))"),
    ("entry_identity", "data BINARY", "STRING", "sha2(data, 256)"),
    ("merkle_leaf", "data BINARY", "BINARY", "unhex(sha2(concat(X'00', data), 256))"),
    ("merkle_node", "l BINARY, r BINARY", "BINARY", "unhex(sha2(concat(X'01', l, r), 256))"),
    ("object_key", "prefix STRING, seq BIGINT, hash STRING", "STRING", "concat_ws('/', prefix, lpad(lower(hex(seq)), 16, '0'), hash)"),
    ("backoff", "attempt INT, base BIGINT, cap BIGINT", "BIGINT", "CASE WHEN attempt <= 0 THEN 0 WHEN attempt > 40 THEN cap ELSE CAST(least(cap, base * pow(2, attempt - 1)) AS BIGINT) END"),
]


def register(spark: SparkSession) -> list[str]:
    """Make the codecs known to SQL of this session; gives their names."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udf.register("decode_tips", codecs.decode_tips)
    spark.udf.register("is_nfc", codecs.is_nfc)
    return [f[0] for f in FUNCTIONS] + ["decode_tips", "is_nfc"]
