"""Scalar functions: codecs of positions, keys and records, hashes, times, backoff. All built of SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = Column | str


def _col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def u_be(value: C, n_bytes: int) -> Column:
    """Big-endian unsigned integer of n bytes."""
    return F.unhex(F.lpad(F.hex(_col(value).cast("long")), 2 * n_bytes, "0"))


def from_be(data: Column) -> Column:
    """Integer of up to eight big-endian bytes; null from 2^63 on."""
    return F.conv(F.hex(data), 16, 10).try_cast("long")


def serialize_position(log_did: C, sequence: C) -> Column:
    """u16 length, name, u64 sequence."""
    name = F.encode(_col(log_did), "UTF-8")
    return F.concat(u_be(F.octet_length(name), 2), name, u_be(sequence, 8))


def deserialize_position(data: C) -> Column:
    """struct(log_did, sequence); null for under ten bytes or a length that does not fit."""
    data = _col(data)
    n = from_be(F.substring(data, 1, 2)).cast("int")
    fits = (F.octet_length(data) >= 10) & (F.octet_length(data) == n + 10)
    body = data.substr(F.lit(3), n)
    return F.when(fits, F.struct(F.decode(body, "UTF-8").alias("log_did"), from_be(data.substr(n + 3, F.lit(8))).alias("sequence")))


def parse_position(text: C) -> Column:
    """struct(log_did, sequence) of did:sequence, parted at the last colon; null if either is missing."""
    text = _col(text)
    pattern = r"^(.+):([0-9]+)$"
    did, seq = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2).try_cast("long")
    return F.when((did != "") & seq.isNotNull(), F.struct(did.alias("log_did"), seq.alias("sequence")))


def hex32(data: C) -> Column:
    """Lower-case hex of a 32-byte value; empty gives zeros, other lengths null."""
    data = _col(data)
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).when(F.octet_length(data) == 0, F.lit("0" * 64))


def parse_hex32(text: C) -> Column:
    """The 32 bytes of 64 hex digits; empty gives zeros, anything else null."""
    text = _col(text)
    return F.when(F.length(text) == 64, F.try_to_binary(text, F.lit("hex"))).when(F.length(text) == 0, F.unhex(F.lit("0" * 64)))


def identity(data: C) -> Column:
    """SHA-256 of canonical bytes, lower-case hex."""
    return F.sha2(_col(data), 256)


def micros(column: C) -> Column:
    return F.timestamp_micros(_col(column))


def rfc3339_nano(time: C) -> Column:
    """Time in UTC with the fraction's trailing zeros removed."""
    text = F.date_format(_col(time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def pretty_duration(us: C) -> Column:
    """Microseconds as µs, ms or s."""
    us = _col(us).cast("long")
    return F.when(us < 1000, F.concat(us.cast("string"), F.lit("us"))).when(
        us < 1_000_000, F.concat((us / 1000).cast("decimal(20,1)").cast("string"), F.lit("ms"))
    ).otherwise(F.concat((us / 1_000_000).cast("decimal(20,2)").cast("string"), F.lit("s")))


def backoff(attempt: C, base: int, cap: int) -> Column:
    """base * 2^(attempt - 1), at most cap; overflow gives cap, no attempt gives 0."""
    n = _col(attempt).cast("int")
    return F.when(n <= 0, 0).when(n > 40, cap).otherwise(F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), n - 1)).cast("long")).cast("long")


def retry_due(last_error_ns: C, attempt: C, base_ns: int, cap_ns: int, now_ns: C) -> Column:
    return _col(last_error_ns) + backoff(attempt, base_ns, cap_ns) <= _col(now_ns)


def difficulty(lags: Column, start: int = 16, floor: int = 8, cap: int = 24, calm: int = 100, busy: int = 10_000) -> Column:
    """Fold of an ordered array of lags: one step down when calm, one up when busy, clamped."""
    return F.aggregate(lags, F.lit(start), lambda d, lag: F.when(lag < calm, F.greatest(d - 1, F.lit(floor))).when(lag > busy, F.least(d + 1, F.lit(cap))).otherwise(d))


def payload_cap(entry_cap: int, overhead: int = 4096, least: int = 1024) -> int:
    """Bytes left for a payload in an entry of limited size."""
    return max(least, entry_cap - overhead)


def object_key(prefix: str, sequence: C, hash_hex: C) -> Column:
    """<prefix>/<sequence as 16 hex digits>/<hash>."""
    return F.concat_ws("/", F.lit(prefix), F.lpad(F.lower(F.hex(_col(sequence).cast("long"))), 16, "0"), _col(hash_hex))


def public_url(base: str, prefix: str, sequence: C, hash_hex: C) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), object_key(prefix, sequence, hash_hex))


def tile_path(index: C) -> Column:
    """Decimal digits in groups of three, all but the last with an x before: 1234067 is x001/x234/067."""
    digits = _col(index).cast("string")
    width = (F.ceil(F.length(digits) / 3) * 3).cast("int")
    return F.regexp_replace(F.lpad(digits, width, "0"), r"(\d{3})(?=\d)", "x$1/")


def safe_text(text: C, n: int = 64) -> Column:
    """For logs: at most n characters, control characters as question marks."""
    text = F.regexp_replace(_col(text), r"[\x00-\x1F\x7F]", "?")
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def is_duplicate_error(message: C) -> Column:
    return F.coalesce(_col(message).rlike("(?i)duplicate key|unique constraint|23505"), F.lit(False))


# Layouts of fixed records, as (field, first byte, bytes), all big-endian.
RECORDS = {
    "wal_meta": [("state", 1, 1), ("sequence", 2, 8), ("attempts", 10, 4), ("last_err_ns", 14, 8), ("log_time_micros", 22, 8)],
    "head": [("event_id", 1, 32), ("lamport", 33, 8)],
    "stats": [("events", 1, 8), ("originators", 9, 8)],
    "hwm": [("sequence", 1, 8)],
}


def record_size(name: str) -> int:
    _, at, n = RECORDS[name][-1]
    return at + n - 1


def encode_record(name: str, **fields: C) -> Column:
    return F.concat(*[_col(fields[f]) if n > 8 else u_be(fields[f], n) for f, _, n in RECORDS[name]])


def decode_record(name: str, data: C) -> Column:
    """struct of the record's fields; null where the length is another."""
    data = _col(data)
    parts = [(F.substring(data, at, n) if n > 8 else from_be(F.substring(data, at, n))).alias(f) for f, at, n in RECORDS[name]]
    return F.when(F.octet_length(data) == record_size(name), F.struct(*parts))


def encode_tips(tips: C) -> Column:
    """u16 count, then each tip (struct of log_did, sequence) as a position."""
    tips = _col(tips)
    body = F.aggregate(tips, F.lit(b""), lambda acc, t: F.concat(acc, serialize_position(t["log_did"], t["sequence"])))
    return F.concat(u_be(F.size(tips), 2), body)


_TIPS = T.ArrayType(T.StructType([T.StructField("log_did", T.StringType()), T.StructField("sequence", T.LongType())]))


@F.pandas_udf(_TIPS)
def decode_tips(data: pd.Series) -> pd.Series:
    """Inverse of encode_tips; null where the bytes do not parse."""

    def one(b):
        if b is None or len(b) < 2:
            return None
        n, at, out = int.from_bytes(b[:2], "big"), 2, []
        for _ in range(n):
            if at + 2 > len(b):
                return None
            k = int.from_bytes(b[at : at + 2], "big")
            if at + 10 + k > len(b):
                return None
            out.append({"log_did": b[at + 2 : at + 2 + k].decode("utf-8", "replace"), "sequence": int.from_bytes(b[at + 2 + k : at + 10 + k], "big")})
            at += 10 + k
        return out if at == len(b) else None

    return data.map(one)


@F.pandas_udf(T.BooleanType())
def is_nfc(text: pd.Series) -> pd.Series:
    """Whether a header string is in Unicode normal form C."""
    import unicodedata

    return text.map(lambda s: None if s is None else unicodedata.is_normalized("NFC", s))


# Limits of the parts of index keys, in bytes.
KEY_LIMITS = {"originator": 1024, "kind": 64, "schema": 256}


def key_part(text: C, what: str) -> Column:
    """A part of a key as bytes, cut at its limit."""
    return F.substring(F.encode(_col(text), "UTF-8"), 1, KEY_LIMITS[what])


def composite_key(prefix: bytes, *parts: Column) -> Column:
    """A prefix and parts; equal prefixes sort by their parts' bytes."""
    return F.concat(F.lit(prefix), *parts)


def fnv1a(text: Column, shards: int | None = None) -> Column:
    """The 32-bit FNV-1a hash of a string's bytes, or the shard of so many that it falls to."""
    data = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    # The hash's offset and prime.
    out = F.aggregate(places, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return out if shards is None else F.pmod(out, F.lit(shards))


def json_record(text: Column, ddl: str, required: list[str]) -> Column:
    """(record, missing): a JSON text as a record, and which of its required fields it lacks or holds empty; a text that
    is no JSON lacks all of them."""
    record = F.from_json(text, ddl)
    lacks = [F.when(F.coalesce(record[name].cast("string"), F.lit("")) == "", F.lit(name)) for name in required]
    return F.struct(record.alias("record"), F.array_compact(F.array(*lacks)).alias("missing"))


def head_of_body(body: Column) -> Column:
    """(tree_size, root_hash) of the head that a gossip event's body holds as JSON, or null where it holds none: the size
    must not be negative and the root have 64 hexadecimal digits."""
    got = json_record(body, "tree_size long, root_hash string", ["tree_size", "root_hash"])
    ok = (F.size(got["missing"]) == 0) & (got["record"]["tree_size"] >= 0) & got["record"]["root_hash"].rlike("^[0-9a-f]{64}$")
    return F.when(ok, got["record"])
