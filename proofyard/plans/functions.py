"""Scalar functions (survey F, S5, S9, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs as k
from ..sources import store
from . import fixtures as fx
from .registry import query


def _events(spark, d):
    return fx.table(spark, d, "events")


@query("SELECT event_id, lower(printf('%04x', length('did:user:' || user_id)) || hex(encode('did:user:' || user_id)) || printf('%016x', event_id)) AS position, 'did:user:' || user_id AS log_did, event_id AS sequence FROM events")
def position_codec(spark, d):
    e = _events(spark, d).select("event_id", k.serialize_position(F.concat(F.lit("did:user:"), F.col("user_id").cast("string")), "event_id").alias("p"))
    return e.select("event_id", F.lower(F.hex("p")).alias("position"), k.deserialize_position("p")["log_did"].alias("log_did"), k.deserialize_position("p")["sequence"].alias("sequence"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN 'did:log:' || event_type END AS log_did, CASE WHEN event_id % 3 <> 1 THEN event_id END AS sequence FROM events")
def parse_log_position(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 1, F.concat(F.lit(":"), i.cast("string"))).otherwise(F.concat(F.lit("did:log:"), F.col("event_type"), F.lit(":"), i.cast("string")))
    p = k.parse_position(text)
    return _events(spark, d).select(i, p["log_did"].alias("log_did"), p["sequence"].alias("sequence"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256(event_type) WHEN event_id % 3 = 1 THEN repeat('0', 64) END AS hash FROM events")
def hex_codec(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.sha2("event_type", 256)).when(i % 3 == 1, "").otherwise("abc")
    return _events(spark, d).select(i, k.hex32(k.parse_hex32(text)).alias("hash"))


@query("SELECT doc_id, sha256(text) AS identity FROM documents")
def entry_identity(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", k.identity("text").alias("identity"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS second, epoch_us(ts) AS us FROM events")
def time_codec(spark, d):
    e = _events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.select("event_id", F.substring(k.rfc3339_nano(k.micros("us")), 1, 19).alias("second"), "us")


@query("SELECT event_id, CASE WHEN us < 1000 THEN us || 'us' WHEN us < 1000000 THEN CAST(CAST(us / 1000 AS DECIMAL(20, 1)) AS VARCHAR) || 'ms' ELSE CAST(CAST(us / 1000000 AS DECIMAL(20, 2)) AS VARCHAR) || 's' END AS shown FROM (SELECT event_id, event_id * event_id AS us FROM events)")
def pretty_duration(spark, d):
    return _events(spark, d).select("event_id", k.pretty_duration(F.col("event_id") * F.col("event_id")).alias("shown"))


@query("SELECT event_id, CASE WHEN n = 0 THEN 0 ELSE CAST(least(60000, 1000 * pow(2, n - 1)) AS BIGINT) END AS wait FROM (SELECT event_id, event_id % 45 AS n FROM events)")
def retry_backoff(spark, d):
    return _events(spark, d).select("event_id", k.backoff(F.col("event_id") % 45, 1000, 60_000).alias("wait"))


@query("SELECT hash, last_err_ns + CASE WHEN attempts = 0 THEN 0 ELSE least(1000000, 1000 * CAST(pow(2, attempts - 1) AS BIGINT)) END <= 500000 AS due FROM f_journal")
def retry_due(spark, d):
    return fx.journal(spark, d).select("hash", k.retry_due("last_err_ns", "attempts", 1000, 1_000_000, F.lit(500_000)).alias("due"))


@query("""WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id * 37 % 20000 AS lag FROM events), f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 16 AS v FROM l UNION ALL
SELECT f.user_id, l.i, CASE WHEN lag < 100 THEN greatest(v - 1, 8) WHEN lag > 10000 THEN least(v + 1, 24) ELSE v END FROM f JOIN l ON l.user_id = f.user_id AND l.i = f.i + 1)
SELECT user_id, CAST(arg_max(v, i) AS INT) AS difficulty FROM f GROUP BY 1""")
def difficulty_fold(spark, d):
    """Each user as a log with its own difficulty."""
    e = fx.table(spark, d, "events").select("user_id", F.struct("event_id", (F.col("event_id") * 37 % 20000).alias("lag")).alias("x"))
    lags = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lag"])
    return e.groupBy("user_id").agg(k.difficulty(lags).alias("difficulty"))


@query("SELECT 'entries/' || printf('%016x', event_id) || '/' || sha256(event_type) AS key, 'https://store.example/entries/' || printf('%016x', event_id) || '/' || sha256(event_type) AS url FROM events")
def object_keys(spark, d):
    h = F.sha2("event_type", 256)
    return _events(spark, d).select(k.object_key("entries", "event_id", h).alias("key"), k.public_url("https://store.example/", "entries", "event_id", h).alias("url"))


@query("SELECT n, CASE WHEN n < 1000 THEN printf('%03d', n) WHEN n < 1000000 THEN printf('x%03d/%03d', n // 1000, n % 1000) ELSE printf('x%03d/x%03d/%03d', n // 1000000, n // 1000 % 1000, n % 1000) END AS path FROM (SELECT event_id * event_id AS n FROM events)")
def tile_paths(spark, d):
    n = F.col("event_id") * F.col("event_id")
    return _events(spark, d).select(n.alias("n"), k.tile_path(n).alias("path"))


@query("SELECT event_id, 'log/' || event_type AS origin, event_id AS size, sha256(event_type) AS root FROM events")
def checkpoint_parse(spark, d):
    note = F.concat(F.lit("log/"), F.col("event_type"), F.lit("\n"), F.col("event_id").cast("string"), F.lit("\n"), F.base64(F.unhex(F.sha2("event_type", 256))), F.lit("\n"))
    e = _events(spark, d).select("event_id", note.alias("value"))
    return store.parse_checkpoints(e.withColumn("value", F.col("value"))).select(F.col("size").alias("event_id"), "origin", "size", "root")


@query("SELECT hash, state, sequence, attempts, last_err_ns FROM f_journal")
def record_codec(spark, d):
    j = fx.journal(spark, d).withColumn("log_time_micros", F.lit(5).cast("long"))
    r = k.decode_record("wal_meta", k.encode_record("wal_meta", **{c: c for c in ("state", "sequence", "attempts", "last_err_ns", "log_time_micros")}))
    return j.select("hash", r.alias("r")).select("hash", *[F.col(f"r.{c}").cast(t).alias(c) for c, t in (("state", "int"), ("sequence", "long"), ("attempts", "int"), ("last_err_ns", "long"))])


@query("SELECT user_id, 'did:log:main:' || max(event_id) AS last_tip, CAST(least(count(*), 10) AS INT) AS n FROM events GROUP BY 1", python=True)
def tips_codec(spark, d):
    from ..operators.windows import tip_history

    h = tip_history(_events(spark, d).select("user_id", "event_id"), "user_id", "event_id")
    tips = F.transform("history", lambda s: F.struct(F.lit(fx.LOG).alias("log_did"), s.alias("sequence")))
    back = h.select("user_id", k.decode_tips(k.encode_tips(tips)).alias("t"))
    return back.select("user_id", F.concat_ws(":", F.element_at("t", -1)["log_did"], F.element_at("t", -1)["sequence"].cast("string")).alias("last_tip"), F.size("t").alias("n"))


@query("SELECT doc_id, true AS nfc FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 2 = 1", python=True)
def nfc_check(spark, d):
    i = F.col("doc_id")
    return fx.table(spark, d, "documents").select(i, k.is_nfc(F.when(i % 2 == 0, "café").otherwise("café")).alias("nfc"))


@query("SELECT event_id, event_id % 4 = 1 AS duplicate FROM events")
def duplicate_errors(spark, d):
    i = F.col("event_id")
    message = F.when(i % 4 == 1, "ERROR: duplicate key value violates unique constraint").when(i % 4 == 2, "timeout").when(i % 4 == 3, "")
    return _events(spark, d).select(i, k.is_duplicate_error(message).alias("duplicate"))


@query("SELECT event_id, lower('07' || hex(encode(event_type)) || printf('%016x', event_id)) AS key FROM events")
def composite_keys(spark, d):
    return _events(spark, d).select("event_id", F.lower(F.hex(k.composite_key(b"\x07", k.key_part("event_type", "kind"), k.u_be("event_id", 8)))).alias("key"))


@query("SELECT doc_id, least(octet_length(encode(text)), 1048576 - 4096) AS kept FROM documents")
def payload_caps(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.least(F.octet_length("text").cast("long"), F.lit(k.payload_cap(1 << 20)).cast("long")).alias("kept"))
