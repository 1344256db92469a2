"""Lookups and scans (survey Q, P and part of S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import joins, lookups, shaping, windows
from . import fixtures as fx
from .registry import query

_HEAD = "sequence_number, log_time, canonical_hash"
_NOW = "2024-01-01 00:00:00"


def _by(column: str, value: str) -> str:
    return f"SELECT {_HEAD} FROM f_entries WHERE {column} = '{value}'"


@query("SELECT sequence_number, log_time, canonical_hash, sha256(concat_ws('|', sequence_number, user_id, schema_ref)) AS data_hash FROM f_entries WHERE signer_did = 'did:user:7'")
def query_signer_did(spark, d):
    e = fx.entries(spark, d)
    store = e.select("sequence_number", "canonical_hash", F.concat_ws("|", F.col("sequence_number").cast("string"), F.col("user_id").cast("string"), "schema_ref").alias("data"))
    return joins.hydrate(lookups.by_column(e, "signer_did", "did:user:7"), store).select("sequence_number", "log_time", "canonical_hash", F.sha2("data", 256).alias("data_hash"))


@query(_by("target_root", fx.LOG + ":70"))
def query_target_root(spark, d):
    return lookups.by_column(fx.entries(spark, d), "target_root", fx.LOG + ":70")


@query(_by("cosignature_of", fx.LOG + ":100"))
def query_cosignature_of(spark, d):
    return lookups.by_column(fx.entries(spark, d), "cosignature_of", fx.LOG + ":100")


@query(_by("schema_ref", "click"))
def query_schema_ref(spark, d):
    return lookups.by_column(fx.entries(spark, d), "schema_ref", "click")


@query("SELECT sequence_number, log_time, canonical_hash FROM f_documents WHERE delegate_did = 'did:src:src3' AND status = 0")
def query_delegate_did(spark, d):
    return lookups.by_column(fx.documents(spark, d), "delegate_did", "did:src:src3", live_only=True, newest_first=True)


@query(f"SELECT {_HEAD} FROM f_entries WHERE sequence_number >= 500 ORDER BY sequence_number LIMIT 1000")
def scan_from_position(spark, d):
    return lookups.scan_from(fx.entries(spark, d), 500, 1000)


@query(f"SELECT {_HEAD} FROM f_entries WHERE sequence_number BETWEEN 200 AND 699")
def entries_range(spark, d):
    return lookups.in_range(fx.entries(spark, d), 200, 699)


@query(f"SELECT {_HEAD} FROM f_entries WHERE sequence_number >= 100 ORDER BY sequence_number LIMIT 1000")
def entries_batch(spark, d):
    return lookups.scan_from(fx.entries(spark, d), 100, 5000, cap=1000)


@query("SELECT sequence_number, canonical_hash, signer_did FROM f_entries WHERE sequence_number = 42")
def entry_by_sequence(spark, d):
    return lookups.by_sequence(fx.entries(spark, d), 42, fx.LOG, fx.LOG).select("sequence_number", "canonical_hash", "signer_did")


def _asked(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("sequence_number")).where("sequence_number % 3 = 0")


@query("SELECT o.s AS sequence_number, canonical_hash, log_time, coalesce(status = 2, false) AS is_ghost, status IS NOT NULL AS found FROM (SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 3 = 0) o LEFT JOIN f_documents ON s = sequence_number")
def hash_by_seq(spark, d):
    return lookups.hash_by_seq(fx.documents(spark, d), _asked(spark, d))


@query("SELECT canonical_hash, sequence_number FROM f_documents WHERE status <> 2")
def primary_by_hash(spark, d):
    return lookups.primary_by_hash(fx.documents(spark, d))


@query("SELECT canonical_hash, min(sequence_number) AS sequence_number FROM f_documents GROUP BY 1")
def seq_by_hash(spark, d):
    return lookups.seq_by_hash(fx.documents(spark, d))


@query("SELECT delegate_did, max(sequence_number) AS sequence_number, arg_max(canonical_hash, sequence_number) AS canonical_hash, count(*) AS entries FROM f_entries WHERE status = 0 AND delegate_did IS NOT NULL GROUP BY 1")
def latest_delegation(spark, d):
    return lookups.latest_per(fx.entries(spark, d), "delegate_did")


@query("SELECT signer_did, max(sequence_number) AS sequence_number, arg_max(canonical_hash, sequence_number) AS canonical_hash, count(*) AS entries FROM f_entries GROUP BY 1")
def latest_per_signer(spark, d):
    return lookups.latest_per(fx.entries(spark, d), "signer_did", live_only=False)


@query(_by("cosignature_of", fx.LOG + ":125") + " AND status = 0")
def cosignatures_live(spark, d):
    return lookups.cosignatures_live(fx.entries(spark, d), fx.LOG + ":125")


@query("""SELECT coalesce(w.hash, i.canonical_hash) AS hash, sequence_number, CASE WHEN sequence_number IS NOT NULL THEN 'found' WHEN state = 1 THEN 'pending' WHEN state = 4 THEN 'manual' WHEN state IN (2, 3) THEN 'broken' ELSE 'missing' END AS answer
FROM (SELECT * FROM f_journal WHERE sequence % 4 <> 0) w FULL JOIN (SELECT * FROM f_documents WHERE status <> 2 AND sequence_number % 7 <> 3) i ON w.hash = i.canonical_hash""")
def hash_lookup_state(spark, d):
    return lookups.hash_lookup_state(fx.journal(spark, d).where("sequence % 4 <> 0"), fx.documents(spark, d).where("sequence_number % 7 <> 3"))


@query("""SELECT e.sequence_number, CASE WHEN e.status = 2 THEN 'primary' WHEN w.state IN (1, 2, 4) THEN 'inline' ELSE 'store' END AS route, CASE WHEN e.status = 2 THEN p.sequence_number ELSE e.sequence_number END AS target
FROM f_documents e LEFT JOIN f_documents p ON p.status <> 2 AND p.canonical_hash = e.canonical_hash LEFT JOIN f_journal w ON w.hash = e.canonical_hash""")
def raw_entry_route(spark, d):
    return lookups.raw_entry_route(fx.documents(spark, d), fx.journal(spark, d))


def _keys(spark, d):
    u = fx.table(spark, d, "customer")
    return u.select(F.col("c_custkey").alias("ord"), F.sha2(F.concat_ws("|", F.lit("leaf"), F.col("c_custkey").cast("string")), 256).alias("leaf_key"))


@query("SELECT c_custkey AS ord, sha256('leaf|' || c_custkey) AS leaf_key, origin_tip, authority_tip, l.leaf_key IS NOT NULL AS exists FROM customer LEFT JOIN f_leaves l ON l.leaf_key = sha256('leaf|' || c_custkey)")
def smt_leaf_get(spark, d):
    return lookups.keyed_batch(fx.leaves(spark, d).drop("user_id"), "leaf_key", _keys(spark, d))


@query("SELECT sha256('smt|' || max(o_orderkey)) AS current_root, (SELECT count(*) FROM f_leaves) AS leaves FROM orders")
def smt_root(spark, d):
    newest = windows.latest_head(fx.heads(spark, d)).select(F.col("smt_root").alias("current_root"))
    return newest.join(F.broadcast(fx.leaves(spark, d).agg(F.count("*").alias("leaves"))))


@query("SELECT leaf_key, origin_tip FROM f_leaves WHERE leaf_key = sha256('leaf|5')")
def node_get(spark, d):
    return fx.leaves(spark, d).where(F.col("leaf_key") == F.sha2(F.lit("leaf|5"), 256)).select("leaf_key", "origin_tip")


@query("SELECT leaf_key, origin_tip FROM f_leaves ORDER BY origin_tip DESC, leaf_key LIMIT 50")
def warm_nodes(spark, d):
    return lookups.newest(fx.leaves(spark, d), [F.desc("origin_tip"), F.asc("leaf_key")], 50).select("leaf_key", "origin_tip")


@query(f"""SELECT t.token, CASE WHEN expires_at > TIMESTAMP '{_NOW}' THEN exchange_did END AS exchange_did, CASE WHEN exchange_did IS NULL THEN 'unknown' WHEN expires_at > TIMESTAMP '{_NOW}' THEN 'authenticated' ELSE 'expired' END AS answer
FROM (SELECT sha256('tok|' || c_custkey) AS token FROM customer) t LEFT JOIN f_sessions s ON s.token = t.token""")
def session_lookup(spark, d):
    tokens = fx.table(spark, d, "customer").select(F.sha2(F.concat_ws("|", F.lit("tok"), F.col("c_custkey").cast("string")), 256).alias("token"))
    return lookups.session_lookup(fx.sessions(spark, d), tokens, F.lit(_NOW).cast("timestamp_ntz"))


@query("SELECT 'did:x:' || n_nationkey * 100 AS exchange_did, coalesce(balance, 0) AS balance FROM nation LEFT JOIN f_credits ON exchange_did = 'did:x:' || n_nationkey * 100")
def credit_balance(spark, d):
    dids = fx.table(spark, d, "nation").select(F.concat(F.lit("did:x:"), (F.col("n_nationkey") * 100).cast("string")).alias("exchange_did"))
    return lookups.balance(fx.credits(spark, d), dids)


@query("SELECT max(s_suppkey) AS version, CAST(max(s_suppkey) % 5 + 1 AS INT) AS k FROM supplier")
def witness_set_current(spark, d):
    sets = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("version"), F.to_json(F.struct((F.col("s_suppkey") % 5 + 1).cast("int").alias("k"))).alias("keys_json"))
    return sets.agg(F.max("version").alias("version"), F.max_by("keys_json", "version").alias("j")).select("version", F.from_json("j", "k int")["k"].alias("k"))


@query("SELECT CAST(1 AS INT) AS id, max(event_id) // 2 AS last_processed_sequence FROM events")
def cursor_read(spark, d):
    return fx.entries(spark, d).agg(F.lit(1).alias("id"), F.expr("max(sequence_number) div 2").alias("last_processed_sequence"))


@query("SELECT sequence_number, CAST(status AS INT) AS status FROM f_entries WHERE sequence_number > 250 ORDER BY sequence_number LIMIT 300")
def cursor_next(spark, d):
    return lookups.cursor_next(fx.entries(spark, d), 250, 300)


@query("SELECT sequence_number FROM f_splits WHERE schema_id = 'en' AND split_id = sha256('src3')")
def split_lookup(spark, d):
    return lookups.split_lookup(fx.splits(spark, d), "en", _src3())


def _src3() -> str:
    from hashlib import sha256

    return sha256(b"src3").hexdigest()


@query("SELECT leaf_key, CAST(origin_tip AS BIGINT) AS origin_tip FROM f_leaves WHERE user_id % 4 <> 1", python=True)
def delta_buffer_load(spark, d):
    cut = F.when(F.col("user_id") % 4 == 1, F.lit(b"\x00\x02\x00")).otherwise(codecs.encode_tips(F.array(F.struct(F.lit(fx.LOG).alias("log_did"), F.col("origin_tip").alias("sequence")))))
    buffers = fx.leaves(spark, d).select(F.unhex("leaf_key").alias("leaf_key"), cut.alias("tip_history"))
    return lookups.decoded_deltas(buffers, codecs.decode_tips).select(F.lower(F.hex("leaf_key")).alias("leaf_key"), F.col("tips")[0]["sequence"].alias("origin_tip"))


@query("SELECT hash, state, sequence FROM f_journal WHERE sequence = 20")
def wal_read(spark, d):
    return fx.journal(spark, d).where("sequence = 20").select("hash", "state", "sequence")


@query("SELECT hash, attempts FROM f_journal WHERE state = 1")
def iterate_inflight(spark, d):
    return lookups.iterate_inflight(fx.journal(spark, d))


@query("SELECT sequence, hash FROM f_journal WHERE sequence > 100 AND state = 2")
def iterate_sequenced(spark, d):
    return lookups.iterate_sequenced(fx.journal(spark, d), 100)


@query("SELECT originator, lamport, kind, event_id FROM f_gossip WHERE event_id = (SELECT min(event_id) FROM f_gossip)")
def gossip_event_get(spark, d):
    g = fx.gossip(spark, d)
    return g.join(F.broadcast(g.agg(F.min("event_id").alias("event_id"))), "event_id").select("originator", "lamport", "kind", "event_id")


@query(f"SELECT a.o AS originator, coalesce(arg_max(event_id, lamport), '{fx.ZERO}') AS event_id, coalesce(max(lamport), 0) AS lamport FROM (SELECT 'did:conv:' || o_orderkey AS o FROM orders) a LEFT JOIN f_gossip ON originator = a.o GROUP BY 1")
def gossip_head(spark, d):
    asked = fx.table(spark, d, "orders").select(F.concat(F.lit("did:conv:"), F.col("o_orderkey").cast("string")).alias("originator"))
    return lookups.gossip_heads(fx.gossip(spark, d), asked)


@query("SELECT originator, lamport, event_id FROM f_gossip WHERE kind = 'assistant'")
def gossip_by_kind(spark, d):
    return lookups.gossip_iterate(fx.gossip(spark, d), kind="assistant").select("originator", "lamport", "event_id")


@query("SELECT originator, lamport, event_id FROM f_gossip WHERE originator = 'did:conv:3'")
def gossip_iterate(spark, d):
    return lookups.gossip_iterate(fx.gossip(spark, d), originator="did:conv:3").select("originator", "lamport", "event_id")


@query("SELECT originator, lamport, event_id FROM f_gossip WHERE originator > 'did:conv:3' OR (originator = 'did:conv:3' AND lamport > 1) ORDER BY originator, lamport LIMIT 100")
def gossip_since(spark, d):
    return lookups.gossip_since(fx.gossip(spark, d), "did:conv:3", 1, 100).select("originator", "lamport", "event_id")


@query("SELECT event_id, originator, lamport FROM f_gossip WHERE list_contains(bindings, sha256('4')) AND kind = 'user' AND lamport > 1")
def gossip_by_binding(spark, d):
    from hashlib import sha256

    return lookups.gossip_by_binding(fx.gossip(spark, d), sha256(b"4").hexdigest(), "user", 1).select("event_id", "originator", "lamport")


@query("SELECT originator, arg_max(event_id, lamport) AS event_id, max(lamport) AS lamport FROM f_gossip WHERE kind = 'assistant' GROUP BY 1")
def latest_sth(spark, d):
    return lookups.latest_of_kind(fx.gossip(spark, d), "assistant")


@query("SELECT sequence_number, signer_did FROM f_splits WHERE schema_id = 'fr' AND split_id = sha256('src3')")
def split_index_at(spark, d):
    s = fx.splits(spark, d)
    return s.where((F.col("schema_id") == "fr") & (F.col("split_id") == _src3())).select("sequence_number", "signer_did").orderBy("sequence_number")


@query("SELECT sequence_number, canonical_hash FROM f_documents WHERE schema_ref = 'de' AND source = 'src5'")
def entry_lookup_at(spark, d):
    return fx.documents(spark, d).where("schema_ref = 'de' and source = 'src5'").select("sequence_number", "canonical_hash").orderBy("sequence_number")


@query("SELECT schema_id, split_id, seq_a FROM (SELECT schema_id, split_id, min(sequence_number) AS seq_a FROM f_splits GROUP BY 1, 2) WHERE split_id = sha256('src1')")
def equiv_projection_get(spark, d):
    from hashlib import sha256

    return fx.splits(spark, d).where(F.col("split_id") == sha256(b"src1").hexdigest()).groupBy("schema_id", "split_id").agg(F.min("sequence_number").alias("seq_a"))


@query("""WITH a AS (SELECT DISTINCT lang AS schema_id, sha256(source) AS split_id FROM documents UNION SELECT 'en', sha256('nowhere') UNION SELECT 'fr', 'xyz' UNION SELECT 'en', sha256(source) FROM documents)
SELECT a.schema_id, a.split_id, count(s.sequence_number) AS n, CASE WHEN a.schema_id NOT IN ('en', 'fr', 'de') OR NOT regexp_full_match(a.split_id, '[0-9a-f]{64}') THEN 'refused' WHEN count(s.sequence_number) = 0 THEN 'missing' WHEN count(s.sequence_number) = 1 THEN 'ok' ELSE 'equivocation' END AS answer
FROM a LEFT JOIN f_splits s ON s.schema_id = a.schema_id AND s.split_id = a.split_id GROUP BY 1, 2""")
def commitment_lookup(spark, d):
    s = fx.splits(spark, d)
    more = spark.createDataFrame([("fr", "xyz")], "schema_id string, split_id string").unionByName(spark.range(1).select(F.lit("en").alias("schema_id"), F.sha2(F.lit("nowhere"), 256).alias("split_id")))
    asked = s.select("schema_id", "split_id").unionByName(more).unionByName(s.select(F.lit("en").alias("schema_id"), "split_id")).distinct()
    return lookups.commitment_lookup(s, asked, fx.SCHEMAS)


@query("SELECT count(*) AS present FROM f_entries WHERE canonical_hash IN (SELECT canonical_hash FROM f_entries WHERE sequence_number % 13 = 5)")
def present_hash_count(spark, d):
    e = fx.entries(spark, d)
    return lookups.present_count(e, e.where("sequence_number % 13 = 5"))


# Responses


@query("""SELECT sequence_number, canonical_hash, strftime(log_time, '%Y-%m-%dT%H:%M:%SZ') AS log_time, signer_did, octet_length(encode(text)) AS canonical_size, octet_length(encode(source)) AS payload_size FROM f_documents""")
def entry_response(spark, d):
    return shaping.entry_response(fx.documents(spark, d).withColumn("payload", F.col("source").cast("binary")))


@query("SELECT sequence_number, signer_did, target_root, cosignature_of, schema_ref, delegate_did FROM f_entries")
def header_rows(spark, d):
    e = fx.entries(spark, d)
    header = F.struct("signer_did", codecs.parse_position("target_root").alias("target_root"), codecs.parse_position("cosignature_of").alias("cosignature_of"), "schema_ref", F.coalesce("delegate_did", F.lit("")).alias("delegate_did"))
    return shaping.index_rows(e.select("sequence_number", header.alias("header")))


@query("""SELECT sequence_number, '{"log_did":"did:log:main","sequence":' || sequence_number || '}' AS position, schema_id, split_id FROM f_splits""")
def split_response(spark, d):
    return shaping.split_response(fx.splits(spark, d), fx.LOG)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"log_did":"did:log:main","sequence":' || event_id || '}' END AS position FROM events""")
def position_response(spark, d):
    i = F.col("event_id")
    return fx.table(spark, d, "events").select(i, shaping.position_response(F.when(i % 3 == 0, fx.LOG).otherwise(""), i).alias("position"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 AND event_type IN ('click', 'view') THEN event_type END AS schema_id FROM events")
def payload_schema(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    payload = F.when(i % 4 == 0, F.to_json(F.struct(t.alias("schema_id")))).when(i % 4 == 1, F.to_json(F.struct(i, t.alias("schema_id")))).when(i % 4 == 2, F.lit('{"other":1}')).otherwise(F.lit("{broken"))
    return fx.table(spark, d, "events").select(i, shaping.schema_id(payload, ["click", "view"]).alias("schema_id"))


@query("""SELECT id, '{"range_start_seq":' || range_start_seq || ',"range_end_seq":' || range_end_seq || ',"prior_root":"' || prior_root || '","post_root":"' || post_root || '"}' AS json FROM f_ranges""")
def commitment_response(spark, d):
    return shaping.commitment_response(fx.ranges(spark, d))


@query("""SELECT shard_did, '{"type":"genesis","shard_did":"' || shard_did || '","range_start_seq":' || range_start_seq || '}' AS payload FROM f_shards""")
def shard_genesis(spark, d):
    return shaping.genesis(fx.shards(spark, d))


@query("SELECT 'did:log:main' AS log_did, CAST(86400 AS INT) AS max_merge_delay_s, '1' AS version")
def log_info(spark, d):
    return shaping.log_info(spark, fx.LOG, 86400, "1")


@query("""SELECT '{"entries":[' || string_agg('{"canonical_hash":"' || canonical_hash || '","sequence_number":' || sequence_number || '}', ',' ORDER BY canonical_hash) || '],"count":' || count(*) || '}' AS json FROM f_entries WHERE sequence_number < 20""")
def entries_json(spark, d):
    return shaping.entries_json(lookups.scan_from(fx.entries(spark, d), 0, 20).select("canonical_hash", "sequence_number"))


@query("SELECT doc_id, CASE WHEN length(t) > 32 THEN substr(t, 1, 32) || '...' ELSE t END AS shown FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '?', 'g') AS t FROM documents)")
def log_safe_text(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", codecs.safe_text("text", 32).alias("shown"))


@query("SELECT tree_size, hash_algo, root_hash FROM f_heads ORDER BY tree_size DESC, hash_algo DESC LIMIT 1")
def latest_head(spark, d):
    return windows.latest_head(fx.heads(spark, d)).select("tree_size", "hash_algo", "root_hash")


@query("SELECT tree_size, hash_algo, root_hash FROM f_heads WHERE tree_size = 77 ORDER BY hash_algo LIMIT 1")
def head_by_size(spark, d):
    return windows.head_by_size(fx.heads(spark, d), 77).select("tree_size", "hash_algo", "root_hash")
