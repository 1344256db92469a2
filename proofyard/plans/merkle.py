"""Merkle trees, proofs and integrity audits (survey M). Trees are beyond SQL here: the tests verify every proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merkle as m
from . import fixtures as fx
from .registry import query


def _nodes(spark, d, n: int | None = None):
    e = fx.entries(spark, d)
    e = e if n is None else e.where(F.col("sequence_number") < n)
    return m.levels(e.select(F.col("sequence_number").alias("index"), m.leaf_hash(F.unhex("canonical_hash")).alias("hash")))


@query("""WITH RECURSIVE t AS (SELECT 0 AS level, list(from_hex(sha256(from_hex('00' || canonical_hash))) ORDER BY sequence_number) AS row FROM f_entries
UNION ALL SELECT level + 1, [CASE WHEN 2 * i + 1 < len(row) THEN from_hex(sha256(from_hex('01' || hex(row[2 * i + 1]) || hex(row[2 * i + 2])))) ELSE row[2 * i + 1] END FOR i IN range(0, (len(row) + 1) // 2)] FROM t WHERE len(row) > 1)
SELECT (SELECT count(*) FROM f_entries) AS size, lower(hex(row[1])) AS root FROM t WHERE len(row) = 1""")
def merkle_root(spark, d):
    return m.root(_nodes(spark, d))


@query()
def inclusion_proof(spark, d):
    n = fx.entries(spark, d).count()
    return m.proof(_nodes(spark, d), m.path_coordinates(n // 3, n))


@query()
def consistency_proof(spark, d):
    n = fx.entries(spark, d).count()
    return m.proof(_nodes(spark, d), m.consistency_coordinates(n * 2 // 3, n))


@query("""WITH RECURSIVE t AS (SELECT 0 AS level, list(from_hex(sha256(from_hex('00' || canonical_hash))) ORDER BY sequence_number) AS row FROM f_entries
UNION ALL SELECT level + 1, [CASE WHEN 2 * i + 1 < len(row) THEN from_hex(sha256(from_hex('01' || hex(row[2 * i + 1]) || hex(row[2 * i + 2])))) ELSE row[2 * i + 1] END FOR i IN range(0, (len(row) + 1) // 2)] FROM t WHERE len(row) > 1)
SELECT event_id AS position, lower(hex(row[1])) AS root FROM events, t WHERE len(row) = 1""")
def inclusion_of_every_leaf(spark, d):
    nodes, n = _nodes(spark, d), fx.entries(spark, d).count()
    return m.verify_paths(nodes.where("level = 0").select("index", "hash"), m.all_paths(nodes, n), n)


@query("SELECT level, count(*) AS nodes FROM (SELECT 0 AS level, event_id AS i FROM events UNION ALL SELECT g.level, i FROM (SELECT unnest(range(1, 9)) AS level) g, (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS i) x WHERE i < ceil((SELECT count(*) FROM events) / pow(2, g.level))) GROUP BY 1")
def tile_nodes(spark, d):
    return _nodes(spark, d).where("level <= 8").groupBy("level").agg(F.count("*").alias("nodes"))


@query(python=True)
def sparse_merkle_root(spark, d):
    leaves = fx.leaves(spark, d).select(F.unhex("leaf_key").alias("key"), F.col("origin_tip").cast("string").cast("binary").alias("value"))
    return m.sparse_root(leaves)


@query("SELECT 'leaf|' || i AS name, i IN (SELECT user_id FROM f_leaves) AS member FROM (SELECT unnest(range(0, 300, 7)) AS i)", python=True)
def sparse_membership(spark, d):
    from hashlib import sha256

    leaves = fx.leaves(spark, d).select(F.unhex("leaf_key").alias("key"), F.col("origin_tip").cast("string").cast("binary").alias("value"))
    names = {f"leaf|{i}": sha256(f"leaf|{i}".encode()).digest() for i in range(0, 300, 7)}
    asked = spark.createDataFrame([(n, k) for n, k in names.items()], "name string, key binary")
    return m.sparse_proofs(leaves, list(names.values())).join(asked, "key").select("name", "member")


@query("SELECT sequence_number, canonical_hash FROM f_documents WHERE sequence_number % 211 = 17")
def byte_integrity(spark, d):
    docs = fx.documents(spark, d).withColumn("data", F.when(F.col("sequence_number") % 211 == 17, F.concat("data", F.lit(b"x"))).otherwise(F.col("data")))
    return m.corrupted(docs).select("sequence_number", "canonical_hash")


@query("""SELECT 'did:log:main' AS originator, tree_size, least(root_hash, sha256(root_hash)) AS root_a, greatest(root_hash, sha256(root_hash)) AS root_b
FROM f_heads JOIN (SELECT tree_size, count(DISTINCT signer) AS k FROM f_sigs GROUP BY 1) USING (tree_size) WHERE k >= 3 AND tree_size % 50 = 1""")
def detect_equivocation(spark, d):
    signers = fx.sigs(spark, d).groupBy("tree_size").agg(F.countDistinct("signer").alias("signers"))
    h = fx.heads(spark, d).join(signers, "tree_size").select(F.lit(fx.LOG).alias("originator"), "tree_size", "root_hash", "signers")
    forged = h.where("tree_size % 50 = 1").withColumn("root_hash", F.sha2("root_hash", 256))
    return m.equivocations(h.unionByName(forged), 3)


@query("""SELECT g.sequence_number AS ghost_seq, g.canonical_hash <> repeat('0', 64) AND g.sequence_number > p.sequence_number AND g.sequence_number % 10 <> 3 AS valid
FROM f_documents g JOIN f_documents p USING (canonical_hash) WHERE g.status = 2 AND p.status <> 2""")
def ghost_validity(spark, d):
    docs = fx.documents(spark, d)
    g = docs.where("status = 2").select("canonical_hash", F.col("sequence_number").alias("ghost_seq")).join(docs.where("status <> 2").select("canonical_hash", F.col("sequence_number").alias("canonical_seq")), "canonical_hash")
    return m.valid_ghosts(g.withColumns({"log_did": F.lit(fx.LOG), "time_us": F.when(F.col("ghost_seq") % 10 == 3, 0).otherwise(1)})).select("ghost_seq", "valid")


@query("SELECT tree_size, hash_algo, 'did:log:foreign' AS source_log, sha256(root_hash || '|' || tree_size) AS anchor FROM f_heads")
def anchor_rows(spark, d):
    h = fx.heads(spark, d)
    return h.select("tree_size", "hash_algo", F.lit("did:log:foreign").alias("source_log"), F.sha2(F.concat_ws("|", "root_hash", F.col("tree_size").cast("string")), 256).alias("anchor"))


_ROOT = """WITH RECURSIVE t AS (SELECT 0 AS level, list(from_hex(sha256(from_hex('00' || canonical_hash))) ORDER BY sequence_number) AS row FROM f_entries
UNION ALL SELECT level + 1, [CASE WHEN 2 * i + 1 < len(row) THEN from_hex(sha256(from_hex('01' || hex(row[2 * i + 1]) || hex(row[2 * i + 2])))) ELSE row[2 * i + 1] END FOR i IN range(0, (len(row) + 1) // 2)] FROM t WHERE len(row) > 1)"""


@query(f"""{_ROOT} SELECT n AS size, '{fx.LOG}' || chr(10) || n || chr(10) || to_base64(row[1]) || chr(10) AS value, '{fx.LOG}' AS origin, lower(hex(row[1])) AS root FROM t, (SELECT count(*) AS n FROM f_entries) WHERE len(row) = 1""")
def checkpoint_publish(spark, d):
    """The head as a note, and what reading the note gives."""
    from ..sources.store import checkpoint_notes, parse_checkpoints

    notes = checkpoint_notes(m.root(_nodes(spark, d)), fx.LOG)
    return notes.join(parse_checkpoints(notes), "size")


@query("""SELECT sequence_number, CASE WHEN sequence_number % 100 < 40 THEN 'did:log:a' WHEN sequence_number % 100 < 80 THEN 'did:log:b' END AS shard_did,
CASE WHEN sequence_number % 100 >= 80 THEN 'no_shard' WHEN sequence_number % 17 = 4 THEN 'missing' WHEN sequence_number % 19 = 3 THEN 'corrupt' ELSE 'ok' END AS verdict FROM f_documents""")
def archived_entries(spark, d):
    """Entries of two archived shards by the index of their ranges, from their stores; some are lost or damaged there."""
    from ..sources.store import archived, read_shards, write_entries
    from .streams import folder

    path, i = folder(spark), F.col("sequence_number")
    # sequences are dealt out so that each shard has one range of places
    docs = fx.documents(spark, d).withColumn("place", i % 100 * 1_000_000 + i).select(F.col("place").alias("sequence_number"), "canonical_hash", "data", i.alias("own"))
    kept = docs.where("own % 17 <> 4").withColumn("data", F.when(F.col("own") % 19 == 3, F.concat("data", F.lit(b"x"))).otherwise(F.col("data"))).drop("own")
    ranges = {"a": (0, 40_000_000 - 1), "b": (40_000_000, 80_000_000 - 1)}
    for name, (lo, hi) in ranges.items():
        write_entries(kept.where(F.col("sequence_number").between(lo, hi)), f"{path}/{name}")
    listed = spark.createDataFrame([(f"did:log:{n}", lo, hi, f"{path}/{n}") for n, (lo, hi) in ranges.items()], "shard_did string, range_start_seq long, range_end_seq long, location string")
    listed.agg(F.to_json(F.collect_list(F.struct(*listed.columns))).alias("value")).coalesce(1).write.text(f"{path}/index")
    got = archived(spark, docs.select("sequence_number", "canonical_hash"), read_shards(spark, f"{path}/index"))
    return got.select(F.expr("sequence_number % 1000000").alias("sequence_number"), "shard_did", "verdict")


def rebuilt(index, bundles, objects):
    """(sequence_number, canonical_hash, verdict): each row of the index against its entry in the bundles of hashes and
    the hash of its whole bytes in the store; missing ones are corrupt."""
    from ..sources.store import bundle_entries

    rows = index.select("sequence_number", "canonical_hash").join(bundle_entries(bundles).select("sequence_number", F.lower(F.hex("data")).alias("entry")), "sequence_number", "left")
    rows = rows.join(objects.select("sequence_number", "canonical_hash", F.sha2("data", 256).alias("hashed")), ["sequence_number", "canonical_hash"], "left")
    ok = (F.col("entry") == F.col("canonical_hash")) & (F.col("hashed") == F.col("canonical_hash"))
    return rows.select("sequence_number", "canonical_hash", F.when(ok, "ok").otherwise("corrupt").alias("verdict"))


def hash_bundles(docs):
    """Bundles of entries that are 32-byte hashes, as in the log's tiles; bytes of any length lie in the store."""
    from ..functions.codecs import u_be

    body = F.unhex("canonical_hash")
    rows = docs.select("sequence_number", F.expr("sequence_number div 256").alias("index"), F.concat(u_be(F.octet_length(body), 2), body).alias("part"))
    parts = rows.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("sequence_number", "part"))).alias("p"))
    return parts.select("index", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["part"])).alias("data"))


@query("SELECT sequence_number, canonical_hash, CASE WHEN sequence_number % 211 = 17 THEN 'corrupt' ELSE 'ok' END AS verdict FROM f_documents", python=True)
def rebuild_projection(spark, d):
    """Entries' whole bytes from the store and their hashes from the bundles, read back and held against the index; of
    some the last byte is damaged in the store."""
    from ..sources.store import write_entries
    from .streams import folder

    docs, path = fx.documents(spark, d).select("sequence_number", "canonical_hash", "data"), folder(spark)
    last = F.when(F.col("data").substr(F.octet_length("data"), F.lit(1)) == F.lit(b"?"), F.lit(b"!")).otherwise(F.lit(b"?"))
    damaged = F.concat(F.col("data").substr(F.lit(1), F.greatest(F.octet_length("data") - 1, F.lit(0))), last)
    write_entries(docs.withColumn("data", F.when(F.col("sequence_number") % 211 == 17, damaged).otherwise(F.col("data"))), path)
    return rebuilt(docs, hash_bundles(docs), spark.read.parquet(path))
