"""Joins (survey J, and S where stores are joined)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from . import fixtures as fx
from .registry import query


@query("SELECT sequence_number, canonical_hash, octet_length(encode(text)) AS n_bytes FROM f_documents WHERE schema_ref = 'de'")
def hydrate(spark, d):
    docs = fx.documents(spark, d)
    return joins.hydrate(docs.where("schema_ref = 'de'").select("sequence_number", "canonical_hash"), docs.select("sequence_number", "canonical_hash", F.octet_length("data").cast("long").alias("n_bytes")))


@query("SELECT sequence_number, CASE WHEN sequence_number % 2 = 0 THEN 'journal' WHEN sequence_number % 3 = 0 THEN 'store' END AS origin, CASE WHEN sequence_number % 2 = 0 OR sequence_number % 3 = 0 THEN sha256(text) END AS data_hash FROM f_documents WHERE status = 0")
def wal_then_store(spark, d):
    docs = fx.documents(spark, d).where("status = 0")
    found = joins.first_hit(docs.select("sequence_number", "canonical_hash"), docs.where("sequence_number % 2 = 0"), docs.where("sequence_number % 3 = 0"))
    return found.select("sequence_number", "origin", F.sha2("data", 256).alias("data_hash"))


@query("SELECT sequence_number, schema_id, split_id, canonical_hash FROM f_splits JOIN f_documents USING (sequence_number) WHERE schema_id = 'en'")
def commitment_entries(spark, d):
    s = fx.splits(spark, d).where("schema_id = 'en'").select("sequence_number", "schema_id", "split_id")
    return joins.commitment_entries(s, fx.documents(spark, d).select("sequence_number", "canonical_hash"))


@query("SELECT sequence_number, split_id, canonical_hash FROM f_splits JOIN f_documents USING (sequence_number) WHERE sequence_number > 50 ORDER BY sequence_number LIMIT 200")
def replay_batch(spark, d):
    return joins.commitment_entries(fx.splits(spark, d).select("sequence_number", "split_id"), fx.documents(spark, d).select("sequence_number", "canonical_hash"), 50, 200)


@query("SELECT g.sequence_number AS ghost_seq, p.sequence_number AS primary_seq FROM f_documents g JOIN f_documents p USING (canonical_hash) WHERE g.status = 2 AND p.status <> 2")
def ghost_redirect(spark, d):
    return joins.ghost_redirect(fx.documents(spark, d))


@query("""SELECT h.tree_size, h.hash_algo, CAST(count(signer) AS BIGINT) AS sigs, min(signer) AS first_signer, max(signer) AS last_signer, arg_min(signature, struct_pack(a := -sig_algo, b := signer, c := sig_algo, d := signature)) AS top_signature
FROM f_heads h LEFT JOIN f_sigs s ON s.tree_size = h.tree_size AND s.hash_algo = h.hash_algo GROUP BY 1, 2""")
def heads_with_sigs(spark, d):
    rows = joins.heads_with_sigs(fx.heads(spark, d), fx.sigs(spark, d))
    signers = F.transform("sigs", lambda x: x["signer"])
    n = F.when(F.col("sigs").isNotNull(), F.size("sigs")).otherwise(0).cast("long")
    return rows.select("tree_size", "hash_algo", n.alias("sigs"), F.array_min(signers).alias("first_signer"), F.array_max(signers).alias("last_signer"), F.get(F.col("sigs"), F.lit(0))["signature"].alias("top_signature"))


@query("""SELECT sequence_number, id, range_start_seq, range_end_seq FROM f_entries, f_ranges WHERE sequence_number BETWEEN range_start_seq AND range_end_seq
QUALIFY row_number() OVER (PARTITION BY sequence_number ORDER BY created_at DESC, id DESC) = 1""")
def covering_commitment(spark, d):
    return joins.covering(fx.entries(spark, d).select("sequence_number"), fx.ranges(spark, d))


@query("""WITH p AS (SELECT CASE WHEN sequence_number % 4 = 0 THEN 'did:log:shard1' ELSE 'did:log:main' END AS log_did, sequence_number FROM f_entries)
SELECT p.log_did, p.sequence_number, coalesce(e.shard_did, r.shard_did) AS shard_did, CASE WHEN e.shard_did IS NOT NULL THEN 'exact' WHEN r.shard_did IS NOT NULL THEN 'range' ELSE 'none' END AS how
FROM p LEFT JOIN f_shards e ON e.shard_did = p.log_did LEFT JOIN f_shards r ON p.sequence_number BETWEEN r.range_start_seq AND r.range_end_seq""")
def resolve_shard(spark, d):
    p = fx.entries(spark, d).select(F.when(F.col("sequence_number") % 4 == 0, "did:log:shard1").otherwise(fx.LOG).alias("log_did"), "sequence_number")
    return joins.resolve_shard(p, fx.shards(spark, d))


@query("SELECT event_id AS sequence_number FROM events WHERE event_id % 97 = 13")
def missing_leaves(spark, d):
    return joins.missing(fx.entries(spark, d), fx.holed(spark, d), "sequence_number")


@query("SELECT h.canonical_hash, sequence_number AS existing_seq FROM (SELECT DISTINCT canonical_hash FROM f_documents WHERE status = 2) h JOIN f_documents d ON d.canonical_hash = h.canonical_hash AND d.status <> 2")
def delta_existing(spark, d):
    docs = fx.documents(spark, d)
    return joins.existing(docs.where("status = 2").select("canonical_hash").distinct(), docs)


@query("SELECT sequence, CASE WHEN sequence % 50 = 5 OR sequence % 60 = 7 THEN 'skipped' WHEN sequence % 40 = 9 THEN 'diverged' ELSE 'equal' END AS verdict FROM f_journal WHERE NOT (sequence % 50 = 5 AND sequence % 60 = 7)")
def wal_vs_tree(spark, d):
    j = fx.journal(spark, d).select("sequence", "hash")
    tree = j.where("sequence % 60 <> 7").withColumn("hash", F.when(F.col("sequence") % 40 == 9, F.sha2("hash", 256)).otherwise(F.col("hash")))
    return joins.wal_vs_tree(j.where("sequence % 50 <> 5"), tree)


@query("SELECT o_orderkey AS committed_through_seq, CASE WHEN o_orderkey % 30 = 4 THEN 'no head' WHEN o_orderkey % 20 = 3 THEN 'diverged' ELSE 'equal' END AS verdict FROM orders")
def root_vs_head(spark, d):
    o = F.col("o_orderkey")
    roots = fx.table(spark, d, "orders").select(o.alias("committed_through_seq"), F.sha2(F.concat(F.when(o % 20 == 3, "bad|").otherwise("smt|"), o.cast("string")), 256).alias("current_root"))
    return joins.root_vs_head(roots, fx.heads(spark, d).where("(tree_size - 1) % 30 <> 4"))


@query("SELECT 'did:log:' || (tree_size % 3) AS originator, tree_size, root_hash AS root_a, sha256(root_hash) AS root_b FROM f_heads WHERE tree_size % 111 = 5")
def local_vs_peer_head(spark, d):
    h = fx.heads(spark, d).select(F.concat(F.lit("did:log:"), (F.col("tree_size") % 3).cast("string")).alias("originator"), "tree_size", "root_hash")
    return joins.head_conflicts(h, h.withColumn("root_hash", F.when(F.col("tree_size") % 111 == 5, F.sha2("root_hash", 256)).otherwise(F.col("root_hash"))))


@query("""SELECT e.sequence_number, t.sequence_number AS primary_seq, t.schema_ref AS primary_schema, coalesce(list_sort(list(DISTINCT c.signer_did) FILTER (c.signer_did IS NOT NULL)), []) AS cosigners
FROM f_entries e JOIN f_entries t ON t.position = e.target_root LEFT JOIN f_entries c ON c.status = 0 AND c.cosignature_of = e.target_root GROUP BY 1, 2, 3""")
def policy_candidates(spark, d):
    return joins.policy_candidates(fx.entries(spark, d))


@query("""SELECT e.sequence_number, e.signer_did, max(g.sequence_number) AS delegation_seq FROM f_entries e JOIN f_entries g ON g.delegate_did = e.signer_did AND g.status = 0 AND g.sequence_number < e.sequence_number
WHERE e.status = 0 GROUP BY 1, 2""")
def delegation_resolve(spark, d):
    return joins.delegation_of(fx.entries(spark, d))


@query("""SELECT e.sequence_number, CASE WHEN NOT starts_with(e.cosignature_of, 'did:log:main:') THEN 'foreign' WHEN t.sequence_number % 97 <> 13 THEN 'bound' ELSE 'unbound' END AS verdict
FROM f_entries e LEFT JOIN f_entries t ON t.position = e.cosignature_of WHERE e.cosignature_of IS NOT NULL AND e.sequence_number % 97 <> 13""")
def cosig_binding(spark, d):
    return joins.cosig_binding(fx.holed(spark, d), fx.LOG)


@query("""SELECT CAST(coalesce(w.state, 0) AS INT) AS state, i.h IS NOT NULL AS indexed, count(*) AS n FROM (SELECT * FROM f_journal WHERE sequence % 4 <> 0) w
FULL JOIN (SELECT canonical_hash AS h FROM f_documents WHERE status <> 2 AND sequence_number % 7 <> 3) i ON w.hash = i.h GROUP BY 1, 2""")
def wal_index_outer(spark, d):
    return joins.wal_index_outer(fx.journal(spark, d).where("sequence % 4 <> 0"), fx.documents(spark, d).where("sequence_number % 7 <> 3"))


@query("""SELECT sequence_number, canonical_hash, 'a' AS side FROM f_entries WHERE sequence_number % 500 = 8 UNION ALL SELECT sequence_number, sha256(canonical_hash), 'b' FROM f_entries WHERE sequence_number % 500 = 8""")
def writer_vs_reader(spark, d):
    e = fx.entries(spark, d).select("sequence_number", "canonical_hash")
    return joins.differences(e, e.withColumn("canonical_hash", F.when(F.col("sequence_number") % 500 == 8, F.sha2("canonical_hash", 256)).otherwise(F.col("canonical_hash"))))


@query("SELECT canonical_hash FROM f_documents WHERE source = 'src1' EXCEPT SELECT canonical_hash FROM f_documents WHERE source <> 'src1'")
def set_difference(spark, d):
    docs = fx.documents(spark, d)
    return docs.where("source = 'src1'").select("canonical_hash").subtract(docs.where("source <> 'src1'").select("canonical_hash"))


@query("SELECT sequence_number, canonical_hash FROM f_documents WHERE sequence_number IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def membership(spark, d):
    asked = fx.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sequence_number"))
    return fx.documents(spark, d).select("sequence_number", "canonical_hash").join(asked, "sequence_number", "left_semi")
