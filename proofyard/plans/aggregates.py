"""Aggregates (survey A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from . import fixtures as fx
from .registry import query

_CASE = "CASE WHEN us < 1000 THEN 0 WHEN us < 5000 THEN 1 WHEN us < 10000 THEN 2 WHEN us < 50000 THEN 3 WHEN us < 100000 THEN 4 WHEN us < 500000 THEN 5 WHEN us < 1000000 THEN 6 ELSE 7 END"


@query("SELECT count(*) AS leaves FROM f_leaves")
def leaf_count(spark, d):
    return a.leaf_count(fx.leaves(spark, d))


@query("SELECT greatest(coalesce(max(sequence_number), 0) - 100, 0) AS lag FROM f_holed")
def cursor_lag(spark, d):
    return a.cursor_lag(fx.holed(spark, d), 100)


@query("SELECT coalesce(max(sequence_number), -1) + 1 AS next_seq FROM f_holed")
def next_expected_seq(spark, d):
    return a.next_expected_seq(fx.holed(spark, d))


@query("""SELECT count(*) AS total, count(*) FILTER (status = 2) AS ghosts, count(*) FILTER (status <> 2) AS primaries, min(sequence_number) AS first_seq, max(sequence_number) AS last_seq,
max(sequence_number) + 1 - count(*) AS gaps, 100 - count(*) FILTER (status = 2) AS leapfrog FROM f_documents""")
def conservation_counts(spark, d):
    return a.conservation_counts(fx.documents(spark, d), cursor=149, leaves=50)


@query("SELECT tree_size, hash_algo, root_hash, signers FROM f_heads JOIN (SELECT tree_size, hash_algo, count(DISTINCT signer) AS signers FROM f_sigs GROUP BY 1, 2) USING (tree_size, hash_algo) WHERE signers >= 3")
def quorum_heads(spark, d):
    return a.quorum_heads(fx.heads(spark, d), fx.sigs(spark, d), 3).select("tree_size", "hash_algo", "root_hash", "signers")


@query("""SELECT tree_size, hash_algo, root_hash FROM f_heads JOIN (SELECT tree_size, hash_algo FROM f_sigs GROUP BY 1, 2 HAVING count(DISTINCT signer) >= 3) USING (tree_size, hash_algo) ORDER BY tree_size DESC, hash_algo DESC LIMIT 1""")
def latest_cosigned(spark, d):
    from ..operators.windows import latest_head

    return latest_head(a.quorum_heads(fx.heads(spark, d), fx.sigs(spark, d), 3)).select("tree_size", "hash_algo", "root_hash")


@query("SELECT count(*) AS total, count(DISTINCT canonical_hash) AS distinct_hashes, count(*) FILTER (status <> 2) AS primaries, count(DISTINCT canonical_hash) FILTER (status <> 2) AS distinct_primaries FROM f_documents")
def hash_distinctness(spark, d):
    return a.hash_distinctness(fx.documents(spark, d))


@query("SELECT count(*) AS n, min(sequence_number) AS lo, max(sequence_number) AS hi, min(sequence_number) = 0 AND max(sequence_number) = count(*) - 1 AS contiguous FROM f_holed")
def min_max_contiguity(spark, d):
    return a.min_max_contiguity(fx.holed(spark, d))


@query("SELECT count(*) AS events, count(DISTINCT originator) AS originators, max(lamport) AS highest FROM f_gossip")
def gossip_stats(spark, d):
    return a.gossip_stats(fx.gossip(spark, d))


@query(f"SELECT {_CASE} AS bucket, count(*) AS n FROM f_latency GROUP BY 1")
def latency_histogram(spark, d):
    return a.latency_histogram(fx.latency(spark, d))


@query("SELECT count(*) AS n, CAST(sum(us) AS BIGINT) AS total, min(us) AS least, max(us) AS most, CAST(sum(us) // count(*) AS BIGINT) AS mean FROM f_latency")
def latency_summary(spark, d):
    return a.latency_summary(fx.latency(spark, d))


@query(f"""WITH h AS (SELECT {_CASE} AS bucket, count(*) AS n FROM f_latency GROUP BY 1), r AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS running, sum(n) OVER () AS total FROM h)
SELECT min(bucket) AS bucket, [1000, 5000, 10000, 50000, 100000, 500000, 1000000][min(bucket) + 1]::BIGINT AS p99_us FROM r WHERE running >= total - total // 100""")
def approx_p99(spark, d):
    return a.approx_p99(a.latency_histogram(fx.latency(spark, d)))


_QUANTILES = """(WITH s AS (SELECT us, row_number() OVER (ORDER BY us) - 1 AS i, count(*) OVER () AS n FROM {}), p(per_mille) AS (VALUES (500), (950), (990), (999))
SELECT per_mille, us AS value FROM s, p WHERE i = least(n * per_mille // 1000, n - 1))"""


@query("SELECT * FROM " + _QUANTILES.format("f_latency"))
def nearest_rank_quantiles(spark, d):
    return a.nearest_rank_quantiles(fx.latency(spark, d))


@query()
def reservoir_quantiles(spark, d):
    return a.nearest_rank_quantiles(a.reservoir(fx.latency(spark, d), "event_id", 500))


@query(f"""SELECT n.per_mille, n.value AS now, b.value AS base, CASE WHEN b.value = 0 THEN 0.0 ELSE round((n.value - b.value) * 100.0 / b.value, 6) END AS change
FROM {_QUANTILES.format("f_latency")} n JOIN {_QUANTILES.format("(SELECT us FROM f_latency WHERE event_id % 2 = 0)")} b USING (per_mille)""")
def baseline_delta(spark, d):
    s = fx.latency(spark, d)
    return a.baseline_delta(a.nearest_rank_quantiles(s), a.nearest_rank_quantiles(s.where("event_id % 2 = 0")), "per_mille", "value")


@query("SELECT count(*) AS submitted, count(*) FILTER (state = 3) AS drained, count(*) FILTER (state = 4) AS failed, count(*) / 10 >= 20 AND count(*) FILTER (state = 3) / 10 >= 10 AND count(*) FILTER (state = 4) / count(*) <= 0.001 AS ok FROM f_journal")
def throughput_rates(spark, d):
    return a.throughput(fx.journal(spark, d), 10, 20, 10, 0.001)


@query("SELECT event_type AS error_class, CAST(400 + event_id % 3 AS INT) AS http_status, count(*) AS n FROM events GROUP BY 1, 2")
def error_counts(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("error_class"), (F.col("event_id") % 3 + 400).cast("int").alias("http_status"))
    return a.counts_by(e, "error_class", "http_status")


@query("SELECT bool_or(event_id % 29 = 3) AS any_503, count(*) FILTER (event_id % 29 = 3) AS n_503, bool_or(event_id % 58 = 3) AS any_retry_after FROM events")
def backpressure_obs(spark, d):
    i = F.col("event_id")
    return a.backpressure(fx.table(spark, d, "events").select(F.when(i % 29 == 3, 503).otherwise(202).alias("status"), F.when(i % 58 == 3, "1").alias("retry_after")))


@query("SELECT sequence_number // 500 AS batch, count(*) FILTER (status = 0) AS live, count(*) FILTER (status = 1) AS tombstones, count(*) FILTER (status = 2) AS ghosts FROM f_entries GROUP BY 1")
def tombstone_count(spark, d):
    return a.status_counts(fx.entries(spark, d), 500)


@query("SELECT 'documents' AS name, count(*) AS rows, CAST(5 AS INT) AS columns, CAST(0 AS BIGINT) AS dead_rows FROM documents")
def table_sizes(spark, d):
    return a.table_sizes(fx.table(spark, d, "documents"), "documents")


@query("SELECT CAST(max(sequence_number) FILTER (state = 1) AS BIGINT) AS last_pending, count(*) FILTER (state = 1) AS pending, count(*) FILTER (state = 2) AS sequenced, count(*) FILTER (state = 3) AS shipped, count(*) FILTER (state = 4) AS manual FROM (SELECT sequence AS sequence_number, state FROM f_journal)")
def pipeline_gauges(spark, d):
    s = F.col("state")
    return fx.journal(spark, d).agg(F.max(F.when(s == 1, F.col("sequence"))).alias("last_pending"), *[F.count_if(s == i).alias(n) for i, n in ((1, "pending"), (2, "sequenced"), (3, "shipped"), (4, "manual"))])
