"""The supplied tables seen as a log's, and the same as SQL: every fixture is a function here and a view in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "did:log:main"
ZERO = "0" * 64
SCHEMAS = ["en", "fr", "de"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries: dense sequences; some target, cosign or delegate; one in 53 is a tombstone."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    at = lambda x: F.concat(F.lit(LOG + ":"), x.cast("string"))
    return e.select(
        i.alias("sequence_number"), F.col("ts").alias("log_time"), _sha(i, F.col("user_id"), F.col("event_type")).alias("canonical_hash"),
        F.concat(F.lit("did:user:"), F.col("user_id").cast("string")).alias("signer_did"), F.col("event_type").alias("schema_ref"),
        at(i).alias("position"), F.when(i % 7 == 3, at(i - 3)).alias("target_root"),
        F.when(i % 5 == 4, F.when(i % 15 == 14, F.concat(F.lit("did:log:other:"), i.cast("string"))).otherwise(at(i - 4))).alias("cosignature_of"),
        F.when(i % 11 == 0, F.concat(F.lit("did:user:"), ((F.col("user_id") + 1) % 150).cast("string"))).alias("delegate_did"),
        F.when(i % 53 == 7, 1).otherwise(0).alias("status"), F.col("user_id"))


def holed(spark: SparkSession, d: str) -> DataFrame:
    """Entries with holes."""
    return entries(spark, d).where("sequence_number % 97 <> 13")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries: of the rows with one text the first is primary, the rest are ghosts."""
    t = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("canonical_hash"), F.col("text").cast("binary").alias("data"))
    first = t.groupBy("canonical_hash").agg(F.min("doc_id").alias("first"))
    return t.join(first, "canonical_hash").select(
        F.col("doc_id").alias("sequence_number"), "canonical_hash", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).cast("timestamp_ntz").alias("log_time"),
        F.concat(F.lit("did:lang:"), F.col("lang")).alias("signer_did"), F.col("lang").alias("schema_ref"), F.concat(F.lit("did:src:"), F.col("source")).alias("delegate_did"),
        F.when(F.col("doc_id") == F.col("first"), 0).otherwise(2).alias("status"), "source", "data")


def journal(spark: SparkSession, d: str) -> DataFrame:
    """The journal of the primaries: shipped, sequenced, pending or manual by the last digit."""
    i = F.col("sequence_number")
    state = F.when(i % 10 < 6, 3).when(i % 10 < 8, 2).when(i % 10 == 8, 1).otherwise(4)
    return documents(spark, d).where("status = 0").select(F.col("canonical_hash").alias("hash"), i.alias("sequence"), state.alias("state"), (i % 12).cast("int").alias("attempts"), (i * 1000).alias("last_err_ns"))


def gossip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chains of events."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", _sha(F.col("conv_id"), F.col("turn"), F.col("role")).alias("event_id"))
    prev = F.lag("event_id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select(
        F.concat(F.lit("did:conv:"), F.col("conv_id").cast("string")).alias("originator"), (F.col("turn") + 1).alias("lamport"), F.col("role").alias("kind"), "event_id",
        F.coalesce(prev, F.lit(ZERO)).alias("prev_hash"), F.array(_sha(F.col("role")), _sha(F.col("conv_id") % 10)).alias("bindings"))


def heads(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (o + 1).alias("tree_size"), (o % 2 + 1).cast("int").alias("hash_algo"), _sha(F.lit("root"), o).alias("root_hash"), _sha(F.lit("smt"), o).alias("smt_root"), F.col("o_orderdate").alias("created_at"))


def sigs(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        (o + 1).alias("tree_size"), (o % 2 + 1).cast("int").alias("hash_algo"), F.concat(F.lit("did:witness:"), F.col("l_suppkey").cast("string")).alias("signer"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("sig_algo"), _sha(o, F.col("l_linenumber")).alias("signature"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """A commitment for each block of 1000 sequences, and a later one for every second block."""
    blocks = table(spark, d, "events").groupBy(F.expr("event_id div 1000").alias("b")).agg(F.max("event_id").alias("range_end_seq"), F.max("ts").alias("created_at"))
    one = blocks.select(F.col("b").alias("id"), (F.col("b") * 1000).alias("range_start_seq"), "range_end_seq", "created_at")
    two = one.where("id % 2 = 0").withColumn("id", F.col("id") + 100_000)
    return one.unionByName(two).withColumns({"prior_root": _sha(F.lit("r"), F.col("range_start_seq")), "post_root": _sha(F.lit("r"), F.col("range_end_seq") + 1)})


def splits(spark: SparkSession, d: str) -> DataFrame:
    """Documents as split commitments: by language and source; a signer for every third document."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("sequence_number"), F.col("lang").alias("schema_id"), F.sha2("source", 256).alias("split_id"), F.concat(F.lit("did:s:"), (i % 3).cast("string")).alias("signer_did"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("origin_tip"), F.min("event_id").alias("authority_tip")).select(_sha(F.lit("leaf"), F.col("user_id")).alias("leaf_key"), "origin_tip", "authority_tip", "user_id")


def credits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.concat(F.lit("did:x:"), F.col("c_custkey").cast("string")).alias("exchange_did"), F.greatest(F.floor(F.col("c_acctbal") / 1000), F.lit(0)).cast("long").alias("balance"),
        F.lit(10).cast("long").alias("total_purchased"), F.lit(0).cast("long").alias("total_consumed"), F.col("c_custkey"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("did:x:"), F.col("o_custkey").cast("string")).alias("exchange_did"), "o_orderkey")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 5 <> 0").select(_sha(F.lit("tok"), k).alias("token"), F.concat(F.lit("did:x:"), k.cast("string")).alias("exchange_did"), F.timestamp_seconds(1_700_000_000 + k * 3600).cast("timestamp_ntz").alias("expires_at"))


def latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.floor(F.col("value") * 1000)).cast("long").alias("us"))


def shards(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.expr("event_id div 2500").alias("b")).agg(F.max("event_id").alias("range_end_seq"))
    return n.where("b % 3 <> 2").select(F.concat(F.lit("did:log:shard"), F.col("b").cast("string")).alias("shard_did"), (F.col("b") * 2500).alias("range_start_seq"), "range_end_seq")


SQL = {
    "entries": f"""SELECT event_id AS sequence_number, ts AS log_time, sha256(concat_ws('|', event_id, user_id, event_type)) AS canonical_hash, 'did:user:' || user_id AS signer_did,
  event_type AS schema_ref, '{LOG}:' || event_id AS position, CASE WHEN event_id % 7 = 3 THEN '{LOG}:' || (event_id - 3) END AS target_root,
  CASE WHEN event_id % 5 = 4 THEN CASE WHEN event_id % 15 = 14 THEN 'did:log:other:' || event_id ELSE '{LOG}:' || (event_id - 4) END END AS cosignature_of,
  CASE WHEN event_id % 11 = 0 THEN 'did:user:' || ((user_id + 1) % 150) END AS delegate_did, CASE WHEN event_id % 53 = 7 THEN 1 ELSE 0 END AS status, user_id FROM events""",
    "holed": "SELECT * FROM f_entries WHERE sequence_number % 97 <> 13",
    "documents": """SELECT doc_id AS sequence_number, sha256(text) AS canonical_hash, make_timestamp((1700000000 + doc_id) * 1000000) AS log_time, 'did:lang:' || lang AS signer_did, lang AS schema_ref,
  'did:src:' || source AS delegate_did, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 0 ELSE 2 END AS status, source, text FROM documents""",
    "journal": """SELECT canonical_hash AS hash, sequence_number AS sequence, CASE WHEN sequence_number % 10 < 6 THEN 3 WHEN sequence_number % 10 < 8 THEN 2 WHEN sequence_number % 10 = 8 THEN 1 ELSE 4 END AS state,
  CAST(sequence_number % 12 AS INT) AS attempts, sequence_number * 1000 AS last_err_ns FROM f_documents WHERE status = 0""",
    "gossip": f"""SELECT 'did:conv:' || conv_id AS originator, turn + 1 AS lamport, role AS kind, event_id, coalesce(lag(event_id) OVER (PARTITION BY conv_id ORDER BY turn), '{ZERO}') AS prev_hash,
  [sha256(role), sha256(CAST(conv_id % 10 AS VARCHAR))] AS bindings FROM (SELECT *, sha256(concat_ws('|', conv_id, turn, role)) AS event_id FROM conversations)""",
    "heads": "SELECT o_orderkey + 1 AS tree_size, CAST(o_orderkey % 2 + 1 AS INT) AS hash_algo, sha256('root|' || o_orderkey) AS root_hash, sha256('smt|' || o_orderkey) AS smt_root, o_orderdate AS created_at FROM orders",
    "sigs": "SELECT l_orderkey + 1 AS tree_size, CAST(l_orderkey % 2 + 1 AS INT) AS hash_algo, 'did:witness:' || l_suppkey AS signer, CAST(l_linenumber % 2 + 1 AS INT) AS sig_algo, sha256(l_orderkey || '|' || l_linenumber) AS signature FROM lineitem",
    "ranges": """SELECT *, sha256('r|' || range_start_seq) AS prior_root, sha256('r|' || (range_end_seq + 1)) AS post_root FROM (
  SELECT event_id // 1000 AS id, event_id // 1000 * 1000 AS range_start_seq, max(event_id) AS range_end_seq, max(ts) AS created_at FROM events GROUP BY 1, 2
  UNION ALL SELECT event_id // 1000 + 100000, event_id // 1000 * 1000, max(event_id), max(ts) FROM events WHERE event_id // 1000 % 2 = 0 GROUP BY 1, 2)""",
    "splits": "SELECT doc_id AS sequence_number, lang AS schema_id, sha256(source) AS split_id, 'did:s:' || (doc_id % 3) AS signer_did FROM documents",
    "leaves": "SELECT sha256('leaf|' || user_id) AS leaf_key, max(event_id) AS origin_tip, min(event_id) AS authority_tip, user_id FROM events GROUP BY user_id",
    "credits": "SELECT 'did:x:' || c_custkey AS exchange_did, CAST(greatest(floor(c_acctbal / 1000), 0) AS BIGINT) AS balance, CAST(10 AS BIGINT) AS total_purchased, CAST(0 AS BIGINT) AS total_consumed, c_custkey FROM customer",
    "requests": "SELECT 'did:x:' || o_custkey AS exchange_did, o_orderkey FROM orders",
    "sessions": "SELECT sha256('tok|' || c_custkey) AS token, 'did:x:' || c_custkey AS exchange_did, make_timestamp((1700000000 + c_custkey * 3600) * 1000000) AS expires_at FROM customer WHERE c_custkey % 5 <> 0",
    "latency": "SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS us FROM events",
    "shards": "SELECT 'did:log:shard' || b AS shard_did, b * 2500 AS range_start_seq, range_end_seq FROM (SELECT event_id // 2500 AS b, max(event_id) AS range_end_seq FROM events GROUP BY 1) WHERE b % 3 <> 2",
}


def sql(body: str) -> str:
    """`body` with the fixtures that it names as f_<name> before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if f"f_{name}" in text and name not in needed:
                need(SQL[name])
                needed.append(name)

    need(body)
    views = ", ".join(f"f_{name} AS ({SQL[name]})" for name in needed)
    body = body.strip()
    if not views:
        return body
    recursive, rest = ("RECURSIVE ", body[15:]) if body.startswith("WITH RECURSIVE ") else ("", body[5:] if body.startswith("WITH ") else "")
    return f"WITH {recursive}{views}, {rest}" if rest else f"WITH {views} {body}"
