"""The streaming loops run to their end over the supplied tables (survey R, S13-S16): a batch of rows as a stream must give
what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state, windows
from ..saving import saved
from ..streaming import loops
from . import fixtures as fx
from .admission import submissions
from .registry import query

ROWS = 250_000  # of a batch that one task writes


def folder(spark: SparkSession) -> str:
    """A new folder where all executors see it: under the warehouse unless a shared one is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/streams/{uuid.uuid4().hex}"


def as_stream(df: DataFrame, path: str, order: str, parts: int = 3) -> DataFrame:
    """Rows written as `parts` batches one after the other, by ranges of `order`, and read back as a stream of these
    batches in the order of writing. The rows are computed once, by all tasks. Each batch is as many files, one unless there
    are more than ROWS rows a batch; where a task has none to write, an empty file stands for its."""
    spark = df.sparkSession
    df = saved(df)
    files = max(1, -(-df.count() // (parts * ROWS)))
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if df.schema[order].dataType.simpleString() != "string" else []
    edges = [float("-inf"), *cuts, float("inf")]
    for batch, (lo, hi) in enumerate(zip(edges, edges[1:])):
        rows = df.where((F.col(order) > lo) & (F.col(order) <= hi))
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.sortWithinPartitions(order).write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
        for _ in range(len(spark.read.schema(df.schema).parquet(path).inputFiles()), (batch + 1) * files):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All rows that an appending stream gives, after it has run out of input."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT 'did:log:' || (sequence_number % 3) AS log_did, sequence_number // 3 AS sequence_number, canonical_hash FROM f_entries")
def stream_commit_ordered(spark, d):
    path = folder(spark)
    i = F.col("sequence_number")
    staged = fx.entries(spark, d).select(F.concat(F.lit("did:log:"), (i % 3).cast("string")).alias("log_did"), F.expr("sequence_number div 3").alias("sequence_number"), "canonical_hash", F.xxhash64(i).alias("o"))
    loops.commit(as_stream(staged, path + "/in", order="o").drop("o"), path + "/out", path + "/state").awaitTermination()
    return loops.committed(spark, path + "/out")


@query("SELECT originator, event_id, lamport, 'appended' AS verdict FROM f_gossip", python=True)
def stream_gossip_append(spark, d):
    path = folder(spark)
    return drained(loops.append_gossip(as_stream(fx.gossip(spark, d), path + "/in", order="lamport")), path)


@query("""SELECT schema_id, split_id, a AS seq_a, b AS seq_b FROM (SELECT schema_id, split_id, sequence_number AS a, lead(sequence_number) OVER v AS b, signer_did AS s, lead(signer_did) OVER v AS t, row_number() OVER v AS r
FROM f_splits WINDOW v AS (PARTITION BY schema_id, split_id ORDER BY sequence_number)) WHERE r = 1 AND s = t""", python=True)
def stream_equivocation_scan(spark, d):
    path = folder(spark)
    return drained(loops.scan_equivocations(as_stream(fx.splits(spark, d), path + "/in", order="sequence_number")), path)


@query("SELECT row_number() OVER (ORDER BY o) - 1 AS sequence_number, canonical_hash FROM (SELECT canonical_hash, min(sequence_number) AS o FROM f_documents GROUP BY 1)")
def stream_sequence(spark, d):
    path = folder(spark)
    docs = fx.documents(spark, d).select(F.col("sequence_number").alias("ord"), "canonical_hash")
    loops.sequence(as_stream(docs, path + "/in", order="ord"), path + "/out", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/out").select("sequence_number", "canonical_hash")


@query("SELECT sequence_number, sequence_number % 5 <> 0 AS accepted FROM f_entries")
def stream_admit(spark, d):
    path = folder(spark)
    judge = lambda b: b.withColumn("reject_class", F.when(F.col("sequence_number") % 5 == 0, "policy"))
    loops.admit(as_stream(submissions(spark, d).select("sequence_number", "n_bytes"), path + "/in", order="sequence_number"), judge, path + "/yes", path + "/no", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/yes").select("sequence_number", F.lit(True).alias("accepted")).unionByName(spark.read.parquet(path + "/no").select("sequence_number", F.lit(False).alias("accepted")))


@query("SELECT sequence_number % 10 = 0 AS own, sequence_number // 10 * 10 AS leaf, max(sequence_number) AS tip FROM f_entries GROUP BY 1, 2")
def stream_build(spark, d):
    path = folder(spark)
    i, m = F.col("sequence_number"), F.col("sequence_number") % 10
    rows = fx.entries(spark, d).select(i, m.alias("m"))

    def fold(batch: DataFrame) -> DataFrame:
        leaf = F.when(F.col("m") == 0, F.col("sequence_number") * 2).otherwise((F.col("sequence_number") - F.col("m")) * 2 + 1)
        return batch.groupBy(leaf.alias("leaf_seq")).agg(F.max("sequence_number").alias("origin_tip"), F.min("sequence_number").alias("authority_tip"))

    loops.build(as_stream(rows, path + "/in", order="sequence_number"), fold, path + "/out", path + "/state").awaitTermination()
    last = loops.built(spark, path + "/out")
    return last.select((F.col("leaf_seq") % 2 == 0).alias("own"), F.expr("leaf_seq div 2").alias("leaf"), F.col("origin_tip").alias("tip"))


@query("SELECT sequence_number, canonical_hash FROM f_documents")
def stream_ship(spark, d):
    path = folder(spark)
    docs = fx.documents(spark, d).select("sequence_number", "canonical_hash", "data")
    loops.ship(as_stream(docs.unionByName(docs.where("sequence_number % 9 = 0")), path + "/in", order="sequence_number"), path + "/out", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/out").select("sequence_number", "canonical_hash")


@query("SELECT sequence_number, canonical_hash, CASE WHEN sequence_number % 29 = 0 THEN 'manual' ELSE 'shipped' END AS state FROM f_documents")
def stream_ship_retry(spark, d):
    """Some rows fail once or twice and go out later; some always fail and end with a person."""
    path, i = folder(spark), F.col("sequence_number")
    fails = (i % 29 == 0) | (i % 13 == 0) & (F.col("attempts") < 2)
    docs = fx.documents(spark, d).select("sequence_number", "canonical_hash", "data")
    loops.ship(as_stream(docs, path + "/in", order="sequence_number"), path + "/out", path + "/state", fails, 4).awaitTermination()
    loops.shipped_rest(spark, path + "/out", fails, 4)
    sent = spark.read.parquet(path + "/out").select("sequence_number", "canonical_hash", F.lit("shipped").alias("state"))
    return sent.unionByName(spark.read.parquet(path + "/out_manual").select("sequence_number", "canonical_hash", F.lit("manual").alias("state")))


@query("SELECT 'split_index' AS projection, schema_id || ':' || split_id AS key, sequence_number FROM f_splits UNION ALL SELECT 'entry_lookup', signer_did, sequence_number FROM f_splits WHERE sequence_number % 2 = 0")
def stream_project(spark, d):
    path = folder(spark)
    of = {
        "split_index": lambda b: b.select(F.concat_ws(":", "schema_id", "split_id").alias("key"), "sequence_number"),
        "entry_lookup": lambda b: b.where("sequence_number % 2 = 0").select(F.col("signer_did").alias("key"), "sequence_number"),
    }
    loops.project(as_stream(fx.splits(spark, d), path + "/in", order="sequence_number"), of, path + "/out", path + "/state").awaitTermination()
    rows = [spark.read.parquet(f"{path}/out/{name}").select(F.lit(name).alias("projection"), "key", "sequence_number") for name in of]
    return rows[0].unionByName(rows[1])


@query("""SELECT 'did:log:main' AS originator, tree_size, least(root_hash, sha256(root_hash)) AS root_a, greatest(root_hash, sha256(root_hash)) AS root_b
FROM f_heads JOIN (SELECT tree_size, count(DISTINCT signer) AS k FROM f_sigs GROUP BY 1) USING (tree_size) WHERE k >= 3 AND tree_size % 50 = 1""", python=True)
def stream_head_monitor(spark, d):
    path = folder(spark)
    signers = fx.sigs(spark, d).groupBy("tree_size").agg(F.countDistinct("signer").alias("signers"))
    h = fx.heads(spark, d).join(signers, "tree_size").select(F.lit(fx.LOG).alias("originator"), "tree_size", "root_hash", "signers")
    forged = h.where("tree_size % 50 = 1").withColumn("root_hash", F.sha2("root_hash", 256))
    heads = as_stream(h.unionByName(forged).withColumn("o", F.xxhash64("root_hash")), path + "/in", order="o").drop("o")
    return drained(loops.monitor_heads(heads, 3), path)


@query("SELECT sequence_number, CASE WHEN sequence_number % 97 = 13 THEN 'skipped' ELSE 'diverged' END AS verdict FROM f_entries WHERE sequence_number % 97 = 13 OR sequence_number % 101 = 5")
def stream_integrity(spark, d):
    """The journal's hashes as they come against the tree's, which has holes; some have been changed."""
    path = folder(spark)
    tree = fx.holed(spark, d).select("sequence_number", F.col("canonical_hash").alias("tree_hash"))

    def check(batch: DataFrame) -> DataFrame:
        rows = batch.join(tree, "sequence_number", "left")
        verdict = F.when(F.col("tree_hash").isNull(), "skipped").when(F.col("canonical_hash") != F.col("tree_hash"), "diverged")
        return rows.select("sequence_number", verdict.alias("verdict")).where("verdict is not null")

    rows = fx.entries(spark, d).select("sequence_number", F.when(F.col("sequence_number") % 101 == 5, F.sha2("canonical_hash", 256)).otherwise(F.col("canonical_hash")).alias("canonical_hash"))
    loops.audit(as_stream(rows, path + "/in", order="sequence_number"), check, path + "/out", path + "/state").awaitTermination()
    return spark.read.parquet(path + "/out").select("sequence_number", "verdict")


@query("SELECT signer_did, schema_ref, count(*) AS n, max(sequence_number) AS last FROM f_entries GROUP BY 1, 2")
def stream_counts(spark, d):
    path = folder(spark)
    counts = loops.counts(as_stream(fx.entries(spark, d).select("signer_did", "schema_ref", "sequence_number"), path + "/in", order="sequence_number"))

    def newest(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    counts.writeStream.foreachBatch(newest).outputMode("update").option("checkpointLocation", path + "/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(path + "/out")
    return got.groupBy("signer_did", "schema_ref").agg(F.max_by("n", "batch_id").alias("n"), F.max("last").alias("last"))


@query("SELECT max(sequence_number) AS mark FROM (SELECT sequence_number, sequence_number - row_number() OVER (ORDER BY sequence_number) AS s FROM f_holed) WHERE s = -1")
def replay_mark(spark, d):
    return windows.prefix_end(fx.holed(spark, d), -1).select(F.col("last").alias("mark"))


@query("SELECT hash, attempts, CASE WHEN attempts >= 10 THEN 'manual' ELSE 'retry' END AS action FROM f_journal WHERE state = 1")
def stale_recover(spark, d):
    return state.classified_failures(fx.journal(spark, d).where("state = 1"))
