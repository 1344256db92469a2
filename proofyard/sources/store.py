"""Bytes of entries and tiles in files: immutable objects by sequence and hash, tiles by path, bundles, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256


def location(kind: str, bucket: str, prefix: str = "") -> str:
    """The path under which Spark's file systems reach a backend."""
    schemes = {"s3": "s3a://", "gcs": "gs://", "file": "file://"}
    if kind not in schemes:
        raise ValueError(f"no backend {kind}: one of {', '.join(sorted(schemes))}")
    return schemes[kind] + "/".join(x for x in (bucket.rstrip("/"), prefix.strip("/")) if x)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_number, canonical_hash, data) of objects under <prefix>/<sequence as 16 hex digits>/<hash>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_extract("path", r"([0-9a-f]{16})/([0-9a-f]{64})$", 1), F.regexp_extract("path", r"([0-9a-f]{16})/([0-9a-f]{64})$", 2)
    return files.where(key[1] != "").select(F.conv(key[0], 16, 10).cast("long").alias("sequence_number"), key[1].alias("canonical_hash"), F.col("content").alias("data"))


def read_batch(store: DataFrame, refs: DataFrame) -> DataFrame:
    """Bytes of asked (ord, sequence_number, canonical_hash), in the order asked; null where absent."""
    return refs.join(store, ["sequence_number", "canonical_hash"], "left").orderBy("ord")


def write_entries(rows: DataFrame, path: str, width: int = 1_000_000) -> int:
    """Append (sequence_number, canonical_hash, data) to a table by bucket of sequences. What is there stays: writing
    rows again adds nothing. Gives the number of rows added."""
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.expr(f"sequence_number div {width}")).dropDuplicates(["sequence_number", "canonical_hash"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select("bucket", "sequence_number", "canonical_hash"), ["bucket", "sequence_number", "canonical_hash"], "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("bucket").parquet(path)
    return n


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(level, index, width, data) of tiles under tile/<level>/<index path>[.p/<width>]; other paths, and any that climb
    out of the tree, are ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pattern = r"tile/(\d+|entries)/((?:x\d{3}/)*\d{3})(?:\.p/(\d+))?$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = files.where((part(2) != "") & ~F.contains("path", F.lit("/../")))
    return rows.select(part(1).alias("level"), F.regexp_replace(part(2), "[x/]", "").cast("long").alias("index"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(TILE)).alias("width"), F.col("content").alias("data"))


def widest(tiles: DataFrame) -> DataFrame:
    """Of full and partial tiles of one place the widest."""
    return tiles.groupBy("level", "index").agg(F.max("width").alias("width"), F.max_by("data", "width").alias("data"))


def tile_hashes(tiles: DataFrame) -> DataFrame:
    """(index, hash) of the 32-byte hashes in tiles of leaves."""
    at = F.explode(F.sequence(F.lit(0), F.expr("octet_length(data) div 32 - 1")))
    return tiles.where("octet_length(data) >= 32").withColumn("at", at).select((F.col("index") * TILE + F.col("at")).alias("index"), F.col("data").substr(F.col("at") * 32 + 1, F.lit(32)).alias("hash"))


def _split_bundles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for index, data in zip(f["index"], f["data"]):
            at, k = 0, 0
            while at + 2 <= len(data):
                n = int.from_bytes(data[at : at + 2], "big")
                whole = at + 2 + n <= len(data)
                out.append((index * TILE + k, bytes(data[at + 2 : at + 2 + n]) if whole else None))
                at, k = at + 2 + n, k + 1
            if at + 1 == len(data):
                out.append((index * TILE + k, None))
        yield pd.DataFrame(out, columns=["sequence_number", "data"])


def bundle_entries(bundles: DataFrame) -> DataFrame:
    """(sequence_number, data) of bundles (index, data): entries as u16 length and bytes; one that is
    cut short has null data."""
    schema = T.StructType([T.StructField("sequence_number", T.LongType()), T.StructField("data", T.BinaryType())])
    return bundles.select("index", "data").mapInPandas(_split_bundles, schema)


def parse_checkpoints(notes: DataFrame, column: str = "value") -> DataFrame:
    """(origin, size, root) of signed notes: three lines, the last base64; others give nulls."""
    line = F.split(column, "\n")
    return notes.select(F.get(line, F.lit(0)).alias("origin"), F.get(line, F.lit(1)).try_cast("long").alias("size"), F.lower(F.hex(F.try_to_binary(F.get(line, F.lit(2)), F.lit("base64")))).alias("root"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The index of archived logs, a JSON array."""
    return spark.read.schema("shard_did string, range_start_seq long, range_end_seq long, location string").option("multiLine", "true").json(path)


def archived(spark: SparkSession, refs: DataFrame, shards: DataFrame) -> DataFrame:
    """(sequence_number, canonical_hash, shard_did, data, verdict) of asked (sequence_number, canonical_hash): bytes from the
    store of the archived shard whose range holds the sequence. Verdict: ok, corrupt (other bytes than the hash says),
    missing (not in its shard) or no_shard. The index of shards is configuration; each store is read once."""
    from ..operators.joins import resolve_shard

    listed = shards.select("shard_did", "location").collect()
    stores = None
    for row in listed:
        one = spark.read.parquet(row["location"]).select(F.lit(row["shard_did"]).alias("shard_did"), "sequence_number", "canonical_hash", "data")
        stores = one if stores is None else stores.unionByName(one)
    placed = resolve_shard(refs.withColumn("log_did", F.lit("")), shards).select("sequence_number", "canonical_hash", "shard_did")
    if stores is None:
        return placed.select("*", F.lit(None).cast("binary").alias("data"), F.lit("no_shard").alias("verdict"))
    rows = placed.join(stores, ["shard_did", "sequence_number", "canonical_hash"], "left")
    verdict = F.when(F.col("shard_did").isNull(), "no_shard").when(F.col("data").isNull(), "missing").when(F.sha2("data", 256) == F.col("canonical_hash"), "ok").otherwise("corrupt")
    return rows.select("sequence_number", "canonical_hash", "shard_did", "data", verdict.alias("verdict"))


def checkpoint_notes(roots: DataFrame, origin: str) -> DataFrame:
    """(size, value): the signed note's text of heads (size, root as hex), without its signatures."""
    note = F.concat_ws("\n", F.lit(origin), F.col("size").cast("string"), F.base64(F.unhex("root")), F.lit(""))
    return roots.select("size", note.alias("value"))


def jdbc_entries(spark: SparkSession, url: str, table: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel by ranges of sequences; filters and columns are pushed down to it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="sequence_number", lowerBound=lower, upperBound=upper, numPartitions=parts, **options)
    return reader.load()


def peer_feed(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A peer's events as files of JSON lines that arrive in a folder, as a stream."""
    schema = "event_id string, originator string, kind string, lamport long, prev_hash string, bindings array<string>, body string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)
