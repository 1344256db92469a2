"""What several operators share: words in SQL, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir. Where none is named, a temporary one if all runs in one
    process; on a cluster it must be named, as machines do not share temporary folders."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="proofyard-"))


_own: dict[str, str] = {}


ARROW_ROWS = 1000  # in a batch between Spark and Python while a table is saved: texts are long


def saved(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs
    only a read. The files go when the application ends, or by `discard`."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/proofyard/{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `saved` wrote for frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


NEAR_BYTES = 8 << 20  # of Parquet up to which a saved table may be broadcast


def near(df: DataFrame, rows: int) -> DataFrame:
    """A table that is cheap to count, to be broadcast in a join if it has at most `rows` rows and, where it has been
    saved, at most NEAR_BYTES of files; else as it is, for a join by shuffle."""
    if df.count() > rows:
        return df
    if path := getattr(df, "saved_at", None):
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength() > NEAR_BYTES:
            return df
    return F.broadcast(df)


HOT = 1000  # a key with more than this share of the rows (one in HOT) is joined by broadcast


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `table`, whose keys are unique and whose column `count` says how many rows hold each (left out
    of the result). Rows under hot keys, of which there are fewer than HOT, meet a broadcast table and stay where they
    are; only the others are shuffled by key. `total` is the number of rows, or more."""
    hot = F.col(count) > max(total // HOT, 1)
    plain = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    out = plain.join(table.where(~hot).drop(count), keys, how)
    return out.unionByName(rows.join(F.broadcast(table.where(hot).drop(count)), keys))


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, row, numbered by rid: no name of theirs meets one of an operator. The numbers are the
    same each time the rows are read if they come from files."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")
