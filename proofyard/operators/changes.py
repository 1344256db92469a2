"""Changes to tables, as new tables: inserts, upserts, deletes, counters and marks. What a transaction would refuse
comes back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused because their key is there already)."""
    keys = table.select(*key)
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def insert_if_absent(table: DataFrame, rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Rows to append: of each new key the first in order."""
    struct = F.struct(*[c for c in rows.columns if c not in key])
    first = rows.groupBy(*key).agg(F.min_by(struct, order).alias("_v")).select(*key, "_v.*").select(*rows.columns)
    return first.join(table.select(*key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table after all rows have been written in order, the last of a key counting."""
    struct = F.struct(*[c for c in rows.columns if c not in (*key, order)])
    last = rows.groupBy(*key).agg(F.max_by(struct, order).alias("_v")).select(*key, "_v.*")
    return table.join(last.select(*key), key, "left_anti").unionByName(last)


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key), key, "left_anti")


def purchase(credits: DataFrame, amounts: DataFrame) -> DataFrame:
    """Balances after purchases; amounts that are not positive do not count."""
    bought = amounts.where("amount > 0").groupBy("exchange_did").agg(F.sum("amount").alias("_n"))
    both = credits.join(bought, "exchange_did", "full_outer")
    n = F.coalesce("_n", F.lit(0))
    return both.select("exchange_did", (F.coalesce("balance", F.lit(0)) + n).alias("balance"), (F.coalesce("total_purchased", F.lit(0)) + n).alias("total_purchased"), F.coalesce("total_consumed", F.lit(0)).alias("total_consumed"))


def admit_by_credit(requests: DataFrame, credits: DataFrame, order: str, width: int = 65_536) -> DataFrame:
    """Every request with admitted: the n-th of an exchange is, while n is at most its balance.

    Requests are counted by buckets of the order first; only those of the bucket in which a balance runs out are ranked,
    so that an exchange with most of the requests is no single window."""
    rows = requests.withColumn("_b", F.expr(f"{order} div {width}"))
    counts = rows.groupBy("exchange_did", "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("exchange_did").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = counts.withColumn("_upto", upto).join(credits.select("exchange_did", F.col("balance").alias("_balance")), "exchange_did", "left")
    left = left.select("exchange_did", "_b", "_n", (F.coalesce("_balance", F.lit(0)) - F.col("_upto") + F.col("_n")).alias("_left"))
    rows = rows.join(left, ["exchange_did", "_b"])
    clear = rows.where("_left >= _n or _left <= 0").withColumn("admitted", F.col("_left") >= F.col("_n"))
    edge = rows.where("_left < _n and _left > 0")
    edge = edge.withColumn("admitted", F.row_number().over(Window.partitionBy("exchange_did", "_b").orderBy(order)) <= F.col("_left"))
    return clear.unionByName(edge).select(*requests.columns, "admitted")


def advance(marks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Marks moved forward; a proposal behind its mark changes nothing."""
    new = proposals.groupBy("name").agg(F.max("value").alias("_new"))
    return marks.join(new, "name", "full_outer").select("name", F.greatest("value", "_new").alias("value"))


def overwrite(table: DataFrame, row: DataFrame) -> DataFrame:
    """A one-row table replaced."""
    return row.select(*table.columns)


def first_of_batch(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a request with duplicate: an earlier one has the same key."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key).withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def parallel_rows(batch: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of one length as rows."""
    return batch.select(F.inline(F.arrays_zip(*arrays)))


def append_only_violations(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, violation) of rows of an append-only table that a later version has lost (deleted) or holds with other
    values (updated)."""
    values = [c for c in before.columns if c not in key]
    hashed = lambda df, name: df.select(*key, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in values]).alias(name))
    both = hashed(before, "_old").join(hashed(after, "_new"), key, "left")
    return both.where("_new is null or _old <> _new").select(*key, F.when(F.col("_new").isNull(), "deleted").otherwise("updated").alias("violation"))


def evict(accesses: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """(key, last): what a cache of `capacity` keys holds after all accesses once it has overflowed and kept the most
    recent three quarters, as often as that takes: the most recently used keys."""
    last = accesses.groupBy(key).agg(F.max(order).alias("last"))
    n = last.count()
    return last if n <= capacity else last.orderBy(F.desc("last"), key).limit(capacity * 3 // 4)


def migrate(tables: dict[str, DataFrame], pending: DataFrame, steps: dict[int, object], check_only: bool = False) -> tuple[dict[str, DataFrame], list[int]]:
    """(tables, versions applied): pending versions applied to the tables in order, each a function of all tables; with
    `check_only` they are only listed. A version without a step is refused, and nothing after it is applied."""
    done = []
    for row in pending.orderBy("version").collect():
        if not check_only:
            if row["version"] not in steps:
                raise ValueError(f"there is no migration to version {row['version']}")
            tables = {**tables, **steps[row["version"]](tables)}
        done.append(row["version"])
    return tables, done


def published(spark, path: str, before: int | None = None) -> list[str]:
    """Folders of the marked batches under `path`, of those with a number under `before`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch_id=")]
    ok = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) and (before is None or int(p.getName()[9:]) < before)]
    return sorted(p.toString() for p in ok)


def publish(df: DataFrame, path: str, batch_id: int) -> bool:
    """Write a batch under its own id, then mark it: a batch that is marked is not written again, and readers take
    marked ones only. False if it was there already."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}/_SUCCESS")):
        return False
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return True
