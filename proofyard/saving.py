"""Tables written to the folder that driver and executors share, where lineage is to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back: under spark.checkpoint.dir, or the warehouse where that is unset. A lost
    executor costs a read; the files go when the application ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/saved/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
