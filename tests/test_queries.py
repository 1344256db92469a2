"""Every query against its SQL, and those that SQL cannot express for rows at all."""

import pytest
from comparing import same

from proofyard.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


def test_rebuilt_rows_are_of_whole_bytes(spark):
    """Damage of any one byte shows, in entries of any length."""
    from hashlib import sha256

    from proofyard.plans import merkle

    texts = [b"", b"short", b"x" * 200_000, b"y" * 200_000, b"lost"]
    stored = [b"", b"shorT", b"x" * 200_000, b"y" * 150_000 + b"z" + b"y" * 49_999]
    hashes = [sha256(t).hexdigest() for t in texts]
    kind = "sequence_number long, canonical_hash string, data binary"
    docs = spark.createDataFrame(list(zip(range(5), hashes, texts)), kind)
    objects = spark.createDataFrame([(i, hashes[i], bytearray(x)) for i, x in enumerate(stored)], kind)
    got = {r["sequence_number"]: r["verdict"] for r in merkle.rebuilt(docs, merkle.hash_bundles(docs), objects).collect()}
    assert got == {0: "ok", 1: "corrupt", 2: "ok", 3: "corrupt", 4: "corrupt"}


@pytest.mark.parametrize("name", ["stream_ship", "rebuild_projection"])
def test_stores_hold_whole_bytes(spark, sf, tmp_path, monkeypatch, name):
    from pyspark.sql import functions as F

    from proofyard.plans import streams

    monkeypatch.setattr(streams, "folder", lambda spark: f"{tmp_path}/store")
    n = catalog.QUERIES[name](spark, sf).count()
    rows = spark.read.parquet(f"{tmp_path}/store/out" if name == "stream_ship" else f"{tmp_path}/store")
    damaged = (F.col("sequence_number") % 211 == 17) & F.lit(name == "rebuild_projection")
    assert rows.where((F.sha2("data", 256) == F.col("canonical_hash")) != damaged).count() == n == rows.count()
