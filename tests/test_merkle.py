"""Trees and proofs against an implementation written from the RFC's recursive definitions."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from proofyard.operators import merkle


def h(x):
    return sha256(x).digest()


def mth(d):
    if len(d) == 1:
        return h(b"\0" + d[0])
    k = 1 << (len(d) - 1).bit_length() - 1
    return h(b"\1" + mth(d[:k]) + mth(d[k:]))


def path(m, d):
    if len(d) == 1:
        return []
    k = 1 << (len(d) - 1).bit_length() - 1
    return path(m, d[:k]) + [mth(d[k:])] if m < k else path(m - k, d[k:]) + [mth(d[:k])]


def subproof(m, d, whole):
    if m == len(d):
        return [] if whole else [mth(d)]
    k = 1 << (len(d) - 1).bit_length() - 1
    return subproof(m, d[:k], whole) + [mth(d[k:])] if m <= k else subproof(m - k, d[k:], False) + [mth(d[:k])]


def nodes(spark, n):
    rows = [(i, str(i).encode()) for i in range(n)]
    return merkle.levels(spark.createDataFrame(rows, "index long, data binary").select("index", merkle.leaf_hash(F.col("data")).alias("hash"))), [x for _, x in rows]


@pytest.mark.parametrize("n", [1, 2, 7, 256, 257, 700])
def test_root_and_all_paths(spark, n):
    tree, data = nodes(spark, n)
    root = mth(data).hex()
    assert merkle.root(tree).collect()[0].asDict() == {"size": n, "root": root}
    got = merkle.verify_paths(tree.where("level = 0").select("index", "hash"), merkle.all_paths(tree, n), n).collect()
    assert len(got) == n and {r["root"] for r in got} == {root}


def test_seven_leaves_by_hand(spark):
    tree, data = nodes(spark, 7)
    a = [h(b"\0" + x) for x in data]
    b = [h(b"\1" + a[0] + a[1]), h(b"\1" + a[2] + a[3]), h(b"\1" + a[4] + a[5]), a[6]]
    c = [h(b"\1" + b[0] + b[1]), h(b"\1" + b[2] + b[3])]
    assert merkle.root(tree).first()["root"] == h(b"\1" + c[0] + c[1]).hex()


def test_proofs(spark):
    tree, data = nodes(spark, 300)
    tree = tree.cache()
    for m in (0, 255, 256, 299):
        got = [r["hash"] for r in merkle.proof(tree, merkle.path_coordinates(m, 300)).collect()]
        assert got == [x.hex() for x in path(m, data)]
    for old in (1, 2, 3, 6, 128, 200, 256, 299):
        got = [r["hash"] for r in merkle.proof(tree, merkle.consistency_coordinates(old, 300)).collect()]
        assert got == [x.hex() for x in subproof(old, data, True)]
    assert merkle.consistency_coordinates(0, 5) == merkle.consistency_coordinates(5, 5) == []
    with pytest.raises(ValueError):
        merkle.path_coordinates(300, 300)


def test_a_changed_leaf_is_seen(spark):
    tree, _ = nodes(spark, 40)
    bad = tree.where("level = 0").select("index", F.when(F.col("index") == 7, merkle.leaf_hash(F.lit(b"x"))).otherwise(F.col("hash")).alias("hash"))
    good = merkle.root(tree).first()["root"]
    wrong = merkle.verify_paths(bad, merkle.all_paths(tree, 40), 40).where(F.col("root") != good)
    assert [r["position"] for r in wrong.collect()] == [7]


def test_sparse_root_does_not_depend_on_the_parts(spark):
    rows = [(h(bytes([i, 1])), bytes([i])) for i in range(200)]
    t = spark.createDataFrame(rows, "key binary, value binary")
    roots = {merkle.sparse_root(t, bits).first()["root"] for bits in (1, 4, 8)}
    assert len(roots) == 1
    changed = t.withColumn("value", F.when(F.col("key") == rows[3][0], F.lit(b"?")).otherwise(F.col("value")))
    assert merkle.sparse_root(changed).first()["root"] not in roots
    assert merkle.sparse_root(t.limit(0)).first()["root"] == h(b"").hex()


def test_sparse_proofs_of_members_and_others(spark):
    rows = [(h(bytes([i, 1])), bytes([i])) for i in range(200)]
    t = spark.createDataFrame(rows, "key binary, value binary")
    keys = [r[0] for r in rows[:20]] + [h(bytes([i, 9])) for i in range(20)]
    for bits in (2, 8):
        root = merkle.sparse_root(t, bits).first()["root"]
        got = merkle.sparse_proofs(t, keys, bits).collect()
        assert {bytes(r["key"]): r["member"] for r in got} == {k: i < 20 for i, k in enumerate(keys)}
        for r in got:
            path = [(s["bit"], bytes(s["hash"])) for s in r["path"]]
            assert merkle.sparse_verify(bytes(r["key"]), bytes(r["leaf_key"]), bytes(r["leaf_hash"]), path) == root
            assert (bytes(r["leaf_key"]) == bytes(r["key"])) == r["member"]
            assert merkle.sparse_verify(bytes(r["key"]), bytes(r["leaf_key"]), b"x" * 32, path) != root
    assert merkle.sparse_proofs(t.limit(0), keys).count() == 0
    with pytest.raises(ValueError):
        merkle.sparse_proofs(t, keys, most=10)
