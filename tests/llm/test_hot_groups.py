"""Ids that repeat, groups that hold most rows, and joins on hot keys."""

import random

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F
from test_near_dedup import brute, closure, family

from proofyard.llm import embed_dedup, minhash_dedup
from proofyard.llm.blocks import blocked_across
from proofyard.llm.graph import components
from proofyard.llm.shared import join_hot, saved


def test_vectors_under_one_id_are_separate(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a), (5, a), (5, b), (5, None), (7, b), (9, None)]
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1, True), (5, 0, 5, True), (5, 1, 1, False), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True)]


def test_hamming_distance_of_pairs_within_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    (mean, projections), tables, width, radius = embed_dedup.fitted(x, 0.95, 10**9)
    assert width > 24 and projections.shape[1] == tables * width
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    bits = [np.packbits((v - mean) @ projections >= 0, axis=1) for v in (x, y)]
    codes = [embed_dedup._words([c.tobytes() for c in b], width, tables) for b in bits]
    far = np.bitwise_count(codes[0][0] ^ codes[1][0]).sum(axis=1)
    assert (far <= radius).mean() > 0.999
    assert (codes[0][1] == codes[1][1]).any(axis=1).mean() >= 0.95
    others = np.bitwise_count(codes[0][0] ^ np.roll(codes[0][0], 1, axis=0)).sum(axis=1)
    assert (others <= radius).mean() < 0.01


@pytest.mark.parametrize("strangers", [1, 3, 40])
def test_members_of_the_largest_group_do_not_meet(spark, strangers):
    """Every pair across groups meets in one block at least, and few rows are copied."""
    n, size = 200, 16
    rows = [(i, 7, 0 if i < n - strangers else i % 3 + 1, i < n - strangers, strangers, n) for i in range(n)]
    df = spark.createDataFrame(rows, "rep long, band long, comp long, most boolean, rest long, n long")
    got = blocked_across(df, ["band"], "rep", "rest", "most", size, 4).collect()
    blocks = {}
    for r in got:
        blocks.setdefault((r["i"], r["j"]), []).append(r)
    met = set()
    for (i, j), members in blocks.items():
        for x in members:
            for y in members:
                if x["rep"] < y["rep"] and x["comp"] != y["comp"] and (i == j or x["side"] != y["side"]):
                    met.add((x["rep"], y["rep"]))
    assert met == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2]}
    parts = -(-strangers // size)
    assert len(got) <= (n - strangers) * parts + strangers * (-(-n // size) + parts)


def test_groups_with_blocks_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "SKETCHES", 8)
    rows = family(3, 3, 60, 60)
    rows += [(200_000 + i, r[1], "en", "s") for i, r in enumerate(rows[:40])]  # exact copies
    rows += [(rows[0][0], rows[0][1], "en", "s")] * 30  # one id in many rows
    docs = documents(spark, tmp_path, rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs, k=4).collect()}
    want = brute(rows, 4)
    assert got == want
    kept = [r["doc_id"] for r in minhash_dedup.one_of_each(docs, k=4).collect()]
    assert sorted(kept) == sorted(i for i, (_, c) in want.items() if i == c)


def test_joins_on_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1] * 50 + [2] * 20 + list(range(3, 400)) + [None]), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k long, v long")
    table = left.where("k is not null and k % 5 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    for how in ("inner", "left"):
        want = left.join(table.drop("n"), ["k"], how)
        for total in (3000, 10**6):
            got = join_hot(left, table, ["k"], "n", total, how)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_components_of_hubs(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000, 6000 + i) for i in range(2000)] + [(2999, 5000), (9000, 9001)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in closure({x for e in edges for x in e}, edges).items() if i != c}


def test_documents_of_a_group_meet_once_not_once_a_band(spark, tmp_path, monkeypatch):
    """A group whose members share many bands, with strangers near it, is copied as one bucket."""
    given, blocks = [], minhash_dedup.blocked_across

    def counting(rows, *args):
        given.append((rows.count(), rows.select("rep").distinct().count()))
        return blocks(rows, *args)

    monkeypatch.setattr(minhash_dedup, "blocked_across", counting)
    rows = family(4, 1, 150, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(documents(spark, tmp_path, rows), k=4).collect()}
    assert got == brute(rows, 4)
    assert len(given) == 2 and given[0][1] > 100 and all(n <= 4 * documents for n, documents in given)


def test_buckets_of_a_group_and_of_a_chain(spark):
    """Bands around one component are one bucket where this takes fewer copies; pairs that share a band share a bucket."""
    group = [(i, t, 100 + t, 0 if i < 60 else i) for t in range(24) for i in range(80) if (i + t) % 5]
    chain = [(1000 + 5 * b + i, 3, 5000 + b, 1000 if i < 4 else 1004 + 5 * b) for b in range(300) for i in range(5)]
    rows = minhash_dedup._buckets(saved(spark.createDataFrame(group + chain, "rep long, t int, band long, comp long")), 10**6, 8).collect()
    assert sum(r["rep"] < 80 for r in rows) == 80 and all(r["whole"] and r["key"] == 0 and r["t"] == 0 for r in rows if r["rep"] < 80)
    assert sorted((r["rep"], r["key"], r["t"]) for r in rows if r["rep"] >= 80) == sorted((i, b, t) for i, t, b, _ in chain) and not any(r["whole"] for r in rows if r["rep"] >= 80)
    got = minhash_dedup._open(saved(spark.createDataFrame(rows, "rep long, comp long, whole boolean, key long, t int")), 10**6).where("whole").collect()
    assert {(r["n"], r["rest"], r["most"]) for r in got} == {(80, 20, True), (80, 20, False)}
