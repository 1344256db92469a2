"""Near-duplicate documents and embeddings against brute force, and the estimate of odd sketches."""

import random

import numpy as np
import pytest
from cases import ROWS, documents, words
from pyspark.sql import functions as F

from proofyard.llm import embed_dedup, minhash_dedup
from proofyard.llm.graph import components


def closure(ids, links):
    above = {i: i for i in ids}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        above[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def sets(rows, k):
    out = {}
    for i, text, *_ in rows:
        w = words(text)
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(rows, k):
    s = sets([r for r in rows if r[0] is not None], k)
    ids = list(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return {i: (len(s[i]), c) for i, c in closure(ids, links).items()}


@pytest.mark.parametrize("k", [4, 5])
def test_odd_rows(spark, tmp_path, k):
    docs = documents(spark, tmp_path)
    got = minhash_dedup.near_duplicates(docs, k=k).collect()
    want = brute(ROWS, k)
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash_dedup.one_of_each(docs, k=k)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c) and ids.count(None) == 2


def family(seed, groups, each, words_in):
    """Groups of a text with copies of it in which more and more words are other ones."""
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words_in)]
        for e in range(each):
            text = list(base)
            for _ in range(e % 9):
                text[rng.randrange(words_in)] = f"n{rng.randrange(10**6)}"
            rows.append((i * 7 % 100_003, " ".join(text), "en", "s"))
            i += 1
    return rows


def test_groups_of_near_copies(spark, tmp_path):
    rows = family(1, 12, 30, 120)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(documents(spark, tmp_path, rows), k=4).collect()}
    assert got == brute(rows, 4)


def test_one_large_group_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 0)
    rows = family(2, 1, 180, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(documents(spark, tmp_path, rows), k=4).collect()}
    assert got == brute(rows, 4)


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(4)
    seeds = minhash_dedup._seeds()
    for similarity in (0.8, 0.9, 0.95):
        errors = []
        for _ in range(60):
            n = 600
            shared = int(n * 2 * similarity / (1 + similarity))
            x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = (minhash_dedup._sketch(minhash_dedup._samples(s, *seeds)).view(np.uint64) for s in (x[:n], x[n - shared :]))
            errors.append(minhash_dedup.estimate(int(np.bitwise_count(a ^ b).sum())) - similarity)
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < minhash_dedup.SLACK


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, x) for x in range(5001, 5100)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == {i: c for i, c in closure({x for e in real for x in e}, real).items() if i != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def unit_rows(seed, d=32):
    """Rows around centres at all angles about the threshold, copies, and vectors without a direction."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(25):
        centre = rng.standard_normal(d)
        for e in range(12):
            rows.append([float(x) for x in np.float32(centre + rng.standard_normal(d) * rng.choice([0, 0.05, 0.15, 0.25, 0.35]))])
    rows += [[float(x) for x in np.float32(rng.standard_normal(d))] for _ in range(300)]
    rows += [None, [0.0] * d, [float("nan")] * d, [None] * d, [1.0] * 3, [], [float("inf")] + [1.0] * (d - 1), [1e-30] * d, [2e-30] * d]
    return rows


def brute_vectors(rows, d=32):
    ok = [i for i, v in enumerate(rows) if v is not None and len(v) == d and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i] for i in ok])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(ok[a], ok[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))]
    count = dict.fromkeys(range(len(rows)), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, closure(range(len(rows)), links), len(links)


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = unit_rows(5)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "unit", "rep", "keys", "links", "weight")})
    count, comp, n = brute_vectors([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in rows])
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values()) / 2
    assert found >= 0.9 * n and all(got[i]["n_links"] <= count[i] for i in got)
    if found == n:
        assert {i: r["component_id"] for i, r in got.items()} == comp
    # a component never reaches beyond the true one
    assert all(comp[r["component_id"]] == comp[i] for i, r in got.items())
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.95 to 0.96 alone."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(700):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9501, 0.96)
        rows += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b).tolist()]
    got = embed_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert got / 2 >= 0.9 * 700


@pytest.mark.parametrize("norm", [0.8, 0.9])
def test_recall_where_vectors_share_a_direction(spark, norm):
    """Pairs at a cosine of 0.95 to 0.96 among vectors with a strong mean."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v)
    shared, rows = unit(rng.standard_normal(64)), []
    for _ in range(1000):
        a = rng.standard_normal(64)
        a = norm * shared + np.sqrt(1 - norm * norm) * unit(a - a @ shared * shared)
        b = rng.standard_normal(64)
        b = unit(b - b @ a * a)
        c = rng.uniform(0.9501, 0.96)
        rows += [a, c * a + np.sqrt(1 - c * c) * b]
    x = np.array(rows)
    want = ((x @ x.T >= 0.95).sum() - len(x)) / 2
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0] / 2
    assert 0.95 * want <= got <= want


def test_vectors_repeated_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = sorted(map(str, (tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)]))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]
