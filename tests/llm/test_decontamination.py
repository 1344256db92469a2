"""Distances against dynamic programming, and whole documents against a search of every item everywhere."""

import random

from cases import ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from proofyard.llm import decontam


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120), st.integers(0, 30))
def test_bit_parallel_distance(item, text, most):
    want = semi_global(item, text)
    got = decontam.distance(item, text, most)
    assert (got[0] if got else None) == (want if want <= most and text else None)


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", min_size=1, max_size=60), st.integers(0, 12))
def test_pieces_cover_the_item(item, errors):
    got = decontam.pieces(item, errors)
    assert "".join(p for _, p in got) == item and all(item[a : a + len(p)] == p for a, p in got)


def sample(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, line(rng.randrange(12, 40)).capitalize() + ".") for i in range(12)] + [(50, None), (51, " .. "), (None, line(20))]
    docs = []
    for i in range(120):
        text = line(rng.randrange(5, 80))
        if i % 3 == 0:
            item = list(items[i % 12][1])
            for _ in range(int(len(item) * rng.choice([0, 0.02, 0.06, 0.12, 0.3]))):
                at = rng.randrange(len(item))
                rng.choice([lambda: item.pop(at), lambda: item.insert(at, rng.choice("xyz")), lambda: item.__setitem__(at, rng.choice("xyz"))])()
            text = text + rng.choice([" ", "\n\n", " -- "]) + "".join(item) + " " + line(9)
        docs.append((i, text, "en", "s"))
    return items, docs


def test_documents_against_every_item_everywhere(spark, tmp_path):
    items, rows = sample()
    docs = documents(spark, tmp_path, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", __import__("pyspark").sql.functions.lit(1))
    want = {}
    for i, text, *_ in rows:
        for k, item in items:
            clean = decontam.normalised(item)
            if k is not None and clean:
                d = semi_global(f" {clean} ", f" {decontam.normalised(text)} ")
                if d <= int(decontam.ERRORS * len(clean)):
                    want[i, k] = d
    assert len(want) > 20 and len(set(want.values())) > 2
    for block in (20_000, 5):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(docs, bench, block=block).collect()}
        assert got == want
    out = decontam.without_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows} - {i for i, _ in want}


def test_odd_rows(spark, tmp_path):
    docs = documents(spark, tmp_path)
    bench = spark.createDataFrame([(1, "one two"), (2, "ZETA, eta; theta: iota"), (3, None), (4, "one two")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == sorted([(str(i), 2) for i in (1, 2, 3, 4, None)] + [(str(i), k) for i in (8, 9) for k in (1, 4)])
    assert decontam.without_contaminated(docs, bench).count() == len(ROWS) - 8
    assert decontam.contaminated(docs.limit(0), bench).count() == decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_items_are_held_by_whole_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "nothing there"), (2, "what he said"), (3, "He."), (4, "the hen"), (5, "we saw the river stations again today"), (6, "we saw the river station again today")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "he"), (2, "the river stations again")], "item_id long, text string")
    want = [(2, 1, 0, 7), (3, 1, 0, 2), (5, 2, 0, 31), (6, 2, 1, 30)]
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in decontam.contaminated(docs, bench).collect()) == want
    monkeypatch.setattr(decontam, "ITEM_CHARS", 10)  # blocks by characters
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in decontam.contaminated(docs, bench).collect()) == want
    assert [r["doc_id"] for r in decontam.without_contaminated(docs, bench.where("item_id = 1")).orderBy("doc_id").collect()] == [1, 4, 5, 6]
