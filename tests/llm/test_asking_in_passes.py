"""What documents ask of the tables of op10 is little: bit maps let few runs through, and documents ask in passes."""

import numpy as np

from proofyard.llm import pst
from proofyard.llm.tokens import mix


def test_a_bit_map_holds_all_keys_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(pst, "BITS", 16)
    monkeypatch.setattr(pst, "BLOCK", 12)
    keys = mix(np.arange(1, 26001, dtype=np.uint64))
    held, others = keys[:6000], keys[6000:]
    bits = pst._map_of(spark.createDataFrame([(int(k),) for k in held.view(np.int64)], "key long"))
    assert pst._in_map(bits, held).all()
    assert pst._in_map(bits, others).mean() < 0.05  # one bit a key: 0.087


def test_documents_ask_in_passes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, f"the cat number {i % 7} sat on mat {i % 5} and word{i}") for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    passes, saved = [], pst.saved

    def watching(df):
        out = saved(df)
        if "rid" in df.columns:
            passes.append(out.count())
        return out

    monkeypatch.setattr(pst, "saved", watching)
    monkeypatch.setattr(pst, "RUN_LOOKUP", 20)
    monkeypatch.setattr(pst, "LOOKUP", 20)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file a partition
    try:
        got = pst.score(docs, depth=2).orderBy("doc_id").collect()
        assert len(passes) == 1 and 0 < passes[0] < 240
        monkeypatch.setattr(pst, "PASSES", 1)
        once = pst.score(docs, depth=2).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert [r["doc_id"] for r in got] == list(range(240)) and len(passes) == 1
    assert [(r["n_tokens"], r["n_known"]) for r in got] == [(r["n_tokens"], r["n_known"]) for r in once]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in once], rtol=1e-12)
