"""Audits on small logs with planted faults, codecs, and that batches may be cut anywhere."""

import pytest
from pyspark.sql import functions as F

from proofyard import schemas
from proofyard.functions import codecs
from proofyard.operators import changes, lookups, state, windows
from proofyard.sources import store
from proofyard.streaming import loops


def log(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "sequence_number long")


@pytest.mark.parametrize("width", [1, 2, 5, 100])
@pytest.mark.parametrize("seqs, cursor, end", [([0, 1, 2, 4], -1, 2), ([1, 2], -1, -1), ([], -1, -1), ([5, 6, 7, 9], 4, 7), ([5, 6, 7, 8, 9, 10, 12], 6, 10), ([3, 3, 4, 5], 2, 5), ([0, 1, 2, 3, 8, 9], -1, 3)])
def test_prefix(spark, width, seqs, cursor, end):
    rows = log(spark, seqs)
    assert windows.prefix_end(rows, cursor, width=width).first()["last"] == end
    got = {r["sequence_number"] for r in windows.contiguous_prefix(rows, cursor, width=width).collect()}
    assert got == {s for s in seqs if cursor < s <= end}


@pytest.mark.parametrize("width", [1, 3, 100])
def test_gaps(spark, width):
    got = windows.gap_ranges(log(spark, [0, 1, 4, 5, 9]), width=width).collect()
    assert sorted(map(tuple, got)) == [(2, 3), (6, 8)]
    assert windows.gap_ranges(log(spark, []), width=width).count() == 0


def test_chain_flags_exactly_the_planted_faults(spark):
    z = "0" * 64
    rows = [("a", 1, "a1", z), ("a", 2, "a2", "a1"), ("b", 1, "b1", "x"), ("c", 1, "c1", z), ("c", 1, "c2", "c1"), ("d", 0, "d0", z)]
    got = windows.chain_check(spark.createDataFrame(rows, "originator string, lamport long, event_id string, prev_hash string")).collect()
    assert sorted(map(tuple, got)) == [("b", 1, "link"), ("c", 1, "clock"), ("d", 0, "clock")]


def test_same_hash_twice_in_one_batch_is_a_ghost_and_a_repeat_a_replay(spark):
    rows = spark.createDataFrame([(1, "h"), (2, "h"), (2, "h"), (3, "i")], "sequence_number long, canonical_hash string")
    got = sorted((r["sequence_number"], r["class"]) for r in windows.ghost_classify(rows).collect())
    assert got == [(1, "primary"), (2, "ghost"), (2, "replay"), (3, "primary")]


def test_equivocation_needs_one_signer(spark):
    rows = [(100, "s", "k", "a"), (200, "s", "k", "a"), (300, "s", "k", "b"), (1, "s", "l", "a"), (2, "s", "l", "b"), (9, "s", "m", "a")]
    got = windows.equivocation_pairs(spark.createDataFrame(rows, "sequence_number long, schema_id string, split_id string, signer_did string")).collect()
    assert list(map(tuple, got)) == [("s", "k", 100, 200)]


def test_codecs_round_trip_and_refuse(spark):
    t = spark.createDataFrame([("did:x", 5), ("é", 2**62)], "d string, s long")
    p = t.select(codecs.serialize_position("d", "s").alias("p"), "d", "s")
    back = p.select(codecs.deserialize_position("p").alias("q"), "d", "s").collect()
    assert all((r["q"]["log_did"], r["q"]["sequence"]) == (r["d"], r["s"]) for r in back)
    assert p.select(codecs.deserialize_position(F.substring("p", 1, 9)).alias("q")).where("q is null").count() == 2
    texts = spark.createDataFrame([("a:b:7",), (":7",), ("a:",), ("a7",)], "t string").select(codecs.parse_position("t").alias("q")).collect()
    assert [None if r["q"] is None else tuple(r["q"]) for r in texts] == [("a:b", 7), None, None, None]
    tips = spark.createDataFrame([([("a", 1), ("bb", 2)],), ([],)], "t array<struct<log_did:string,sequence:long>>")
    got = tips.select("t", codecs.decode_tips(codecs.encode_tips("t")).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in got)
    assert tips.select(codecs.decode_tips(F.lit(b"\x00\x03\x00")).alias("b")).first()["b"] is None


def test_tile_paths_of_any_length(spark):
    wanted = {0: "000", 1234067: "x001/x234/067", 999_999_999: "x999/x999/999", 1_000_014_129: "x001/x000/x014/129", 2**63 - 1: "x009/x223/x372/x036/x854/x775/807"}
    rows = spark.createDataFrame([(n,) for n in wanted], "n long").select("n", codecs.tile_path("n").alias("path")).collect()
    assert dict(map(tuple, rows)) == wanted


def test_journal_machine_against_a_model(spark):
    import random

    def model(ops):
        st, seq, att, bad = 0, None, 0, 0
        for op, s in ops:
            if op == "submit":
                st = st or 1
            elif st == 0:
                bad += 1
            elif op == "sequence":
                if st == 1:
                    st, seq = 2, s
                elif not (st == 2 and seq == s):
                    bad += 1
            elif op == "ship":
                if st in (2, 4) and seq is not None:
                    st = 3
                else:
                    bad += 1
            elif op == "manual":
                if st == 3:
                    bad += 1
                else:
                    st = 4
            elif st in (1, 2):
                att += 1
            else:
                bad += 1
        return st, seq, att, bad

    rng = random.Random(5)
    logs = {f"h{i}": [(rng.choice(["submit", "sequence", "ship", "retry", "manual"]), rng.randrange(3)) for _ in range(rng.randrange(1, 12))] for i in range(150)}
    rows = [(h, i, op, s) for h, ops in logs.items() for i, (op, s) in enumerate(ops)]
    got = state.fold_journal(spark.createDataFrame(rows, "hash string, ord int, op string, sequence long")).collect()
    assert {r["hash"]: tuple(r)[1:] for r in got} == {h: model(ops) for h, ops in logs.items()}


def test_credit_stops_at_the_balance(spark):
    credits = spark.createDataFrame([("a", 2)], "exchange_did string, balance long")
    requests = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 1)], "exchange_did string, t int")
    got = {(r["exchange_did"], r["t"]): r["admitted"] for r in changes.admit_by_credit(requests, credits, "t").collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): False}


def test_unknown_value_matches_nothing(spark):
    e = spark.createDataFrame([(1, None, "h", None, 0)], "sequence_number long, log_time timestamp, canonical_hash string, cosignature_of string, status int")
    assert lookups.by_column(e, "cosignature_of", None).count() == lookups.by_column(e, "cosignature_of", "").count() == 0
    with pytest.raises(ValueError):
        lookups.in_range(e, 0, 5000)


def test_store_writes_once_and_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, "h%d" % i, bytes([i])) for i in range(5)], "sequence_number long, canonical_hash string, data binary")
    assert store.write_entries(rows, f"{tmp_path}/s", width=2) == 5
    assert store.write_entries(rows.limit(3), f"{tmp_path}/s", width=2) == 0
    refs = spark.createDataFrame([(0, 4, "h4"), (1, 9, "h9"), (2, 0, "h0")], "ord int, sequence_number long, canonical_hash string")
    got = store.read_batch(spark.read.parquet(f"{tmp_path}/s"), refs).collect()
    assert [r["data"] and bytes(r["data"]) for r in got] == [b"\4", None, b"\0"]


def test_tiles_of_files(spark, tmp_path):
    from hashlib import sha256

    def put(path, data):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)

    hashes = [sha256(bytes([i])).digest() for i in range(3)]
    put("tile/0/x001/x234/067.p/2", b"".join(hashes[:2]))
    put("tile/0/x001/x234/067", b"".join(hashes))
    put("tile/entries/000", b"\0\1a\0\2bc\0\5x")
    put("notes.txt", b"")
    tiles = store.read_tiles(spark, str(tmp_path))
    full = store.widest(tiles.where("level = '0'"))
    assert [(r["index"], bytes(r["hash"])) for r in store.tile_hashes(full).orderBy("index").collect()] == [(1234067 * 256 + i, x) for i, x in enumerate(hashes)]
    got = store.bundle_entries(tiles.where("level = 'entries'")).orderBy("sequence_number").collect()
    assert [(r["sequence_number"], r["data"] and bytes(r["data"])) for r in got] == [(0, b"a"), (1, b"bc"), (2, None)]
    assert store.location("s3", "b", "/p/") == "s3a://b/p"
    with pytest.raises(ValueError):
        store.location("ftp", "b")


def test_objects_by_sequence_and_hash(spark, tmp_path):
    name = tmp_path / "entries" / f"{255:016x}"
    name.mkdir(parents=True)
    (name / ("ab" * 32)).write_bytes(b"data")
    got = store.read_objects(spark, str(tmp_path)).collect()
    assert [(r["sequence_number"], r["canonical_hash"], bytes(r["data"])) for r in got] == [(255, "ab" * 32, b"data")]


def test_schemas(spark):
    good = spark.createDataFrame([], schemas.schema("credits"))
    assert schemas.require_schema(good, "credits") is good
    with pytest.raises(ValueError, match="balance"):
        schemas.require_schema(good.withColumn("balance", F.lit("x")), "credits")


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    df = spark.range(3)
    assert changes.publish(df, f"{tmp_path}/p", 0) and not changes.publish(df, f"{tmp_path}/p", 0)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3


def test_sequencing_survives_a_restart(spark, tmp_path):
    schema = "ord long, canonical_hash string"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    put([(2, "b"), (1, "a"), (3, "a")])
    loops.sequence(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    loops.sequence(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    put([(9, "c"), (8, "b")])
    loops.sequence(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("sequence_number").collect()
    assert [(r["sequence_number"], r["canonical_hash"]) for r in got] == [(0, "a"), (1, "b"), (2, "c")]


def test_fold_does_not_depend_on_the_cut(spark):
    from proofyard.plans.changes import _authority
    from conftest import SF

    rows = state.paths(_authority(spark, SF)).cache()
    whole = {tuple(r) for r in state.fold_leaves(rows).collect()}
    parts = [state.fold_leaves(rows.where(f"sequence_number div 100 % 2 = {k}")) for k in (0, 1)]
    both = parts[0].unionByName(parts[1]).groupBy("leaf_seq").agg(F.max("origin_tip"), F.max("authority_tip"))
    assert {tuple(r) for r in both.collect()} == whole


def test_functions_in_sql(spark):
    from proofyard.functions import sql

    assert "merkle_node" in sql.register(spark)
    row = spark.sql("SELECT hex(serialize_position('did:x', 5)) AS p, object_key('e', 255, 'ab') AS k, backoff(3, 100, 1000) AS b, is_nfc('a') AS n, hex(merkle_leaf(X'61')) AS l").first()
    t = spark.createDataFrame([("did:x", 5)], "d string, s long").select(F.hex(codecs.serialize_position("d", "s")).alias("p"), codecs.object_key("e", F.lit(255), F.lit("ab")).alias("k")).first()
    assert (row["p"], row["k"], row["b"], row["n"]) == (t["p"], t["k"], 400, True)
    from hashlib import sha256

    assert row["l"].lower() == sha256(b"\0a").hexdigest()


def test_progress_of_a_stream_as_rows(spark, tmp_path):
    import time

    from proofyard.streaming.metrics import Progress

    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = Progress()
    spark.streams.addListener(seen)
    spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").queryName("five").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    for _ in range(50):
        if seen.rows:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert sum(r["input_rows"] for r in seen.frame(spark).where("name = 'five'").collect()) == 5


# Folds, chains, windows


def test_ordered_folds_carry_state_between_batches(spark):
    from proofyard.operators import ordered

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([("a", i, i) for i in range(20)] + [("b", i, 1) for i in range(7)], "k string, o long, v long")
        got = ordered.fold(rows, ["k"], ["o"], lambda: 0, lambda s, r: (s + r[1], (s + r[1],)), "total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["k"], r["o"]): r["total"] for r in got} == {**{("a", i): i * (i + 1) // 2 for i in range(20)}, **{("b", i): i + 1 for i in range(7)}}


def test_delta_window_accepts_by_prior_tips(spark):
    from proofyard.operators import ordered

    # strict: only the tip; commutative: one of the last ten; a cold start has no tips
    rows = [("s", 3, None, False), ("s", 4, 999, False), ("s", 5, 3, False), ("s", 6, 3, False), ("c", 3, None, True), ("c", 4, 3, True), ("c", 5, 3, True), ("c", 6, 999, True), ("n", 1, 7, True)]
    rows += [("w", i, None, True) for i in range(1, 12)] + [("w", 20, 1, True), ("w", 21, 2, True)]
    got = {(r["leaf"], r["sequence_number"]): r["reason"] for r in ordered.delta_window(spark.createDataFrame(rows, "leaf string, sequence_number long, prior long, commutative boolean")).collect()}
    assert [got["s", i] for i in (3, 4, 5, 6)] == ["first", "stale", "tip", "stale"]
    assert [got["c", i] for i in (3, 4, 5, 6)] == ["first", "tip", "window", "stale"] and got["n", 1] == "stale"
    assert (got["w", 20], got["w", 21]) == ("stale", "window")


def test_breaker_opens_and_tries_once(spark):
    from proofyard.operators import ordered

    calls = [("d", i, i, False) for i in range(5)] + [("d", 5, 10, True), ("d", 6, 5004, False), ("d", 7, 5005, True), ("d", 8, 10_004, True), ("d", 9, 10_005, False)]
    got = [(r["state"], r["allowed"]) for r in ordered.breaker(spark.createDataFrame(calls, "k string, o long, at_ms long, ok boolean"), "k", "o").orderBy("o").collect()]
    assert got == [("closed", True)] * 5 + [("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_values_are_carried_over_buckets(spark, width):
    rows = [("a", 0, None, 5), ("a", 1, 10, None), ("a", 4, None, None), ("a", 9, None, 7), ("b", 2, None, 1)]
    df = spark.createDataFrame(rows, "k string, o long, x long, y long")
    got = sorted(map(tuple, windows.carried(df, ["k"], "o", ["x", "y"], width=width).select("k", "o", "x", "y").collect()))
    assert got == [("a", 0, None, 5), ("a", 1, 10, 5), ("a", 4, 10, 5), ("a", 9, 10, 7), ("b", 2, None, 1)]
    got = sorted(map(tuple, windows.carried(df, ["k"], "o", ["x", "y"], False, width).select("k", "o", "x", "y").collect()))
    assert got == [("a", 0, None, None), ("a", 1, None, 5), ("a", 4, 10, 5), ("a", 9, 10, 5), ("b", 2, None, None)]


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_credit_is_given_in_order(spark, width):
    asks = spark.createDataFrame([("x", i) for i in range(0, 30, 3)] + [("y", i) for i in range(5)] + [("z", 1)], "exchange_did string, o long")
    credits = spark.createDataFrame([("x", 7), ("y", 50)], "exchange_did string, balance long")
    got = {(r["exchange_did"], r["o"]): r["admitted"] for r in changes.admit_by_credit(asks, credits, "o", width).collect()}
    assert got == {**{("x", i): i < 21 for i in range(0, 30, 3)}, **{("y", i): True for i in range(5)}, ("z", 1): False}


def test_roots_of_versions_are_those_of_each_state(spark):
    from hashlib import sha256

    from proofyard.operators import merkle

    def root(leaves, top):
        row = [leaves.get(i, merkle.EMPTY) for i in range(top + 1)]
        while True:
            row = row + [merkle.EMPTY] * (-len(row) % 16)
            row = ["".join(row[i : i + 16]) for i in range(0, len(row), 16)]
            row = [merkle.EMPTY if x == merkle.EMPTY * 16 else sha256(x.encode()).hexdigest() for x in row]
            if len(row) == 1:
                return row[0]

    writes = [(i * 7 % 300, v, sha256(f"{i}|{v}".encode()).hexdigest()) for v in (0, 1, 5) for i in range(v, 40, v + 1)]
    got = {r["version"]: r["root"] for r in merkle.versioned_roots(spark.createDataFrame(writes, "index long, version long, hash string")).collect()}
    top, state, want = max(w[0] for w in writes), {}, {}
    for v in (0, 1, 5):
        state.update({i: h for i, w, h in writes if w == v})
        want[v] = root(state, top)
    assert got == want


# Gates


def test_heads_need_a_quorum_and_chains_an_end(spark):
    from proofyard.operators import admission as a

    base = dict(n_bytes=100, version=1, decodes=True, invariants=True, normalised=True, destination="d", event_time_s=0, signature_ok=True, cosig_verdict=None, embedded_size=None, head_signers=None,
                chain_depth=None, chain_complete=None, policy_met=None, schema_id=None, n_pointers=0, session_ok=True, stamp_bits=None)
    cases = [({}, None), ({"embedded_size": 5}, "head_quorum"), ({"embedded_size": 5, "head_signers": 1}, "head_quorum"), ({"embedded_size": 5, "head_signers": 2}, None), ({"invariants": False, "normalised": False}, "bad_invariant"),
             ({"chain_depth": 3, "chain_complete": True}, None), ({"chain_depth": 3, "chain_complete": False}, "broken_chain"), ({"chain_depth": 9, "chain_complete": False}, "lost_chain"), ({"policy_met": False}, "policy"),
             ({"session_ok": False}, "unauthenticated"), ({"session_ok": False, "stamp_bits": 7}, "bad_stamp"), ({"session_ok": False, "stamp_bits": 8}, None), ({"decodes": None}, "undecodable")]
    kinds = "i int, n_bytes int, version int, decodes boolean, invariants boolean, normalised boolean, destination string, event_time_s int, signature_ok boolean, cosig_verdict string, embedded_size long, head_signers long, chain_depth int, chain_complete boolean, policy_met boolean, schema_id string, n_pointers int, session_ok boolean, stamp_bits int"
    rows = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], kinds)
    got = {r["i"]: r["reject_class"] for r in a.judge(rows, a.gates("d", F.lit(0), [], quorum=2)).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    assert {e for e, _ in a.CLASSES.values()} <= set(a.ERRORS) and len(a.ERRORS) == 37


# Stores and streams


def test_cut_bundles_leave_a_row(spark):
    whole = b"\x00\x02ab\x00\x01c"
    rows = spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(whole + b"\x00\x05xy")), (2, bytearray(whole + b"\x00"))], "index long, data binary")
    got = sorted((r["sequence_number"], None if r["data"] is None else bytes(r["data"])) for r in store.bundle_entries(rows).collect())
    assert got == [(0, b"ab"), (1, b"c"), (256, b"ab"), (257, b"c"), (258, None), (512, b"ab"), (513, b"c"), (514, None)]


def test_partial_and_full_tiles(spark, tmp_path):
    for name, data in (("tile/0/x001/234", b"f" * 64), ("tile/0/005.p/3", b"p" * 96), ("tile/0/005.p/7", b"q" * 224), ("tile/0/006", b"g" * 32), ("tile/0/006.p/9", b"h" * 288), ("note", b"x")):
        path = tmp_path / "log" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {(r["level"], r["index"]): (r["width"], bytes(r["data"][:1])) for r in store.widest(store.read_tiles(spark, f"file://{tmp_path}/log")).collect()}
    assert got == {("0", 1234): (256, b"f"), ("0", 5): (7, b"q"), ("0", 6): (256, b"g")}


def test_peers_feed_arrives_as_a_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text('{"event_id":"a","originator":"o","kind":"head","lamport":1,"bindings":["x"]}\n')
    (feed / "2.json").write_text('{"event_id":"b","originator":"o","kind":"head","lamport":2}\n')
    q = store.peer_feed(spark, f"file://{feed}", 1).writeStream.format("memory").queryName("peer_feed_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_id"], r["lamport"]) for r in spark.table("peer_feed_test").collect()) == [("a", 1), ("b", 2)]


def files(spark, path, batches, kind):
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_equivocations_that_arrive_out_of_order(spark, tmp_path):
    from proofyard.plans.streams import drained

    kind = "schema_id string, split_id string, sequence_number long, signer_did string"
    batches = [[("s", "k", 30, "a")], [("s", "k", 20, "b")], [("s", "k", 10, "b")], [("s", "k", 40, "b"), ("s", "l", 2, "c"), ("s", "l", 1, "c")], [("s", "l", 1, "c")]]
    got = drained(loops.scan_equivocations(files(spark, f"{tmp_path}/in", batches, kind)), str(tmp_path)).collect()
    assert sorted((r["split_id"], r["seq_a"], r["seq_b"]) for r in got) == [("k", 10, 20), ("l", 1, 2)]


def test_rows_of_a_stream_are_computed_once(spark, tmp_path):
    from proofyard.plans.streams import as_stream

    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        calls.add(1)
        return i

    rows = spark.range(900).select(counted("id").alias("o")).where("o >= 0")
    as_stream(rows, f"{tmp_path}/in", order="o")
    assert spark.read.parquet(f"{tmp_path}/in").count() == 900 and calls.value <= 1800  # twice where the filter stands apart


def test_a_monitor_holds_many_sizes_in_a_row_of_state(spark, tmp_path):
    import random

    from proofyard.plans.streams import drained
    from proofyard.streaming.metrics import Progress

    kind = "originator string, tree_size long, root_hash string, signers long"
    rng = random.Random(5)
    rows = [(o, n, f"{rng.randrange(3)}", rng.choice([2, 3, 4])) for n in range(3000) for o in ("a", "b") for _ in range(3)]
    rng.shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    first, want = {}, {}
    for batch in batches:
        for o, n, root, k in sorted(batch):
            if k >= 3 and first.setdefault((o, n), root) != root:
                want.setdefault((o, n), tuple(sorted((first[o, n], root))))
    seen = Progress()
    spark.streams.addListener(seen)
    got = [tuple(r) for r in drained(loops.monitor_heads(files(spark, f"{tmp_path}/in", batches, kind), 3), str(tmp_path)).collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(seen)
    assert sorted(got) == sorted((*key, *roots) for key, roots in want.items()) and len(got) > 1000
    assert max(r[4] for r in seen.rows) == 2


def test_commits_wait_for_their_gap_in_any_order(spark, tmp_path):
    import random

    from proofyard.plans.streams import drained

    rng = random.Random(6)
    rows = [(log, i, f"{log}{i}") for log in "abc" for i in range(4000) if (log, i) != ("b", 3500)]
    rows += rng.choices(rows, k=500)
    rng.shuffle(rows)
    staged = files(spark, f"{tmp_path}/in", [rows[:4000], rows[4000:9000], [("a", 0, "again")], rows[9000:], [("b", 2, "again")]], "log_did string, sequence_number long, canonical_hash string")
    out = loops.commit_ordered(staged)
    got = drained(out, str(tmp_path))
    want = {(log, i, f"{log}{i}") for log in "abc" for i in range(3500 if log == "b" else 4000)}
    again = next(j for j, r in enumerate(rows) if r[:2] == ("a", 0)) >= 9000  # where the other hash came first
    assert {tuple(r) for r in got.collect()} == (want - {("a", 0, "a0")} | {("a", 0, "again")} if again else want) and got.count() == len(want)


def test_ship_goes_on_after_a_restart(spark, tmp_path):
    kind, out = "sequence_number long, canonical_hash string, data binary", f"{tmp_path}/out"
    path = f"{tmp_path}/in"
    fails = (F.col("sequence_number") == 2) & (F.col("attempts") < 2) | (F.col("sequence_number") == 3)
    files(spark, path, [[(i, f"h{i}", bytearray(b"x")) for i in range(4)]], kind)
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    loops.ship(read(), out, f"{tmp_path}/state", fails, 3).awaitTermination()
    assert sorted(r["sequence_number"] for r in spark.read.parquet(out).collect()) == [0, 1]
    files(spark, path, [[(9, "h9", bytearray(b"y"))]], kind)
    loops.ship(read(), out, f"{tmp_path}/state", fails, 3).awaitTermination()
    loops.shipped_rest(spark, out, fails, 3)
    assert sorted(r["sequence_number"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 9]
    assert [(r["sequence_number"], r["attempts"]) for r in spark.read.parquet(out + "_manual").collect()] == [(3, 3)]


def test_sequences_go_on_after_a_restart_and_unmarked_batches_do_not_count(spark, tmp_path):
    kind, out, path = "canonical_hash string, ord long", f"{tmp_path}/out", f"{tmp_path}/in"
    files(spark, path, [[("b", 2), ("a", 1), ("a", 5)], [("c", 3), ("a", 9)]], kind)
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    loops.sequence(read(), out, f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([(77, "z")], "sequence_number long, canonical_hash string").write.parquet(f"{out}/batch_id=9")
    (tmp_path / "out" / "batch_id=9" / "_SUCCESS").unlink()
    files(spark, path, [[("z", 1), ("b", 4)]], kind)
    loops.sequence(read(), out, f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(*changes.published(spark, out)).collect()
    assert sorted((r["sequence_number"], r["canonical_hash"]) for r in got) == [(0, "a"), (1, "b"), (2, "c"), (3, "z")]


def test_migrations_run_in_order_and_refuse_unknown_ones(spark):
    pending = spark.createDataFrame([(3, "c"), (2, "b")], "version int, description string")
    one = spark.range(1)
    seen = []
    steps = {v: (lambda t, v=v: seen.append(v) or {"x": t["x"].withColumn(f"c{v}", F.lit(v))}) for v in (2, 3)}
    tables, done = changes.migrate({"x": one}, pending, steps)
    assert done == seen == [2, 3] and tables["x"].columns == ["id", "c2", "c3"]
    assert changes.migrate({"x": one}, pending, {}, check_only=True)[1] == [2, 3]
    with pytest.raises(ValueError):
        changes.migrate({"x": one}, pending, {2: steps[2]})


def test_batches_of_many_rows_are_several_files_and_one_batch(spark, tmp_path, monkeypatch):
    from proofyard.plans import streams

    monkeypatch.setattr(streams, "ROWS", 50)
    seen = []
    # from 600 on all rows tie, so that a batch has none
    stream = streams.as_stream(spark.range(1000).select("id", F.least("id", F.lit(600)).alias("o")), f"{tmp_path}/in", order="o")
    stream.writeStream.foreachBatch(lambda b, i: seen.append([tuple(r) for r in b.collect()])).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for b in seen for r in b) == list(range(1000)) and len(seen) == 3
    assert len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) == 21
    seen = [b for b in seen if b]
    assert all(max(r[1] for r in a) < min(r[1] for r in b) for a, b in zip(seen, seen[1:]))


def test_commits_by_batches_give_what_arrives_first_in_dense_order(spark, tmp_path):
    import random

    rng, kind = random.Random(7), "log_did string, sequence_number long, canonical_hash string"
    rows = [(log, i, f"{log}{i}.{k}") for log in ("a", "b", None) for i in range(-1, 300) for k in range(rng.choice([1, 1, 2])) if (log, i) != ("b", 211)]
    rng.shuffle(rows)
    dense = [("c", i, f"c{i}") for i in range(150)]
    batches = [rows[:300], rows[300:700] + dense[:64], dense[:20] + rows[700:], [("a", 900, "early"), ("b", None, "none"), *dense[64:]], [("b", 211, "x"), ("b", 212, "again")]]
    heap, after, want = {}, {}, []
    for batch in batches:
        held = dict(heap)
        for log, i, h in batch:
            if i is not None and i >= after.get(log, 0) and (log, i) not in held:
                heap[log, i] = min(h, heap.get((log, i), h))
        now = []
        for log in ("a", "b", "c", None):
            while (log, after.get(log, 0)) in heap:
                i = after.get(log, 0)
                now.append((log, i, heap.pop((log, i))))
                after[log] = i + 1
        want.append(now)
    key = lambda r: (str(r[0]), *r[1:])
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, batch in enumerate(batches):  # a restart before each
        loops.commit(files(spark, path, [batch], kind), out, f"{tmp_path}/state", width=16).awaitTermination()
        got = [tuple(r) for r in spark.read.schema(kind).parquet(f"{out}/batch_id={i}").collect()]
        assert sorted(got, key=key) == sorted(want[i], key=key)
    assert sorted(map(tuple, loops.committed(spark, out).collect()), key=key) == sorted(sum(want, []), key=key)
    assert [len(b) > 0 for b in want[1:]] == [True] * 4
    waiting = spark.read.parquet(f"{out}_waiting").where("batch_id = 4").drop("batch_id")
    assert [tuple(r) for r in waiting.collect()] == [("a", 900, "early")]
