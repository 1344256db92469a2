"""Changes to tables and folded state (survey O, R16, M8, X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import changes as c
from ..operators import ordered, windows
from ..operators import state as s
from ..schemas import migrations, pending_migrations
from . import fixtures as fx
from .registry import query


@query("SELECT canonical_hash, sequence_number, 'refused' AS outcome FROM f_documents WHERE status = 0 AND sequence_number % 3 = 0 UNION ALL SELECT canonical_hash, sequence_number, 'appended' FROM f_documents WHERE status = 0 AND sequence_number % 3 = 1")
def insert_rows(spark, d):
    docs = fx.documents(spark, d).where("status = 0").select("canonical_hash", "sequence_number")
    new, refused = c.insert(docs.where("sequence_number % 3 <> 1"), docs.where("sequence_number % 3 <> 2"), ["canonical_hash"])
    return new.withColumn("outcome", F.lit("appended")).unionByName(refused.withColumn("outcome", F.lit("refused")))


@query("""SELECT user_id, arg_max(event_type, event_id) AS last_type FROM (SELECT user_id, event_id, event_type FROM events) GROUP BY 1""")
def upsert_leaves(spark, d):
    e = fx.table(spark, d, "events").select("user_id", F.col("event_type").alias("last_type"), "event_id")
    old = c.upsert(e.where("false").select("user_id", "last_type"), e.where("event_id % 2 = 0"), ["user_id"], "event_id")
    # the second half is written over the first only where it is newer
    later = e.join(e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("m")), "user_id", "left").where("event_id % 2 = 1 and (m is null or event_id > m)").drop("m")
    return c.upsert(old, later, ["user_id"], "event_id")


@query("SELECT event_type AS k, min(event_id) AS event_id FROM events WHERE event_type <> 'click' GROUP BY 1")
def insert_if_absent(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("k"), "event_id")
    return c.insert_if_absent(e.where("k = 'click'").limit(1), e, ["k"], F.col("event_id"))


@query("SELECT leaf_key, origin_tip FROM f_leaves WHERE user_id % 6 <> 0")
def delete_leaves(spark, d):
    leaves = fx.leaves(spark, d)
    return c.delete(leaves.select("leaf_key", "origin_tip"), leaves.where("user_id % 6 = 0"), ["leaf_key"])


@query("""SELECT coalesce(k.exchange_did, a.exchange_did) AS exchange_did, coalesce(balance, 0) + coalesce(n, 0) AS balance, coalesce(total_purchased, 0) + coalesce(n, 0) AS total_purchased, coalesce(total_consumed, 0) AS total_consumed
FROM f_credits k FULL JOIN (SELECT exchange_did, CAST(sum(o_orderkey % 5 - 1) FILTER (o_orderkey % 5 - 1 > 0) AS BIGINT) AS n FROM f_requests GROUP BY 1) a USING (exchange_did)""")
def credit_purchase(spark, d):
    return c.purchase(fx.credits(spark, d), fx.requests(spark, d).withColumn("amount", F.col("o_orderkey") % 5 - 1))


@query("SELECT exchange_did, o_orderkey, row_number() OVER (PARTITION BY exchange_did ORDER BY o_orderkey) <= coalesce(balance, 0) AS admitted FROM f_requests LEFT JOIN f_credits USING (exchange_did)")
def credit_admission(spark, d):
    return c.admit_by_credit(fx.requests(spark, d), fx.credits(spark, d), "o_orderkey")


@query("SELECT name, max(value) AS value FROM (SELECT event_type AS name, event_id AS value FROM events WHERE event_id % 10 = 1 UNION ALL SELECT 'builder', CAST(7 AS BIGINT)) GROUP BY 1")
def monotonic_marks(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("value"))
    marks = spark.range(1).select(F.lit("builder").alias("name"), F.lit(7).cast("long").alias("value"))
    return c.advance(c.advance(marks, e.where("value % 10 = 1")), e.where("value % 10 = 1 and value < 100"))


@query("SELECT CAST(1 AS INT) AS id, max(event_id) AS last FROM events")
def cursor_set(spark, d):
    e = fx.table(spark, d, "events")
    row = lambda x: e.agg(F.lit(1).alias("id"), x.alias("last"))
    return c.overwrite(row(F.min("event_id")), row(F.max("event_id")))


@query("SELECT sequence_number, canonical_hash, sequence_number > min(sequence_number) OVER (PARTITION BY canonical_hash) AS duplicate FROM f_documents")
def batch_duplicates(spark, d):
    return c.first_of_batch(fx.documents(spark, d).select("sequence_number", "canonical_hash"), "canonical_hash", "sequence_number")


@query("SELECT event_id AS seq, event_type AS kind FROM events")
def unnest_batch(spark, d):
    e = fx.table(spark, d, "events").groupBy(F.expr("event_id div 50").alias("b")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    arrays = e.select(F.transform("x", lambda y: y["event_id"]).alias("seq"), F.transform("x", lambda y: y["event_type"]).alias("kind"))
    return c.parallel_rows(arrays, "seq", "kind")


@query("SELECT CAST(v AS INT) AS version, n AS description FROM (VALUES (5, 'entry status'), (6, 'ghost leaves'), (7, 'root of the state tree in heads'), (8, 'delegate column')) t(v, n)")
def migrations_pending(spark, d):
    return pending_migrations(migrations(spark), spark.range(1, 5).select(F.col("id").cast("int").alias("version")))


@query("SELECT hash, attempts, CASE WHEN attempts >= 10 THEN 'manual' ELSE 'retry' END AS action FROM f_journal")
def retry_classes(spark, d):
    return s.classified_failures(fx.journal(spark, d))


@query("SELECT sequence_number, CASE WHEN sequence_number % 41 = 6 THEN 'did:system' ELSE signer_did END AS signer_did, CAST(CASE WHEN sequence_number % 41 = 6 THEN 1 ELSE status END AS INT) AS status FROM f_entries")
def tombstone_rows(spark, d):
    e = fx.entries(spark, d).withColumn("dispatch_error", F.when(F.col("sequence_number") % 41 == 6, "cannot decode"))
    return s.tombstones(e, "did:system").select("sequence_number", "signer_did", "status")


@query("SELECT max(event_id) AS cursor FROM events")
def cursor_commit(spark, d):
    return s.cursor_commit(fx.entries(spark, d), None)


# The journal's state machine, against its rules written out for the operations of each hash: of the last digit of the
# sequence 0-5 submit, sequence, ship; 6-7 submit, sequence, retry, retry, sequence another (refused); 8 submit, ship
# (refused); 9 submit, sequence, manual, ship, manual (refused).
@query("""SELECT hash, CAST(CASE WHEN m < 6 OR m = 9 THEN 3 WHEN m < 8 THEN 2 ELSE 1 END AS INT) AS state, CASE WHEN m <> 8 THEN sequence END AS sequence, CAST(CASE WHEN m IN (6, 7) THEN 2 ELSE 0 END AS INT) AS attempts,
CAST(CASE WHEN m >= 6 THEN 1 ELSE 0 END AS INT) AS refused FROM (SELECT *, sequence % 10 AS m FROM f_journal)""")
def journal_states(spark, d):
    j = fx.journal(spark, d)
    op = lambda name, seq=None: F.struct(F.lit(name).alias("op"), (F.col("sequence") if seq is None else seq).alias("sequence"))
    m = F.col("sequence") % 10
    ops = (
        F.when(m < 6, F.array(op("submit"), op("sequence"), op("ship"))).when(m < 8, F.array(op("submit"), op("sequence"), op("retry"), op("retry"), op("sequence", F.col("sequence") + 1)))
        .when(m == 8, F.array(op("submit"), op("ship"))).otherwise(F.array(op("submit"), op("sequence"), op("manual"), op("ship"), op("manual"))))
    return s.fold_journal(j.select("hash", F.posexplode(ops).alias("ord", "o")).select("hash", "ord", "o.*"))


def _authority(spark, d):
    """Entries with authorities: of ten in a row a new leaf, a delegation target and so on, all within the ten."""
    e = fx.entries(spark, d)
    i, m = F.col("sequence_number"), F.col("sequence_number") % 10
    t = F.when(m == 2, i - 2).when(m.isin(3, 4), i - m).when(m == 6, i - 6).when(m == 7, i - 2).when(m == 8, i - 3).when(m == 9, i - 9)
    return e.select(
        i, "signer_did", F.when(m.isin(0, 1, 2, 5, 9), "same_signer").when(m.isin(3, 4), "delegation").when(m.isin(6, 7, 8), "scope").alias("authority"), t.alias("target_seq"),
        F.lit(None).cast("long").alias("intermediate_seq"), (m == 9).alias("foreign"), F.when(m == 3, i - 2).when(m == 4, i - 4).alias("delegation_seq"), F.when(m.isin(6, 7, 8), i - m + 5).alias("scope_seq"),
        F.when(m == 5, F.array(F.lit("nobody"), F.col("signer_did"), F.lit("did:user:1"), F.lit("did:user:2"), F.lit("did:user:3"))).when(m == 8, F.array("signer_did")).alias("authority_set"))


_PATHS = """SELECT e.sequence_number, CASE WHEN e.m IN (0, 1, 5) THEN 'new_leaf' WHEN e.m = 2 THEN 'path_a' WHEN e.m = 3 THEN 'path_b' WHEN e.m = 9 THEN 'path_d' WHEN e.m = 4 THEN 'path_d'
WHEN e.signer_did IN ('did:user:1', 'did:user:2', 'did:user:3') OR e.signer_did = s.signer_did THEN 'path_c' ELSE 'path_d' END AS path, e.m
FROM (SELECT *, sequence_number % 10 AS m FROM f_entries) e LEFT JOIN f_entries s ON s.sequence_number = e.sequence_number - e.m + 5"""


@query(f"SELECT sequence_number, path FROM ({_PATHS})")
def authority_paths(spark, d):
    return s.paths(_authority(spark, d)).select("sequence_number", "path")


@query(f"""WITH p AS ({_PATHS}), w AS (SELECT sequence_number AS leaf_seq, sequence_number AS o, sequence_number AS a FROM p WHERE path = 'new_leaf'
UNION ALL SELECT sequence_number - m, sequence_number, NULL FROM p WHERE m IN (2, 3) UNION ALL SELECT sequence_number - 6, NULL, sequence_number FROM p WHERE m = 6 AND path = 'path_c'
UNION ALL SELECT sequence_number - 2, NULL, sequence_number FROM p WHERE m = 7 AND path = 'path_c' UNION ALL SELECT sequence_number - 3, sequence_number, NULL FROM p WHERE m = 8 AND path = 'path_c')
SELECT leaf_seq, max(o) AS origin_tip, max(a) AS authority_tip FROM w GROUP BY 1""")
def smt_fold(spark, d):
    return s.fold_leaves(s.paths(_authority(spark, d)))


@query(f"""SELECT sequence_number // 1000 AS batch, count(*) FILTER (path = 'new_leaf') AS new_leaf, CAST(0 AS BIGINT) AS commentary, count(*) FILTER (path = 'path_a') AS path_a, count(*) FILTER (path = 'path_b') AS path_b,
count(*) FILTER (path = 'path_c') AS path_c, count(*) FILTER (path = 'path_d') AS path_d FROM ({_PATHS}) GROUP BY 1""")
def path_counts(spark, d):
    from ..operators.aggregates import path_counts as counted

    return counted(s.paths(_authority(spark, d)), 1000)


_WRITES = """SELECT sequence_number, leaf_seq, o, a FROM (SELECT sequence_number, sequence_number AS leaf_seq, sequence_number AS o, sequence_number AS a FROM p WHERE path = 'new_leaf'
UNION ALL SELECT sequence_number, sequence_number - m, sequence_number, NULL FROM p WHERE m IN (2, 3) UNION ALL SELECT sequence_number, sequence_number - 6, NULL, sequence_number FROM p WHERE m = 6 AND path = 'path_c'
UNION ALL SELECT sequence_number, sequence_number - 2, NULL, sequence_number FROM p WHERE m = 7 AND path = 'path_c' UNION ALL SELECT sequence_number, sequence_number - 3, sequence_number, NULL FROM p WHERE m = 8 AND path = 'path_c')"""
# every batch's whole state as a list with a place for each index, folded to its root level by level
_ROOTS = """WITH RECURSIVE p AS ({paths}), w AS ({writes}), ids AS (SELECT DISTINCT sequence_number // {width} AS id FROM w), top AS (SELECT max(leaf_seq) AS n FROM w),
st AS (SELECT id, leaf_seq, max(o) AS o, max(a) AS a FROM ids, w WHERE sequence_number // {width} <= id GROUP BY 1, 2 HAVING max(a) IS NOT NULL),
t AS (SELECT 0 AS lvl, id, list(coalesce(h, sha256('')) ORDER BY i) AS r FROM (SELECT ids.id, i, CASE WHEN st.id IS NOT NULL THEN sha256(concat_ws('|', leaf_seq, coalesce(o, -1), a)) END AS h
  FROM ids, (SELECT unnest(range(0, (SELECT n + 1 FROM top))) AS i) x LEFT JOIN st ON st.id = ids.id AND st.leaf_seq = i) GROUP BY id
UNION ALL SELECT lvl + 1, id, [CASE WHEN c = repeat(sha256(''), 16) THEN sha256('') ELSE sha256(c) END FOR c IN [array_to_string([coalesce(r[16 * i + 1 + k], sha256('')) FOR k IN range(0, 16)], '') FOR i IN range(0, (len(r) + 15) // 16)]] FROM t WHERE lvl = 0 OR len(r) > 1),
roots AS (SELECT id, r[1] AS root FROM t WHERE lvl > 0 AND len(r) = 1)"""


@query(f"""{_ROOTS.format(paths=_PATHS, writes=_WRITES, width=1000)}
SELECT id, min(sequence_number) AS range_start_seq, max(sequence_number) AS range_end_seq, root AS post_root, coalesce(lag(root) OVER (ORDER BY id), sha256('')) AS prior_root, count(DISTINCT leaf_seq) AS mutations
FROM w JOIN roots ON id = sequence_number // 1000 GROUP BY id, root""")
def derivation_commitments(spark, d):
    got = s.commitments(s.leaf_writes(s.paths(_authority(spark, d))), 1000)
    n = F.size(F.from_json("mutations_json", "array<struct<leaf_seq:long>>")).cast("long")
    return got.select("id", "range_start_seq", "range_end_seq", "post_root", "prior_root", n.alias("mutations"))


@query(f"""{_ROOTS.format(paths=_PATHS, writes=_WRITES, width=1 << 40)}
SELECT (SELECT count(*) FROM f_entries) AS entries, (SELECT count(*) FROM f_entries WHERE sequence_number % 2110 = 19) AS corrupt, (SELECT count(*) FROM st) AS leaves, root, true AS agrees FROM roots""", python=True)
def rebuild_state(spark, d):
    """From bytes to root: entries' envelopes as JSON in the store and their hashes in bundles are read back, hashed and
    parsed; what is damaged is left out (entries without an effect are, here), the rest is folded, and the root held
    against that of the state as it was."""
    from ..operators import merkle
    from ..sources.store import write_entries
    from .merkle import hash_bundles, rebuilt
    from .streams import folder

    header = "sequence_number long, signer_did string, authority string, target_seq long, intermediate_seq long, foreign boolean, delegation_seq long, scope_seq long, authority_set array<string>"
    entries, path = _authority(spark, d), folder(spark)
    written = entries.select("sequence_number", F.to_json(F.struct(*entries.columns)).cast("binary").alias("data"))
    written = written.withColumn("canonical_hash", F.sha2("data", 256))
    write_entries(written.withColumn("data", F.when(F.col("sequence_number") % 2110 == 19, F.concat("data", F.lit(b" "))).otherwise(F.col("data"))), path)
    store = spark.read.parquet(path)
    verdicts = rebuilt(written, hash_bundles(written), store)
    whole = store.join(verdicts.where("verdict = 'ok'").select("sequence_number", "canonical_hash"), ["sequence_number", "canonical_hash"])
    back = whole.select(F.from_json(F.col("data").cast("string"), header).alias("h")).select("h.*")
    leaves, before = s.fold_leaves(s.paths(back)), s.fold_leaves(s.paths(entries))
    counts = verdicts.agg(F.count("*").alias("entries"), F.count_if(F.col("verdict") == "corrupt").alias("corrupt"))
    both = merkle.state_root(leaves).join(merkle.state_root(before).withColumnRenamed("root", "persisted"))
    return counts.join(leaves.agg(F.count("*").alias("leaves"))).join(both).select("entries", "corrupt", "leaves", "root", (F.col("root") == F.col("persisted")).alias("agrees"))


# Writes of users' leaves that name an earlier event of theirs: the last, the one before, the twelfth before, none.
_TIPS = """SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 1 THEN lag(event_id, 2) OVER w WHEN event_id % 16 = 2 THEN lag(event_id, 12) OVER w ELSE lag(event_id) OVER w END AS prior,
row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


@query(f"""WITH RECURSIVE t AS ({_TIPS}), f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS tips, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT user_id FROM t)
UNION ALL SELECT user_id, n, CASE WHEN reason = 'stale' THEN tips ELSE list_append(tips, event_id)[-10:] END, event_id, reason FROM (
  SELECT t.user_id, t.n, f.tips, t.event_id, CASE WHEN t.prior IS NULL THEN 'first' WHEN t.prior = f.tips[-1] THEN 'tip' WHEN t.user_id % 2 = 0 AND list_contains(f.tips, t.prior) THEN 'window' ELSE 'stale' END AS reason
  FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1))
SELECT user_id AS leaf, event_id AS sequence_number, reason <> 'stale' AS accepted, reason FROM f WHERE n > 0""", python=True)
def delta_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    i = F.col("event_id")
    prior = F.when(i % 17 == 0, None).when(i % 4 == 1, F.lag("event_id", 2).over(w)).when(i % 16 == 2, F.lag("event_id", 12).over(w)).otherwise(F.lag("event_id").over(w))
    rows = fx.table(spark, d, "events").select(F.col("user_id").alias("leaf"), i.alias("sequence_number"), prior.alias("prior"), (F.col("user_id") % 2 == 0).alias("commutative"))
    return ordered.delta_window(rows)


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, event_id % 700 + 40 AS b, event_id // 3 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, CAST(0 AS BIGINT) AS flush, CAST(1 AS BIGINT) AS k, b, ms AS since FROM t WHERE n = 1
UNION ALL SELECT user_id, n, event_id, CASE WHEN done THEN flush + 1 ELSE flush END, CASE WHEN done THEN 1 ELSE k + 1 END, CASE WHEN done THEN nb ELSE b + nb END, CASE WHEN done THEN nat ELSE since END
  FROM (SELECT t.user_id, t.n, t.event_id, f.flush, f.k, f.b, f.since, t.b AS nb, t.ms AS nat, f.k >= 4 OR f.b + t.b > 1500 OR t.ms - f.since > 900 AS done FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1))
SELECT user_id, event_id, flush FROM f""", python=True)
def group_commit(spark, d):
    i = F.col("event_id")
    rows = fx.table(spark, d, "events").select("user_id", "event_id", (i % 700 + 40).alias("n_bytes"), F.expr("event_id div 3").alias("at_ms"))
    return ordered.group_commits(rows, "user_id", "event_id", 4, 1500, 900)


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, event_id * 10 AS ms, event_id % 5 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'closed' AS kind, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS since, CAST(NULL AS VARCHAR) AS seen FROM (SELECT DISTINCT user_id FROM t)
UNION ALL SELECT user_id, n, event_id, CASE WHEN seen = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN seen = 'half_open' OR failed + 1 >= 3 THEN 'open' ELSE seen END, CASE WHEN seen = 'open' THEN failed WHEN ok THEN 0 ELSE failed + 1 END,
  CASE WHEN seen <> 'open' AND NOT ok AND (seen = 'half_open' OR failed + 1 >= 3) THEN ms ELSE since END, seen
  FROM (SELECT t.user_id, t.n, t.event_id, t.ms, t.ok, f.failed, f.since, CASE WHEN f.kind = 'open' AND t.ms - f.since >= 4000 THEN 'half_open' ELSE f.kind END AS seen FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1))
SELECT user_id, event_id, seen AS state, seen <> 'open' AS allowed FROM f WHERE n > 0""", python=True)
def circuit_breaker(spark, d):
    i = F.col("event_id")
    return ordered.breaker(fx.table(spark, d, "events").select("user_id", "event_id", (i * 10).alias("at_ms"), (i % 5 == 0).alias("ok")), "user_id", "event_id", 3, 4000)


@query("SELECT sequence_number, CASE WHEN sequence_number % 71 = 4 THEN 'deleted' ELSE 'updated' END AS violation FROM f_entries WHERE sequence_number % 71 = 4 OR sequence_number % 83 = 9")
def append_only_guard(spark, d):
    e = fx.entries(spark, d).select("sequence_number", "canonical_hash", "target_root")
    later = e.where("sequence_number % 71 <> 4").withColumn("target_root", F.when(F.col("sequence_number") % 83 == 9, "x").otherwise(F.col("target_root")))
    return c.append_only_violations(e, later.unionByName(later.limit(1).withColumn("sequence_number", F.lit(-1).cast("long"))), ["sequence_number"])


@query("SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 75")
def cache_eviction(spark, d):
    return c.evict(fx.table(spark, d, "events"), "user_id", "event_id", 100)


@query("SELECT CAST(v AS INT) AS version, t AS tables FROM (VALUES (5, 'entry_index'), (6, 'entry_index,ghosts'), (7, 'entry_index,ghosts'), (8, 'entry_index,ghosts')) x(v, t)")
def migrations_applied(spark, d):
    e = fx.entries(spark, d).select("sequence_number", "canonical_hash").limit(10)
    steps = {
        5: lambda t: {"entry_index": t["entry_index"].withColumn("status", F.lit(0))}, 6: lambda t: {"ghosts": t["entry_index"].where("status = 2")},
        7: lambda t: {}, 8: lambda t: {"entry_index": t["entry_index"].withColumn("delegate_did", F.lit(None).cast("string"))},
    }
    pending, seen, tables = pending_migrations(migrations(spark), spark.range(1, 5).select(F.col("id").cast("int").alias("version"))), [], {"entry_index": e}
    for version in sorted(steps):
        tables, done = c.migrate(tables, pending.where(F.col("version") == version), steps)
        seen += [(v, ",".join(sorted(tables))) for v in done]
    return spark.createDataFrame(seen, "version int, tables string")


@query("SELECT hash, CASE WHEN attempts + 1 >= 10 THEN 'manual' ELSE 'sequence' END AS op, CAST(attempts + 1 AS INT) AS attempts FROM f_journal WHERE state = 1 AND 10000000 - last_err_ns > 9000000")
def stale_redriven(spark, d):
    return s.redriven(fx.journal(spark, d), 10_000_000, 9_000_000)


@query("SELECT sequence_number, (SELECT min(sequence_number) FROM f_entries WHERE sequence_number > 500 AND sequence_number % 499 = 90) - 1 AS mark FROM f_entries WHERE sequence_number > 500 AND sequence_number < (SELECT min(sequence_number) FROM f_entries WHERE sequence_number > 500 AND sequence_number % 499 = 90)")
def replay_until_failure(spark, d):
    return s.replayed(fx.entries(spark, d).select("sequence_number"), 500, F.col("sequence_number") % 499 == 90)


@query("""SELECT sequence_number, CASE WHEN sequence_number % 13 = 5 THEN 'signer,time' WHEN sequence_number % 7 = 4 THEN 'time' ELSE '' END AS missing, CASE WHEN sequence_number % 13 <> 5 THEN signer_did END AS signer FROM f_entries""")
def json_records(spark, d):
    i = F.col("sequence_number")
    text = F.when(i % 13 == 5, F.lit("no json")).when(i % 7 == 4, F.to_json(F.struct(F.col("signer_did").alias("signer")))).otherwise(F.to_json(F.struct(F.col("signer_did").alias("signer"), F.lit(5).alias("time"))))
    got = codecs.json_record(text, "signer string, time long", ["signer", "time"])
    return fx.entries(spark, d).select("sequence_number", got.alias("r")).select("sequence_number", F.array_join("r.missing", ",").alias("missing"), F.col("r.record.signer").alias("signer"))


@query("SELECT tree_size, hash_algo, CASE WHEN tree_size % 9 <> 2 THEN tree_size END AS head_size, CASE WHEN tree_size % 9 <> 2 THEN root_hash END AS head_root FROM f_heads")
def head_of_event(spark, d):
    root = F.when(F.col("tree_size") % 9 == 2, F.substring("root_hash", 1, 60)).otherwise(F.col("root_hash"))
    body = F.to_json(F.struct("tree_size", root.alias("root_hash")))
    return fx.heads(spark, d).select("tree_size", "hash_algo", codecs.head_of_body(body).alias("h")).select("tree_size", "hash_algo", F.col("h.tree_size").alias("head_size"), F.col("h.root_hash").alias("head_root"))


@query("""SELECT signer_did, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(signer_did, '')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS fnv,
list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(signer_did, '')]), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 64 AS shard FROM (SELECT DISTINCT signer_did FROM f_entries)""")
def shard_hashes(spark, d):
    return fx.entries(spark, d).select("signer_did").distinct().select("signer_did", codecs.fnv1a(F.col("signer_did")).alias("fnv"), codecs.fnv1a(F.col("signer_did"), 64).alias("shard"))


@query("""SELECT l.sequence_number AS ord, l.signer_did AS did, l.sequence_number AS at, max(e.sequence_number) AS sequence_number FROM f_entries l LEFT JOIN f_entries e ON e.delegate_did = l.signer_did AND e.status = 0 AND e.sequence_number < l.sequence_number GROUP BY 1, 2, 3""")
def delegation_asof(spark, d):
    e = fx.entries(spark, d)
    return windows.delegation_asof(e.select(F.col("sequence_number").alias("ord"), F.col("signer_did").alias("did"), F.col("sequence_number").alias("at")), e)


@query(f"""WITH h AS (SELECT originator, max(lamport) AS clock, arg_max(event_id, lamport) AS head FROM f_gossip GROUP BY 1),
n AS (SELECT 'did:conv:' || (sequence_number % 40) AS originator, sequence_number, canonical_hash, row_number() OVER (PARTITION BY sequence_number % 40 ORDER BY sequence_number) AS k FROM f_entries),
r AS (SELECT n.originator, coalesce(clock, 0) + k AS lamport, sha256(concat_ws('|', n.originator, coalesce(clock, 0) + k, 'head', canonical_hash)) AS event_id, head FROM n LEFT JOIN h USING (originator))
SELECT originator, lamport, event_id, coalesce(lag(event_id) OVER (PARTITION BY originator ORDER BY lamport), head, '{fx.ZERO}') AS prev_hash FROM r""")
def gossip_publish(spark, d):
    heads = fx.gossip(spark, d).groupBy("originator").agg(F.max("lamport").alias("lamport"), F.max_by("event_id", "lamport").alias("event_id"))
    new = fx.entries(spark, d).select(F.concat(F.lit("did:conv:"), (F.col("sequence_number") % 40).cast("string")).alias("originator"), F.col("sequence_number").alias("ord"), F.lit("head").alias("kind"), F.col("canonical_hash").alias("body"))
    return windows.chained(new, heads).select("originator", "lamport", "event_id", "prev_hash")


@query("SELECT CAST(epoch(TIMESTAMP '2030-01-01') - epoch(max(created_at)) AS BIGINT) AS seconds FROM f_heads")
def cosign_age(spark, d):
    return s.cosign_age(fx.heads(spark, d), "2030-01-01 00:00:00")
