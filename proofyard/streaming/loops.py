"""The log's loops as Structured Streaming queries. Progress is by sequence: what is out of order waits for its gap and is
never dropped, so no watermark is used and state grows with its keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import publish, published
from ..operators.windows import WIDTH, prefix_ends, ranked
from ..saving import saved

_CODES = "sequence_number long, canonical_hash string"
_STAGED, _MARKS = f"log_did string, {_CODES}", "log_did string, next long, again long"
SIZES = 4096  # of a log that share one row of a monitor's state


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict | None = None):
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def admit(submissions: DataFrame, judge, accepted: str, rejected: str, checkpoint: str, **trigger):
    """Judge submissions as they come; both outcomes are written under the batch's id, so a batch that runs again after
    a crash adds nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        judged = judge(batch).persist()
        publish(judged.where("reject_class is null").drop("reject_class"), accepted, batch_id)
        publish(judged.where("reject_class is not null"), rejected, batch_id)
        judged.unpersist()

    return _start(submissions, each, checkpoint, trigger)


def sequence(pending: DataFrame, out: str, checkpoint: str, **trigger):
    """Give hashes that have none the next sequences, in order of arrival (ord). One writer: the numbers of a batch
    follow those of the batches before, which a table of one row a batch holds; of earlier batches only the hashes are
    read, and only of those that are marked. Ranks come from counts of ranges of the order, not from one window."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("canonical_hash").agg(F.min("ord").alias("ord"))
        base = 0
        if done := published(spark, out, batch_id):
            first = first.join(spark.read.schema(_CODES).parquet(*done).select("canonical_hash"), "canonical_hash", "left_anti")
            base = spark.read.schema("next long").parquet(*published(spark, out + "_marks", batch_id)).agg(F.max("next")).first()[0]
        publish(ranked(saved(first), "ord", base).select(F.col("place").alias("sequence_number"), "canonical_hash"), out, batch_id)
        n = spark.read.schema(_CODES).parquet(f"{out}/batch_id={batch_id}").count()
        publish(spark.createDataFrame([(base + n,)], "next long"), out + "_marks", batch_id)

    return _start(pending, each, checkpoint, trigger)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _pack(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state: compressed columns."""
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_pandas()


def _commit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    expected, waiting = state.get if state.exists else (0, None)
    names = ["sequence_number", "canonical_hash"]
    rows = pd.concat([*([] if waiting is None else [_unpack(waiting)]), *(f[names] for f in frames)], ignore_index=True)
    rows = rows[rows["sequence_number"] >= expected].drop_duplicates("sequence_number").sort_values("sequence_number", ignore_index=True)  # the first to arrive stays
    rows["sequence_number"] = rows["sequence_number"].astype("int64")
    gap = rows["sequence_number"].to_numpy() != expected + np.arange(len(rows))
    n = int(gap.argmax()) if gap.any() else len(rows)
    state.update((expected + n, _pack(rows[n:]) if n < len(rows) else None))
    out = rows[:n]
    out.insert(0, "log_did", key[0])
    yield out


def commit_ordered(staged: DataFrame) -> DataFrame:
    """Staged rows (log_did, sequence_number, canonical_hash) in dense order of each log: what arrives early waits in the
    log's state, in one value, what arrives again is dropped. A log's waiting rows must fit one task; `commit` takes longer
    logs."""
    return staged.groupBy("log_did").applyInPandasWithState(
        _commit, _STAGED, "expected long, waiting binary", "append", GroupStateTimeout.NoTimeout)


def _once(rows: DataFrame) -> DataFrame:
    """Of the rows of a log's sequence the one that arrived first; of those of one batch the lowest hash, so that a batch
    that runs again takes the same. Sorted by sequence first, as names of logs begin alike."""
    by = Window.partitionBy("sequence_number", "log_did").orderBy("late", "canonical_hash")
    return rows.withColumn("_before", F.lag("late").over(by)).where("_before is null")


def commit(staged: DataFrame, out: str, checkpoint: str, width: int = WIDTH, **trigger):
    """Staged rows (log_did, sequence_number, canonical_hash) in dense order of each log, as `commit_ordered` gives them,
    written to `out` under the batch's id, for logs of any length: a batch's prefix is found by counts of buckets of
    `width` sequences. What arrives early waits in out_waiting, each log's next sequence is in out_marks; the folders of
    the last two batches are kept, as a batch that runs again reads those before it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("log_did", F.col("sequence_number").cast("long").alias("sequence_number"), "canonical_hash").persist()
        none = new.limit(0)  # is planned as empty, so that the first batch joins nothing

        def last(name: str, empty: DataFrame) -> DataFrame:
            path = f"{out}_{name}/batch_id={batch_id - 1}"
            return spark.read.schema(empty.schema).parquet(path) if _exists(spark, path + "/_SUCCESS") else empty

        rows = last("waiting", none).withColumn("late", F.lit(False)).unionByName(new.withColumn("late", F.lit(True)))
        done = last("marks", none.select("log_did", F.col("sequence_number").alias("next"))).withColumn("again", F.lit(0).cast("long"))
        rows = _beside(rows, done).withColumn("first", F.coalesce("next", F.lit(0).cast("long"))).drop("next", "again").where("sequence_number >= first")
        ends = done.unionByName(prefix_ends(rows, "log_did", "first", width=width))
        publish(ends.groupBy("log_did").agg(F.max("next").alias("next"), F.max("again").alias("again")), out + "_marks", batch_id)
        marks = spark.read.schema(_MARKS).parquet(f"{out}_marks/batch_id={batch_id}")
        once = (lambda r: r) if marks.where("again > 0").isEmpty() else _once  # spares the shuffle where nothing repeats
        rows, names = _beside(rows, marks), ["log_did", "sequence_number", "canonical_hash"]
        publish(once(rows.where("sequence_number >= next")).select(names), out + "_waiting", batch_id)
        publish(once(rows.where("sequence_number < next")).select(names), out, batch_id)
        new.unpersist()
        for name in ("waiting", "marks"):
            _remove(spark, f"{out}_{name}/batch_id={batch_id - 2}")

    return _start(staged, each, checkpoint, trigger)


def _beside(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """`rows` with the next sequence of their log, null where it has none yet."""
    return rows.join(marks.withColumnRenamed("log_did", "_log"), F.col("log_did").eqNullSafe(F.col("_log")), "left").drop("_log")


def committed(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all marked batches of `commit`."""
    paths = published(spark, out)
    return spark.read.schema(_STAGED).parquet(*paths) if paths else spark.createDataFrame([], _STAGED)


def _chain(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head, clock = state.get if state.exists else ("0" * 64, 0)
    out = []
    rows = sorted({(int(a), b, c) for f in frames for a, b, c in zip(f["lamport"], f["event_id"], f["prev_hash"])})
    for lamport, event_id, prev in rows:
        if event_id == head:
            continue
        verdict = "clock" if lamport <= clock else "link" if prev != head else "appended"
        if verdict == "appended":
            head, clock = event_id, lamport
        out.append((key[0], event_id, lamport, verdict))
    state.update((head, clock))
    yield pd.DataFrame(out, columns=["originator", "event_id", "lamport", "verdict"])


def append_gossip(events: DataFrame) -> DataFrame:
    """(originator, event_id, lamport, verdict): events checked against their chain's head as they arrive."""
    return events.groupBy("originator").applyInPandasWithState(
        _chain, "originator string, event_id string, lamport long, verdict string", "head string, clock long", "append", GroupStateTimeout.NoTimeout)


def _second(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    a, b, told = state.get if state.exists else ((-1, ""), (-1, ""), (-1, -1))
    held = {(int(s), d) for s, d in (a, b) if s >= 0} | {(int(s), d) for f in frames for s, d in zip(f["sequence_number"], f["signer_did"])}
    two = [*sorted(held)[:2], (-1, ""), (-1, "")][:2]
    (s, d), (t, e) = two
    out = []
    if t >= 0 and d == e and (s, t) != tuple(told):
        out.append((*key, s, t))
        told = (s, t)
    state.update((two[0], two[1], told))
    yield pd.DataFrame(out, columns=["schema_id", "split_id", "seq_a", "seq_b"])


def scan_equivocations(splits: DataFrame) -> DataFrame:
    """A finding when the two earliest entries at a (schema, split) are of one signer. The two lowest sequences are held,
    whatever order entries arrive in; where an earlier one comes late, the pair is told again as it is then."""
    pair = "struct<seq:long,signer:string>"
    return splits.groupBy("schema_id", "split_id").applyInPandasWithState(
        _second, "schema_id string, split_id string, seq_a long, seq_b long", f"a {pair}, b {pair}, told struct<a:long,b:long>", "append", GroupStateTimeout.NoTimeout)


def _monitor(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    new = pd.concat(list(frames), ignore_index=True)[["tree_size", "root_hash"]].dropna().drop_duplicates().sort_values(["tree_size", "root_hash"], ignore_index=True)
    held = _unpack(state.get[0]) if state.exists else pd.DataFrame({"tree_size": np.zeros(0, np.int64), "first": np.zeros(0, object), "told": np.zeros(0, bool)})
    fresh = new.drop_duplicates("tree_size").rename(columns={"root_hash": "first"})
    fresh = fresh[~fresh["tree_size"].isin(held["tree_size"])].assign(told=False)
    held = pd.concat([held, fresh], ignore_index=True) if len(held) else fresh
    seen = new.merge(held, on="tree_size")
    second = seen[(seen["root_hash"] != seen["first"]) & ~seen["told"].astype(bool)].drop_duplicates("tree_size")
    state.update((_pack(held.assign(told=held["told"].astype(bool) | held["tree_size"].isin(second["tree_size"]))),))
    x, y = second["first"], second["root_hash"]
    yield pd.DataFrame({"originator": key[0], "tree_size": second["tree_size"], "root_a": x.where(x < y, y), "root_b": y.where(x < y, x)})


def monitor_heads(heads: DataFrame, k: int) -> DataFrame:
    """(originator, tree_size, root_a, root_b) when a second root signed by `k` or more arrives for a size: each log and
    size is told once, by the first two different roots. Neighbouring sizes of a log are judged together and share a row
    of state."""
    rows = heads.where((F.col("signers") >= k) & F.col("tree_size").isNotNull()).withColumn("sizes", F.floor(F.col("tree_size") / SIZES))
    return rows.groupBy("originator", "sizes").applyInPandasWithState(
        _monitor, "originator string, tree_size long, root_a string, root_b string", "held binary", "append", GroupStateTimeout.NoTimeout)


def audit(stream: DataFrame, check, out: str, checkpoint: str, **trigger):
    """What `check` (a batch of rows -> findings) finds in rows as they come, written under the batch's id."""
    return _start(stream, lambda batch, batch_id: publish(check(batch), out, batch_id) and None, checkpoint, trigger)


def project(entries: DataFrame, projections: dict, out: str, checkpoint: str, **trigger):
    """After a commit, each of the named projections (a batch -> rows) of the committed entries, written to out/<name>
    under the batch's id, so that a batch that runs again adds nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        for name, of in sorted(projections.items()):
            publish(of(rows), f"{out}/{name}", batch_id)
        rows.unpersist()

    return _start(entries, each, checkpoint, trigger)


def build(entries: DataFrame, fold, out: str, checkpoint: str, **trigger):
    """Fold entries into leaves batch by batch; each batch writes the leaves it moves, and no others. As tips are maxima,
    `built` merges the batches by the same maximum, and one batch gives what many do."""
    return _start(entries, lambda batch, batch_id: publish(fold(batch), out, batch_id) and None, checkpoint, trigger)


def built(spark: SparkSession, out: str, schema: str = "leaf_seq long, origin_tip long, authority_tip long") -> DataFrame:
    """The state after all marked batches of `build`."""
    paths = published(spark, out)
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.groupBy("leaf_seq").agg(F.max("origin_tip").alias("origin_tip"), F.max("authority_tip").alias("authority_tip"))


def ship(sequenced: DataFrame, out: str, checkpoint: str, fails=None, most: int = 10, **trigger):
    """Write entries' bytes to the store; what is there already is not written again.

    Rows for which `fails` (a column that may use attempts) holds are not written: they wait, with one attempt more, and
    go out with the next batch; after `most` attempts they are handed to a person. Waiting and manual rows lie in
    out_waiting and out_manual, by batch; `shipped_rest` tries the waiting ones without new input."""
    return _start(sequenced, lambda batch, batch_id: _ship(batch.sparkSession, batch, out, batch_id, fails, most), checkpoint, trigger)


def _ship(spark: SparkSession, batch: DataFrame | None, out: str, batch_id: int, fails, most: int) -> int:
    from ..sources.store import write_entries

    kinds = "sequence_number long, canonical_hash string, data binary, attempts int"
    before = f"{out}_waiting/batch_id={batch_id - 1}"
    rows = spark.read.schema(kinds).parquet(before) if _exists(spark, before + "/_SUCCESS") else spark.createDataFrame([], kinds)
    if batch is not None:
        rows = rows.unionByName(batch.select("sequence_number", "canonical_hash", "data", F.lit(0).alias("attempts")))
    rows = saved(rows.groupBy("sequence_number", "canonical_hash").agg(F.max("attempts").alias("attempts"), F.first("data").alias("data")))
    failed = F.coalesce(fails if fails is not None else F.lit(False), F.lit(False))
    write_entries(rows.where(~failed).drop("attempts"), out)
    again = rows.where(failed).withColumn("attempts", F.col("attempts") + 1).select("sequence_number", "canonical_hash", "data", "attempts")
    publish(again.where(F.col("attempts") >= most).drop("data"), out + "_manual", batch_id)
    publish(again.where(F.col("attempts") < most), out + "_waiting", batch_id)
    return spark.read.schema(kinds).parquet(f"{out}_waiting/batch_id={batch_id}").count()


def shipped_rest(spark: SparkSession, out: str, fails=None, most: int = 10) -> None:
    """Try waiting rows again until they are written or handed to a person, with no pause between."""
    batches = [int(p.rsplit("=", 1)[1]) for p in published(spark, out + "_waiting")]
    batch_id = max(batches, default=-1) + 1
    while batch_id and _ship(spark, None, out, batch_id, fails, most):
        batch_id += 1


def counts(entries: DataFrame) -> DataFrame:
    """Entries by signer and schema, as a running aggregate."""
    return entries.groupBy("signer_did", "schema_ref").agg(F.count("*").alias("n"), F.max("sequence_number").alias("last"))
