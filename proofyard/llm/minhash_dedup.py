"""Near-duplicate documents by banded MinHash, with odd sketches to verify candidates before their full sets are read.

A document's MinHash samples are folded into a parity bitmap: each sample flips one bit. In the XOR of two bitmaps the
samples they share cancel, so its population count estimates how many differ, most precisely where similarity is high.
Bands of samples bring candidates together, the sketches drop those far below the threshold, and the whole sets of
shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked_across, copies_across, runs
from .graph import components
from .shared import discard, join_hot, near, packed, saved, unpacked
from .tokens import mix, shingles, words

BANDS, ROWS = 24, 4  # a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6
BITS = 512  # of an odd sketch
SLACK = 0.18  # below the threshold, where an estimate from 96 samples (deviation 0.041 there) still counts as a candidate
BLOCK = 64  # of members that carry their sets
SKETCHES = 256  # of members that carry a sketch only
BROADCAST_ROWS = 300_000  # of pairs up to which they go to the sets, not the sets to them
DROPPED_ROWS = 2_000_000  # ids of dropped documents up to which they are broadcast
_LANES = BITS // 64


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[::2] | np.uint64(1), x[1::2]


def _samples(s: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set, a block of its members at a time."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048, None] * odd + add).min(axis=0), out=least)
    return least


def _sketch(samples: np.ndarray) -> np.ndarray:
    bit = mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marks(s: np.ndarray, seeds, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's bands and odd sketch."""
    samples = _samples(s, *seeds)
    return mix((mix(samples) * spread).reshape(BANDS, ROWS).sum(axis=1)).view(np.int64), _sketch(samples)


_SPREAD = mix(np.arange(7, 7 + BANDS * ROWS, dtype=np.uint64))
_LANE_NAMES = [f"s{j}" for j in range(_LANES)]


def _signatures(k: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        for batch in batches:
            n = batch.num_rows
            size = np.zeros(n, np.int64)
            key = np.zeros((2, n), np.int64)
            bands = np.zeros((n, BANDS), np.int64)
            lanes = np.zeros((n, _LANES), np.int64)
            for chunk in words(batch.column(1)):
                for i, s in shingles(chunk, k):
                    size[i] = len(s)
                    if len(s):
                        key[0, i] = mix(s).sum().astype(np.int64)
                        key[1, i] = np.bitwise_xor.reduce(mix(s + np.uint64(77))).astype(np.int64)
                        bands[i], lanes[i] = _marks(s, seeds, _SPREAD)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(key[0]), pa.array(key[1]), lists, *(pa.array(lanes[:, j].copy()) for j in range(_LANES))],
                ["id", "n_shingles", "ka", "kb", "bands", *_LANE_NAMES],
            )

    return signatures


def _maps(ids: DataFrame) -> np.ndarray:
    """A bit map that has a bit for the hash of each id; other ids may share it. It has 16 bits an id, up to 2^30."""
    bits = min(30, max(16, (16 * ids.count()).bit_length()))
    cells = ids.select(F.xxhash64("id").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    cells = cells.groupBy(F.shiftright("at", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    got = cells.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got["cell"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _sets(k: int, shared):
    """Whole sets, with their bands and sketches, of the documents whose hashes `shared` maps: all that candidates are
    found among, and a few others."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, bits = _seeds(), shared.value
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) & np.uint64(len(bits) * 64 - 1)
            some = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            batch = batch.take(pa.array(some))
            for chunk in words(batch.column(2)):
                got = [(s.tobytes(), *_marks(s, seeds, _SPREAD)) for _, s in shingles(chunk, k)]
                lanes = np.array([x[2] for x in got], dtype=np.int64).reshape(-1, _LANES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, len(got)), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1].tobytes() for x in got], pa.binary()),
                     *(pa.array(lanes[:, j].copy()) for j in range(_LANES))],
                    ["rep", "members", "codes", *_LANE_NAMES],
                )

    return sets


def estimate(differing_bits, samples: int = BANDS * ROWS, bits: int = BITS):
    """Similarity that a XOR population count stands for."""
    z = np.minimum(np.asarray(differing_bits) / bits, 0.4999)
    return 1 + bits * np.log(1 - 2 * z) / (4 * samples)


def _most_bits(similarity: float) -> int:
    """The largest population count whose estimate is at least `similarity`."""
    return int(np.flatnonzero(estimate(np.arange(BITS // 2)) >= similarity).max())


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _with_pivot(percent: int):
    """Links of a block's documents with its first one, the pivot."""

    def with_pivot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames):
            sets = [np.frombuffer(x, np.uint64) for x in f["members"]]
            ids = f["rep"].to_numpy()
            keep = [i for i in range(1, len(f)) if _similar(sets[0], sets[i], percent)]
            yield pd.DataFrame({"a": ids[keep], "b": np.full(len(keep), ids[0])})

    return with_pivot


def _close(most: int):
    """Members of a block with a close sketch in another component, each once a block."""

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames):
            comp, side = f["comp"].to_numpy(), f["side"].to_numpy()
            lanes = f[_LANE_NAMES].to_numpy().view(np.uint64)
            one_block = f["i"].iloc[0] == f["j"].iloc[0]
            left = np.arange(len(f)) if one_block else np.flatnonzero(side == 0)
            right = left if one_block else np.flatnonzero(side == 1)
            has = np.zeros(len(f), dtype=bool)
            for at in range(0, len(left), 64):
                part = left[at : at + 64]
                far = np.bitwise_count(lanes[part][:, None, :] ^ lanes[right][None, :, :]).sum(axis=2, dtype=np.int64)
                x, y = np.nonzero((far <= most) & (comp[part][:, None] != comp[right][None, :]))
                has[part[x]] = has[right[y]] = True
            yield f.loc[has, ["rep", "comp", "whole", "key", "t"]]

    return close


def _across(most: int, percent: int):
    """Links that join different components inside a block: of the pairs with close sketches the closest first, each on
    its whole sets, until all are joined or compared. In buckets of one band a pair is left to the first band that it
    shares."""

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames):
            ids, comp, side, t = f["rep"].to_numpy(), f["comp"].to_numpy(), f["side"].to_numpy(), int(f["t"].iloc[0])
            lanes = f[_LANE_NAMES].to_numpy().view(np.uint64)
            bands = np.frombuffer(b"".join(f["codes"]), np.int64).reshape(len(f), -1)[:, :t] if t else np.empty((len(f), 0), np.int64)
            one_block = f["i"].iloc[0] == f["j"].iloc[0]
            left = np.arange(len(f)) if one_block else np.flatnonzero(side == 0)
            right = left if one_block else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            found = []
            for at in range(0, len(left), 64):
                part = left[at : at + 64]
                far = np.bitwise_count(lanes[part][:, None, :] ^ lanes[right][None, :, :]).sum(axis=2, dtype=np.int64)
                x, y = np.nonzero((far <= most) & (comp[part][:, None] != comp[right][None, :]))
                far, x, y = far[x, y], part[x], right[y]
                new = (~one_block | (x < y)) & ~(bands[x] == bands[y]).any(axis=1)
                found.append(np.stack([far[new], x[new], y[new]]))
            pairs = np.concatenate(found, axis=1)
            if not pairs.shape[1]:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in f["members"]]
            above = {c: c for c in comp.tolist()}

            def root(c: int) -> int:
                while above[c] != c:
                    above[c] = c = above[above[c]]
                return c

            links = []
            for _, x, y in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q and _similar(sets[x], sets[y], percent):
                    above[max(p, q)] = min(p, q)
                    links.append((ids[x], ids[y]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return across


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id reachable by links, itself included) and
    kept (id = component_id). Linked are documents whose sets of distinct k-word shingles have 100 * intersection >=
    percent * union; words are runs of other than ASCII white space, A-Z lower-cased.

    Documents with 1 to k-1 words have one shingle, the whole sequence; those without words (empty or null text) have
    none and are linked with nothing. Rows without an id are linked with nothing: component_id null, kept true. Rows
    that repeat an id are one document, each row reported. Other columns of `docs` are ignored; an empty table gives none.

    Equal sets are folded into the smallest id by a grouped minimum first. Of the rest, every member of a band's bucket
    meets the smallest member; then only members of buckets that still hold different components meet, buckets around one
    component as one, in blocks of bounded size that carry the whole sets and give back links, not pairs. No document is
    left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = max(1, parts // 8)  # files of links, which are small beside the sets they come from
    longs = "".join(f", {c} long" for c in _LANE_NAMES)
    lanes = _LANE_NAMES
    marks = saved(docs.mapInArrow(_signatures(k), "id long, n_shingles long, ka long, kb long, bands array<long>" + longs))
    total = marks.count()
    full = marks.where("n_shingles > 0 and id is not null")
    classes = saved(full.groupBy("ka", "kb").agg(F.min("id").alias("rep"), F.count("*").alias("held")))
    reps = join_hot(full, classes, ["ka", "kb"], "held", total).where("id = rep").select("rep", "bands", *lanes).dropDuplicates(["rep"])
    reps = saved(reps)
    banded = reps.select("rep", F.posexplode("bands").alias("t", "band"))
    buckets = saved(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1"))
    members = saved(join_hot(banded, buckets.select("band", "pivot", "n"), ["band"], "n", BANDS * total))
    most = _most_bits(percent / 100 - SLACK)
    far = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in lanes), F.lit(0))
    stars = saved(members.where("rep <> pivot").select("rep", "pivot").distinct())
    hubs = saved(stars.groupBy("pivot").agg(F.count("*").alias("rays")))
    hubs = saved(hubs.join(reps.withColumnRenamed("rep", "pivot"), "pivot").select("pivot", "rays", F.struct(*lanes).alias("y")))
    close = join_hot(stars.join(reps.select("rep", F.struct(*lanes).alias("x")), "rep"), hubs, ["pivot"], "rays", BANDS * total)
    close = saved(close.where(far <= most).select("rep", "pivot"))
    asked = saved(members.select(F.col("rep").alias("id")).distinct())
    wanted = spark.sparkContext.broadcast(_maps(asked))
    sets = docs.where("id is not null").select("id", F.xxhash64("id").alias("hash"), "text").mapInArrow(_sets(k, wanted), "rep long, members binary, codes binary" + longs)
    sets = saved(sets)
    wanted.destroy()
    if full.count() > full.select("id").distinct().count():  # rows that repeat an id are one document
        sets = saved(sets.dropDuplicates(["rep"]))

    salts = close.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"), F.count("*").alias("rays"))
    salts = saved(salts)
    rays = join_hot(close, salts, ["pivot"], "rays", BANDS * total).select("rep", F.col("pivot").alias("bucket"), F.pmod(F.xxhash64("rep"), "m").cast("int").alias("i"), F.lit(1).alias("side"))
    centres = salts.select(F.col("pivot").alias("rep"), F.col("pivot").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), F.lit(0).alias("side"))
    rays = saved(rays.unionByName(centres).withColumn("j", F.col("i")))
    rays = sets.select("rep", "members").join(near(rays, BROADCAST_ROWS), "rep")
    rays = rays.repartition(parts, "bucket", "i").sortWithinPartitions("bucket", "i", "side", "rep")
    links = saved(rays.select("bucket", "i", "j", "rep", "members").mapInPandas(_with_pivot(percent), "a long, b long").repartition(few))
    comp = saved(components(links))

    labelled = members.drop("pivot").join(near(comp, BROADCAST_ROWS).withColumnRenamed("id", "rep"), "rep", "left").select("rep", "t", "band", F.coalesce("component_id", "rep").alias("comp"))
    rows = _open(_buckets(saved(labelled), BANDS * total, SKETCHES), BANDS * total)
    rows = blocked_across(rows.join(near(reps.select("rep", *lanes), BROADCAST_ROWS), "rep"), ["whole", "key"], "rep", "rest", "most", SKETCHES, parts)
    rows = rows.select("bucket", "i", "j", "side", "rep", "comp", "whole", "key", "t", *lanes).mapInPandas(_close(most), "rep long, comp long, whole boolean, key long, t int")
    flagged = saved(rows.distinct())
    rows = _open(flagged, BANDS * total)
    rows = sets.withColumnRenamed("codes", "all").join(near(rows, BROADCAST_ROWS), "rep").withColumn("codes", F.when(F.col("t") > 0, F.col("all"))).drop("all")
    rows = blocked_across(rows, ["whole", "key"], "rep", "rest", "most", BLOCK, parts)
    found = saved(rows.select("bucket", "i", "j", "side", "rep", "t", "comp", "codes", "members", *lanes).mapInPandas(_across(most, percent), "a long, b long").repartition(few))
    if not found.isEmpty():
        comp = saved(components(links.unionByName(found)))
    groups = saved(classes.join(near(comp, BROADCAST_ROWS).withColumnRenamed("id", "rep"), "rep", "left").select("ka", "kb", "held", F.coalesce("component_id", "rep").alias("component")))
    out = join_hot(marks.select("id", "n_shingles", "ka", "kb"), groups, ["ka", "kb"], "held", total, "left")
    group = F.when(F.col("n_shingles") > 0, F.col("component"))
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce(group, "id")).alias("component_id"))
    discard(members, stars, close, asked, sets, flagged, found, links, reps, salts, buckets)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets that hold different components: their n members, the rest of these outside the largest component, this
    component, and n again as held."""
    sizes = rows.groupBy(*keys, "comp").agg(F.count("*").alias("size"))
    found = sizes.groupBy(*keys).agg(F.count("*").alias("comps"), F.sum("size").alias("n"), F.max(F.struct("size", "comp")).alias("top"))
    return found.where("comps > 1").select(*keys, "n", (F.col("n") - F.col("top.size")).alias("rest"), F.col("top.comp").alias("largest"), F.col("n").alias("held"))


def _buckets(labelled: DataFrame, total: int, size: int) -> DataFrame:
    """Those members (rep, t, band, comp) whose band holds different components, as rep, comp, whole, key, t.

    Documents of a group share many bands and would meet in each. Bands with one largest component are therefore one
    bucket (whole, key is the component, t = 0), which holds a document once, unless fewer copies are made band by band
    (key is the band), as where a long chain of documents has strangers all along it."""
    bands = saved(_sizes(labelled, ["band"]))
    rows = saved(join_hot(labelled, bands.select("band", F.col("largest").alias("key"), "held"), ["band"], "held", total))
    once = saved(rows.select("rep", "comp", "key").distinct())
    apart = bands.groupBy(F.col("largest").alias("key")).agg(F.sum(copies_across("rest", size)).alias("apart"), F.sum("n").alias("times"))
    keys = saved(_sizes(once, ["key"]).join(apart, "key").select("key", "held", "times", (copies_across("rest", size) <= F.col("apart")).alias("whole")))
    together = join_hot(once, keys.where("whole").select("key", "held"), ["key"], "held", total).select("rep", "comp", F.lit(True).alias("whole"), "key", F.lit(0).alias("t"))
    by_band = join_hot(rows, keys.where("not whole").select("key", "times"), ["key"], "times", total).select("rep", "comp", F.lit(False).alias("whole"), F.col("band").alias("key"), "t")
    return saved(together.unionByName(by_band))


def _open(rows: DataFrame, total: int) -> DataFrame:
    """Members of buckets (whole, key) that hold different components: with the bucket's n members, the rest of these that
    are outside its largest component, and `most` for members inside."""
    found = saved(_sizes(rows, ["whole", "key"]))
    return saved(join_hot(rows, found, ["whole", "key"], "held", total).withColumn("most", F.col("comp") == F.col("largest")).drop("largest"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of near duplicates, all its columns kept. Rows without an id stay; of rows that
    repeat an id that is kept one stays, the first in order of files. Ids of dropped documents go to the rows, by broadcast up to
    DROPPED_ROWS of them. `docs` is to come from files, whose rows keep their order when read again."""
    marks = saved(near_duplicates(docs, id_col, text_col, k, percent).where(F.col(id_col).isNotNull()))
    dropped = saved(marks.where("not kept").select(F.col(id_col).alias("id")).distinct())
    again = marks.where("kept").groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("times")).where("times > 1").select("id")
    rows = packed(docs)
    own = F.col("row")[id_col].cast("long")
    kept = rows.join(near(dropped, DROPPED_ROWS), own == F.col("id"), "left_anti")
    again = saved(again)
    if not again.isEmpty():
        ids = rows.select("rid", own.alias("id")).join(near(again, DROPPED_ROWS), "id")
        first = ids.groupBy("id").agg(F.min("rid").alias("first"))
        others = saved(ids.join(first, "id").where("rid <> first").select(F.col("rid").alias("other")))
        kept = kept.join(near(others, DROPPED_ROWS), F.col("rid") == F.col("other"), "left_anti")
    return unpacked(kept)
