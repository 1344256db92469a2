"""Merkle trees over whole logs (RFC 6962 hashing) and a sparse tree over keys.

Leaves are dealt into tiles of 256; each tile folds eight levels inside one row, so a log of n leaves takes log256(n)
shuffles, the first of them over the leaves. A lone right node goes up as it is, which gives the RFC's trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..saving import saved
from .windows import carried

TILE = 256
EMPTY = sha256(b"").hexdigest()  # of a place without a leaf or a subtree without any
FAN = 16


def leaf_hash(data: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\x00"), data), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\x01"), left, right), 256))


def _up(level: Column) -> Column:
    """The level above an array of nodes."""
    pairs = F.sequence(F.lit(0), F.greatest(F.size(level) - 1, F.lit(0)), F.lit(2))
    return F.transform(pairs, lambda i: F.when(i + 1 < F.size(level), node_hash(F.get(level, i), F.get(level, i + 1))).otherwise(F.get(level, i)))


def levels(leaves: DataFrame) -> DataFrame:
    """(level, index, hash) of every node over (index, hash) leaves, hashes of leaves included as level 0."""
    out, level, now = None, 0, leaves.select("index", "hash")
    while True:
        tiles = now.groupBy(F.expr(f"index div {TILE}").alias("tile")).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"]).alias("row"))
        rows = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.array("row"), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))
        tiles = tiles.select("tile", F.posexplode(rows).alias("up", "row"))
        nodes = tiles.select((F.lit(level) + F.col("up")).alias("level"), F.posexplode("row").alias("at", "hash"), "tile", "up")
        nodes = saved(nodes.select("level", (F.col("tile") * F.call_function("shiftright", F.lit(TILE).cast("long"), F.col("up")) + F.col("at")).alias("index"), "hash"))
        top = nodes.where(F.col("level") == level + 8).select("index", "hash")
        part = nodes.where(F.col("level") < level + 8)
        out = part if out is None else out.unionByName(part)
        if top.limit(2).count() < 2:
            return out.unionByName(nodes.where(F.col("level") == level + 8))
        now, level = top, level + 8


def versioned_roots(leaves: DataFrame) -> DataFrame:
    """(version, root) of a tree of FAN children a node after each version of its leaves (index, version, hash as hex): a
    leaf counts from its version on until its next. Places without a leaf hash as EMPTY, and so do subtrees without any.

    Only nodes over leaves that change get a new version: every level deals changes to their parents, and a parent's
    other children are carried over from its version before. The tree is as deep as the highest index asks for."""
    top = leaves.agg(F.max("index")).first()[0]
    now = leaves
    while top is not None:
        slots = [f"c{i}" for i in range(FAN)]
        parents = now.groupBy(F.expr(f"index div {FAN}").alias("index"), "version").agg(*[F.max(F.when(F.col("index") % FAN == i, F.col("hash"))).alias(c) for i, c in enumerate(slots)])
        filled = carried(parents, ["index"], "version", slots)
        now = saved(filled.select("index", "version", F.sha2(F.concat(*[F.coalesce(c, F.lit(EMPTY)) for c in slots]), 256).alias("hash")))
        top //= FAN
        if not top:
            break
    return now.select("version", F.col("hash").alias("root"))


def state_root(leaves: DataFrame) -> DataFrame:
    """(root) of a state's leaves (leaf_seq, origin_tip, authority_tip), as `versioned_roots` has it."""
    leaf = F.concat_ws("|", "leaf_seq", F.coalesce("origin_tip", F.lit(-1)), "authority_tip")
    return versioned_roots(leaves.select(F.col("leaf_seq").alias("index"), F.lit(0).cast("long").alias("version"), F.sha2(leaf, 256).alias("hash"))).select("root")


def root(nodes: DataFrame) -> DataFrame:
    """(size, root) of the tree: the one node of its highest level; nothing for an empty log."""
    size = nodes.where("level = 0").agg(F.count("*").alias("size"))
    return nodes.where("index = 0").agg(F.max_by("hash", "level").alias("root")).join(F.broadcast(size)).where("size > 0").select("size", F.lower(F.hex("root")).alias("root"))


def path_coordinates(position: int, size: int) -> list[tuple[int, int]]:
    """(level, index) of the siblings on the way from a leaf to the root."""
    if not 0 <= position < size:
        raise ValueError(f"there is no leaf {position} in a tree of {size}")
    out, level, width = [], 0, size
    while width > 1:
        if position ^ 1 < width:
            out.append((level, position ^ 1))
        position, width, level = position >> 1, (width + 1) >> 1, level + 1
    return out


def consistency_coordinates(old: int, new: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that prove a tree of `old` leaves to be the beginning of one of `new`."""
    if not 0 <= old <= new:
        raise ValueError(f"a tree of {new} has no beginning of {old}")
    if old in (0, new):
        return []

    def node(first: int, n: int) -> tuple[int, int]:
        level = (n - 1).bit_length()
        return level, first >> level

    def prove(m: int, first: int, n: int, whole: bool) -> Iterator[tuple[int, int]]:
        if m == n:
            if not whole:
                yield node(first, n)
            return
        k = 1 << (n - 1).bit_length() - 1
        if m <= k:
            yield from prove(m, first, k, whole)
            yield node(first + k, n - k)
        else:
            yield from prove(m - k, first + k, n - k, False)
            yield node(first, k)

    return list(prove(old, 0, new, True))


def proof(nodes: DataFrame, coordinates: list[tuple[int, int]]) -> DataFrame:
    """(ord, level, index, hash) of the nodes at coordinates, in their order."""
    asked = nodes.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(coordinates)], "ord int, level int, index long")
    return nodes.join(F.broadcast(asked), ["level", "index"]).select("ord", "level", "index", F.lower(F.hex("hash")).alias("hash")).orderBy("ord")


def all_paths(nodes: DataFrame, size: int) -> DataFrame:
    """(position, ord, hash): the inclusion proof of every leaf at once, as joins on each level."""
    out, level, width = None, 0, size
    leaves = nodes.where("level = 0").select(F.col("index").alias("position"))
    while width > 1:
        here = leaves.select("position", F.shiftright(F.col("position"), level).bitwiseXOR(F.lit(1).cast("long")).alias("index"))
        part = here.join(nodes.where(F.col("level") == level).select("index", "hash"), "index").select("position", F.lit(level).alias("ord"), "hash")
        out = part if out is None else out.unionByName(part)
        width, level = (width + 1) >> 1, level + 1
    return out if out is not None else leaves.select("position", F.lit(0).alias("ord"), F.lit(b"").alias("hash")).where("false")


def verify_paths(leaves: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """(position, root) that every leaf's proof leads to."""
    steps = paths.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("ord", "hash"))).alias("steps"))
    rows = leaves.select(F.col("index").alias("position"), "hash").join(steps, "position", "left")
    folded = F.aggregate(
        F.coalesce("steps", F.array().cast("array<struct<ord:int,hash:binary>>")), F.col("hash"),
        lambda acc, s: F.when(F.call_function("shiftright", F.col("position"), s["ord"]).bitwiseAND(F.lit(1).cast("long")) == 1, node_hash(s["hash"], acc)).otherwise(node_hash(acc, s["hash"])))
    return rows.select("position", F.lower(F.hex(folded)).alias("root"))


Item = tuple[int, bytes, bytes]  # key as a number, hash, key of the leaf


def _fold(items: list[Item], bit: int) -> bytes:
    """Root over items of distinct keys that agree above `bit`; a node with one child is that child."""
    while len(items) > 1:
        left = [x for x in items if not x[0] >> bit & 1]
        if 0 < len(left) < len(items):
            right = [x for x in items if x[0] >> bit & 1]
            return sha256(b"\x01" + _fold(left, bit - 1) + _fold(right, bit - 1)).digest()
        bit -= 1
    return items[0][1]


def _walk(items: list[Item], key: int, bit: int) -> tuple[list[tuple[int, bytes]], Item]:
    """(bit, hash) of the siblings on the way that a key's bits take, and the item where it ends."""
    path = []
    while len(items) > 1:
        side = [x for x in items if (x[0] ^ key) >> bit & 1 == 0]
        if 0 < len(side) < len(items):
            path.append((bit, _fold([x for x in items if (x[0] ^ key) >> bit & 1], bit - 1)))
            items = side
        bit -= 1
    return path, items[0]


def _items(f: pd.DataFrame) -> list[Item]:
    return [(int.from_bytes(k, "big"), bytes(h), bytes(k)) for k, h in zip(f["key"], f["hash"])]


def _sparse_parts(leaves: DataFrame, bits: int) -> DataFrame:
    rows = leaves.select("key", F.unhex(F.sha2(F.concat(F.lit(b"\x00"), "key", "value"), 256)).alias("hash"))
    return rows.withColumn("prefix", F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 32 - bits))


def _part_roots(leaves: DataFrame, bits: int) -> list[Item]:
    """Roots of the parts that keys' first bits deal leaves to: at most 2^bits, so they come to the driver."""
    parts = _sparse_parts(leaves, bits).groupBy("prefix").applyInPandas(lambda f: pd.DataFrame({"prefix": [f["prefix"].iloc[0]], "hash": [_fold(_items(f), 255)]}), "prefix long, hash binary")
    return [(r["prefix"] << (256 - bits), bytes(r["hash"]), b"") for r in parts.orderBy("prefix").collect()]


def sparse_root(leaves: DataFrame, bits: int = 8) -> DataFrame:
    """One row, root: a tree over 256-bit keys in which a node with one child is that child. Keys are dealt by their
    first bits and each part folded by itself, then the parts'; take bits so that a part has some thousands of keys.

    `leaves` holds key and value, both binary; an empty table has the hash of nothing."""
    top = _part_roots(leaves, bits)
    root = _fold(top, 255).hex() if top else sha256(b"").hexdigest()
    return leaves.sparkSession.createDataFrame([(root,)], "root string")


def sparse_proofs(leaves: DataFrame, keys: list[bytes], bits: int = 8, most: int = 1000) -> DataFrame:
    """(key, member, leaf_key, leaf_hash, path) for at most `most` keys: the leaf where the key's way ends, and the
    siblings (bit, hash) from the root down. A key is no member if that leaf has another key."""
    if len(keys) > most:
        raise ValueError(f"{len(keys)} keys; at most {most} at once")
    schema = "key binary, member boolean, leaf_key binary, leaf_hash binary, path array<struct<bit:int,hash:binary>>"
    top = _part_roots(leaves, bits)
    asked: dict[int, list] = {}
    for key in dict.fromkeys(keys) if top else ():
        path, (head, _, _) = _walk(top, int.from_bytes(key, "big"), 255)
        asked.setdefault(head >> (256 - bits), []).append((key, path))

    def prove(f: pd.DataFrame) -> pd.DataFrame:
        items, out = _items(f), []
        for key, above in asked[int(f["prefix"].iloc[0])]:
            below, (_, leaf_hash, leaf_key) = _walk(items, int.from_bytes(key, "big"), 255 - bits)
            out.append((key, leaf_key == key, leaf_key, leaf_hash, [{"bit": b, "hash": h} for b, h in above + below]))
        return pd.DataFrame(out, columns=["key", "member", "leaf_key", "leaf_hash", "path"])

    parts = _sparse_parts(leaves, bits).where(F.col("prefix").isin(list(asked)))
    return parts.groupBy("prefix").applyInPandas(prove, schema)


def sparse_verify(key: bytes, leaf_key: bytes, leaf_hash: bytes, path: list[tuple[int, bytes]]) -> str | None:
    """The root that a proof leads to; None if the leaf does not lie where the key's bits lead."""
    k, leaf, now = int.from_bytes(key, "big"), int.from_bytes(leaf_key, "big"), leaf_hash
    for bit, sibling in reversed(path):
        if (k ^ leaf) >> bit & 1:
            return None
        now = sha256(b"\x01" + (sibling + now if k >> bit & 1 else now + sibling)).digest()
    return now.hex()


def corrupted(rows: DataFrame, data: str = "data", identity: str = "canonical_hash") -> DataFrame:
    """Rows whose bytes do not hash to their identity; every row is checked."""
    return rows.where(F.sha2(F.col(data), 256) != F.col(identity))


def equivocations(heads: DataFrame, k: int) -> DataFrame:
    """(originator, tree_size, root_a, root_b): two heads of one size with different roots, both signed by k or more."""
    strong = heads.where(F.col("signers") >= k).select("originator", "tree_size", "root_hash").distinct()
    pairs = strong.alias("a").join(strong.alias("b"), ["originator", "tree_size"]).where("a.root_hash < b.root_hash")
    return pairs.select("originator", "tree_size", F.col("a.root_hash").alias("root_a"), F.col("b.root_hash").alias("root_b"))


def valid_ghosts(events: DataFrame) -> DataFrame:
    """Adds valid: a name, a hash that is not zero, a ghost after its primary, a time."""
    ok = (F.col("log_did") != "") & (F.col("canonical_hash") != "0" * 64) & (F.col("ghost_seq") > F.col("canonical_seq")) & (F.col("time_us") > 0)
    return events.withColumn("valid", F.coalesce(ok, F.lit(False)))
