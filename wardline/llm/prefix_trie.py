"""Prefix tries of conversations as double arrays, and what each shared prefix would save.

Conversations of equal turns are one *path* with a weight. Paths are dealt to shards by a prefix that is short enough
to hold together and long enough to bound a shard: the first depth at which a prefix stands for at most
``shard_turns`` turns. So a whole subtree lies in one shard, whatever share of all conversations begins alike.
A shard gives its turns dense ids, packs its paths into BASE and CHECK arrays and walks them for its nodes. Nodes
above the shards' prefixes occur in several shards; their parts are merged by prefix key.

Turns and prefixes travel as 128-bit keys, texts stay where they were read. One conversation's turn keys are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from wardline.llm.texts import named
from wardline.session import stage

_EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
_KEYS, _SIZES = ["k1", "k2"], ["s"]
_LISTS = [*_KEYS, *_SIZES]  # per path: two halves of the turns' keys, and the texts' bytes
_LONG, _LONGS = LongType(), ArrayType(LongType())
PATHS = StructType([StructField("path", StringType()), *[StructField(c, _LONGS) for c in _LISTS], StructField("weight", _LONG), StructField("first_id", _LONG), StructField("ends", StringType())])
_PARTS = StructType([
    *[StructField(c, _LONG) for c in ("key1", "key2", "up1", "up2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes")],
    StructField("ends_sha256", StringType()), StructField("is_upper", _LONG),
])
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass(frozen=True)
class TrieOptions:
    """``shard_turns``: a prefix of more turns than this is divided; a shard also takes small prefixes up to that size.

    From ``most_shards`` full shards on the limit grows with the table, so that the list of divided prefixes,
    which every task gets, stays below ``most_shards`` for each depth.
    """

    shard_turns: int = 16_384
    most_shards: int = 65_536


# --- conversations and paths


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id`` and its turns in order: arrays ``k1``, ``k2`` (keys of role and text) and ``s`` (UTF-8 bytes of the text).

    Order: turn (null first), then role, then a hash of the text, so that equal turn numbers have a defined order;
    repeated rows are turns of their own. Null roles and texts are empty; rows without ``conv_id`` take no part.
    """
    role, text = (F.coalesce(named(rows, c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        named(rows, "turn").isNotNull().alias("has"), F.coalesce(named(rows, "turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"), F.octet_length(text).cast("long").alias("s"),
    )
    kept = rows.select(named(rows, "conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    listed = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", *[F.col(f"turns.{c}").alias(c) for c in _LISTS])


def join_prefix(convs: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Each conversation with its first ``taken`` (at most ``most``) turns replaced by those of conversation ``base``.

    An absent base has no turns; a base of fewer turns gives all it has.
    """
    plan = convs.select("*", base.alias("base"), taken.cast("int").alias("taken"))
    first = plan.where("conv_id = base").select(F.col("conv_id").alias("b_id"), *[F.slice(c, 1, most).alias(f"b_{c}") for c in _LISTS])
    both = plan.join(first, F.col("base") == F.col("b_id"), "left")
    own = {c: F.slice(c, F.col("taken") + 1, F.greatest(F.size(c), F.lit(1))) for c in _LISTS}
    given = {c: F.coalesce(F.slice(f"b_{c}", 1, F.col("taken")), F.array().cast("array<bigint>")) for c in _LISTS}
    return both.select("conv_id", *[F.concat(given[c], own[c]).alias(c) for c in _LISTS])


def paths(convs: DataFrame) -> DataFrame:
    """Conversations of equal turns as one row: arrays, ``weight``, smallest id and the SHA-256 of their sorted ids.

    Arrays and counts are combined before the shuffle. The digest needs its ids in one sequence: they are sorted by path
    and id and hashed as they stream by, so a task holds one batch of ids, however many conversations are equal.
    """
    keyed = stage(convs.select("conv_id", *_LISTS, F.concat_ws(" ", F.xxhash64(*_KEYS).cast("string"), F.xxhash64(F.lit(1), *reversed(_KEYS)).cast("string")).alias("path")), "conversations")
    merged = keyed.groupBy("path").agg(*[F.any_value(c).alias(c) for c in _LISTS], F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("first_id"))
    ids = keyed.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id")
    digests = ids.mapInArrow(_digests, "d_path string, ends string")
    return merged.join(digests, F.col("path") == F.col("d_path")).select(*PATHS.names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path: the hash goes on from batch to batch."""
    path, running = None, hashlib.sha256()
    for batch in batches:
        found: list[tuple[str, str]] = []
        names, ids = batch.column(0), batch.column(1).cast(pa.string())
        runs = names.dictionary_encode()
        codes = runs.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(codes, prepend=-1)) if len(codes) else []
        for at, end in zip(starts, np.append(starts[1:], len(codes)) if len(codes) else [], strict=True):
            name, text = names[int(at)].as_py(), ",".join(ids.slice(int(at), int(end - at)).to_pylist()).encode()
            if name == path:
                running.update(b"," + text)
            else:
                if path is not None:
                    found.append((path, running.hexdigest()))
                path, running = name, hashlib.sha256(text)
        yield _columns(found)
    if path is not None:
        yield _columns([(path, running.hexdigest())])


def _columns(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["d_path", "ends"])


# --- prefix keys and shards


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_keys(turns: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """Key of the prefix that ends at each turn: the sum, modulo 2^64, of its turns' keys mixed with their places."""
    lengths = np.diff(offsets)
    place = (np.arange(len(turns)) - np.repeat(offsets[:-1], lengths)).astype(np.uint64)
    mixed = _mixed(turns.view(np.uint64) + _mixed(place + np.uint64(seed)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    return total[1:] - np.repeat(total[offsets[:-1]], lengths)


def _lists(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and flat values of the list columns."""
    out, offsets = {}, np.zeros(1, np.int64)
    for name in _LISTS:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out[name] = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return offsets, out


def _keys(offsets: np.ndarray, lists: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([prefix_keys(lists["k1"], offsets, 1), prefix_keys(lists["k2"], offsets, 2)], axis=1).view(np.int64)


def _sizes_below(batches: Iterator[pa.RecordBatch], from_depth: int, to_depth: int | None) -> Iterator[pa.RecordBatch]:
    """Turns that hang on each prefix of the given depths, its own last turn included, added up by batch."""
    for batch in batches:
        offsets, lists = _lists(batch)
        lengths = np.diff(offsets)
        place = np.arange(len(lists["k1"])) - np.repeat(offsets[:-1], lengths)
        chosen = (place + 1 >= from_depth) & (place + 1 <= (to_depth or len(place) + 1))
        below = (np.repeat(lengths, lengths) - place)[chosen]
        keys, where = np.unique(_keys(offsets, lists)[chosen], axis=0, return_inverse=True)
        turns = np.bincount(where.ravel(), below, len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[:, 0], keys[:, 1], turns)], ["key1", "key2", "turns"])


def heavy_prefixes(found: DataFrame, limit: int) -> np.ndarray:
    """Keys of all prefixes on which more than ``limit`` turns hang; at most turns / limit for each depth."""

    def counted(rows: DataFrame, first: int, last: int | None) -> DataFrame:
        sizes = rows.mapInArrow(lambda batches: _sizes_below(batches, first, last), "key1 long, key2 long, turns long")
        return sizes.groupBy("key1", "key2").agg(F.sum("turns").alias("turns")).where(F.col("turns") > limit).select("key1", "key2")

    top = _collected(counted(found, 1, 1))
    if not len(top):
        return top
    shared = found.sparkSession.sparkContext.broadcast(top)  # the further prefixes of the heavy first turns only

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, lists = _lists(batch)
            filled = np.flatnonzero(np.diff(offsets))
            first = _keys(offsets, lists)[offsets[:-1][filled]]
            yield batch.take(pa.array(filled[_contained(first, shared.value)]))

    return np.concatenate([top, _collected(counted(found.mapInArrow(below, found.schema), 2, None))])


def _collected(keys: DataFrame) -> np.ndarray:
    table = keys.toArrow()
    return np.stack([table.column(i).to_numpy().astype(np.int64) for i in (0, 1)], axis=1).reshape(-1, 2)


def _pairs(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view([("a", np.int64), ("b", np.int64)]).ravel()


def _contained(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    return np.isin(_pairs(keys), _pairs(among)) if len(among) and len(keys) else np.zeros(len(keys), bool)


def deal(found: DataFrame, heavy: np.ndarray, shards: int) -> DataFrame:
    """Adds ``upper``, the number of a path's heavy prefixes, and its ``shard``, by its first prefix that is not heavy.

    Heavy prefixes of a path are its shortest ones. A path of heavy prefixes only goes by its whole key.
    """
    shared = found.sparkSession.sparkContext.broadcast(heavy)  # bounded by the limit, see ``heavy_prefixes``
    schema = StructType([*found.schema.fields, StructField("upper", _LONG), StructField("shard", _LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, lists = _lists(batch)
            lengths = np.diff(offsets)
            keys = _keys(offsets, lists)
            upper = np.concatenate([[0], np.cumsum(_contained(keys, shared.value))])
            upper = upper[offsets[1:]] - upper[offsets[:-1]]
            by = np.zeros(len(lengths), np.uint64)  # a path without turns belongs to the root alone
            filled = lengths > 0
            by[filled] = keys[(offsets[:-1] + np.minimum(upper, lengths - 1))[filled], 0].view(np.uint64)
            shard = (_mixed(by) % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upper.astype(np.int64)), pa.array(shard)], schema.names)

    return found.mapInArrow(run, schema)


# --- the double array


@dataclass
class DoubleArray:
    """State s goes on with code c to state ``base[s] + c`` if ``check`` there is s. A base may be negative: CHECK decides.

    The root is state 0, with check -2; free cells have check -1.
    """

    base: np.ndarray
    check: np.ndarray

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states; -1 where the trie has no such edge."""
        at = self.base[states] + codes
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def pack(codes: np.ndarray, offsets: np.ndarray) -> DoubleArray:
    """Packs the paths ``codes[offsets[i]:offsets[i + 1]]`` level by level.

    A node of one child takes any free cell. One of several takes the first base that suits all of them among the
    free cells, or else the end of the arrays.
    """
    base, check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
    check[0] = -2
    low, top = 1, 1  # cells below ``low`` are taken, from ``top`` on all are free
    lengths = np.diff(offsets)
    states, depth = np.zeros(len(lengths), np.int64), 0
    active = np.flatnonzero(lengths > 0)
    while len(active):
        code = codes[offsets[:-1][active] + depth]
        edges, where = np.unique(np.stack([states[active], code], axis=1), axis=0, return_inverse=True)
        parents, firsts, counts = np.unique(edges[:, 0], return_index=True, return_counts=True)
        cells = np.empty(len(edges), np.int64)
        for i in np.flatnonzero(counts > 1):
            children = edges[firsts[i] : firsts[i] + counts[i], 1]
            spread = children - children[0]
            while len(check) <= top + spread[-1] + 1:
                base, check = np.concatenate([base, np.zeros_like(base)]), np.concatenate([check, np.full_like(check, -1)])
            free = low + np.flatnonzero(check[low:top] < 0)
            free = free[free + spread[-1] < len(check)]
            fits = np.flatnonzero((check[free[:, None] + spread[1:]] < 0).all(axis=1)) if len(free) * len(spread) < 1 << 16 else []
            start = int(free[fits[0]]) if len(fits) else top
            cells[firsts[i] : firsts[i] + counts[i]] = start + spread
            base[parents[i]] = start - children[0]
            check[start + spread] = parents[i]
            top = max(top, start + int(spread[-1]) + 1)
        single = np.flatnonzero(counts == 1)
        while len(check) < top + len(single):
            base, check = np.concatenate([base, np.zeros_like(base)]), np.concatenate([check, np.full_like(check, -1)])
        place = (low + np.flatnonzero(check[low : top + len(single)] < 0))[: len(single)]
        cells[firsts[single]] = place
        base[parents[single]] = place - edges[firsts[single], 1]
        check[place] = parents[single]
        if len(place):  # the first free cells were taken in turn
            low, top = int(place[-1]) + 1, max(top, int(place[-1]) + 1)
        states[active] = cells[where.ravel()]
        depth += 1
        active = active[lengths[active] > depth]
    return DoubleArray(base[:top], check[:top])


def dense_ids(keys: np.ndarray) -> np.ndarray:
    """Numbers of the distinct turns from 0, in order of first appearance, so that siblings lie close together."""
    _, first, inverse = np.unique(_pairs(keys), return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse.ravel()]


def shard_nodes(table: pa.Table) -> pa.Table:
    """All nodes of one shard's paths, from a walk through their double array.

    Nodes under the divided prefixes are complete but for a parent above the shard. The root and the divided
    prefixes (``is_upper``) are parts: members, ends and complete children as seen here.
    """
    offsets, lists = _lists(table)
    lengths, keys = np.diff(offsets), _keys(offsets, lists)
    codes = dense_ids(np.stack([lists["k1"], lists["k2"]], axis=1))
    weight, first_id, upper = (table.column(c).to_numpy().astype(np.int64) for c in ("weight", "first_id", "upper"))
    trie = pack(codes, offsets)
    size = len(trie.check)
    n_convs, smallest, depths = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    above, size_of, shared, key = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros((size, 2), np.int64)
    shared[0] = True
    states, active, depth, levels = np.zeros(len(lengths), np.int64), np.arange(len(lengths)), 0, []
    np.add.at(n_convs, states, weight)
    np.minimum.at(smallest, states, first_id)
    while True:
        active = active[lengths[active] > depth]
        if not len(active):
            break
        at, before = offsets[:-1][active] + depth, states[active]
        now = trie.step(before, codes[at])
        depth += 1
        states[active], above[now], depths[now], size_of[now], key[now] = now, before, depth, lists["s"][at], keys[at]
        shared[now] = upper[active] >= depth
        np.add.at(n_convs, now, weight[active])
        np.minimum.at(smallest, now, first_id[active])
        levels.append(np.unique(now))
    ends = np.full(size, None, object)
    ends[states] = table.column("ends").to_numpy(zero_copy_only=False)

    used = np.flatnonzero(trie.check != -1)
    children = np.bincount(above[used[1:]][~shared[used[1:]]], minlength=size)
    leaves = np.where(shared, 0, (np.bincount(above[used[1:]], minlength=size) == 0).astype(np.int64))
    saved = np.where(shared, 0, (n_convs - 1) * size_of)
    for level in reversed(levels):
        whole = level[~shared[level]]  # what lies above divided prefixes adds up after the merge
        np.add.at(leaves, above[whole], leaves[whole])
        np.add.at(saved, above[whole], saved[whole])
    parent = above[used]
    known = (parent >= 0) & ~shared[parent]
    columns = {
        "key1": key[used, 0], "key2": key[used, 1], "up1": np.where(parent >= 0, key[parent, 0], 0), "up2": np.where(parent >= 0, key[parent, 1], 0),
        "conv_id": smallest[used], "depth": depths[used], "parent_conv_id": pa.array(smallest[parent], mask=~known), "n_convs": n_convs[used],
        "n_children": children[used], "n_leaves": leaves[used], "saved_tokens": saved[used], "bytes": size_of[used],
        "ends_sha256": pa.array(ends[used], pa.string()), "is_upper": shared[used].astype(np.int64),
    }
    return pa.table({name: pa.array(c) if isinstance(c, np.ndarray) else c for name, c in columns.items()})


# --- the parts above the shards


def merge_upper(parts: DataFrame) -> DataFrame:
    """The root and the divided prefixes, merged over all shards by key, with their whole subtrees.

    Members, ends and what hangs in the shards add up in a grouped aggregate, combined before its shuffle. What is left,
    a row for each divided prefix, is bounded by the limit on them; one task adds it up the tree.
    """
    merged = parts.where("is_upper = 1").groupBy("key1", "key2").agg(
        F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("bytes").alias("bytes"), F.max("ends_sha256").alias("ends_sha256"),
    )
    schema = StructType([f for f in _PARTS if f.name != "is_upper"])
    return merged.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _add_up(t).select(schema.names), schema)


def _add_up(merged: pa.Table) -> pa.Table:
    value = {c: merged.column(c).to_numpy().astype(np.int64) for c in merged.column_names if c != "ends_sha256"}
    depth, own = value["depth"], np.stack([value["key1"], value["key2"]], axis=1)
    order = np.argsort(_pairs(own), kind="stable")
    parent = order[np.minimum(np.searchsorted(_pairs(own)[order], _pairs(np.stack([value["up1"], value["up2"]], axis=1))), len(order) - 1)]
    inner = np.flatnonzero(depth > 0)
    children = value["n_children"] + np.bincount(parent[inner], minlength=len(depth))
    leaves = value["n_leaves"] + (children == 0)
    saved = value["saved_tokens"] + (value["n_convs"] - 1) * value["bytes"]
    by_depth = inner[np.argsort(-depth[inner], kind="stable")]
    for rows in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if len(by_depth) else []:
        np.add.at(leaves, parent[rows], leaves[rows])
        np.add.at(saved, parent[rows], saved[rows])
    value |= {"n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    columns = {c: pa.array(v) for c, v in value.items()} | {"parent_conv_id": pa.array(value["conv_id"][parent], mask=depth == 0), "ends_sha256": merged.column("ends_sha256")}
    return pa.table(columns)


def trie_nodes(found: DataFrame, options: TrieOptions = TrieOptions()) -> DataFrame:
    """One row per distinct prefix of ``found`` (see ``paths``), the textless root among them; no paths, no rows.

    ``conv_id`` is the smallest member's; ``n_leaves`` and ``saved_tokens`` (each node's members but one times its text's
    bytes) cover the subtree; ``ends_sha256`` the ids of the conversations that end at the node.
    """
    found = stage(found, "paths")
    turns = found.agg(F.sum(F.size("k1").cast("long"))).first()[0]
    if turns is None:
        return found.sparkSession.createDataFrame([], _PARTS).select(*NODES)
    limit = max(options.shard_turns, turns // options.most_shards)
    dealt = deal(found, heavy_prefixes(found.select(*_LISTS), limit), max(1, -(-turns // limit)))
    parts = stage(dealt.groupBy("shard").applyInArrow(shard_nodes, _PARTS), "nodes")
    upper = stage(merge_upper(parts), "upper")  # a row for each divided prefix
    top = upper.select(F.col("key1").alias("t1"), F.col("key2").alias("t2"), F.col("depth").alias("t_depth"), F.col("conv_id").alias("t_conv"))
    same = (F.col("up1") == F.col("t1")) & (F.col("up2") == F.col("t2")) & (F.col("depth") == F.col("t_depth") + 1)
    below = parts.where("is_upper = 0").join(F.broadcast(top), same, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "t_conv"))
    nodes = below.select(*NODES).unionByName(upper.select(*NODES))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_DIGEST)))
