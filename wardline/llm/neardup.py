"""N-gram Jaccard join by MinHash banding.

Texts with the same words form a class; only one text of a class takes part. Band and row counts are chosen for a target
recall at the threshold. Classes meet in buckets by a shuffle on band hashes; the pairs of a bucket are
verified on their full sets of word n-grams. A bucket is split into tiles of bounded size, so that neither a
large bucket nor long texts meet in one task, and a pair counts only in the first band it shares. Instead of pairs, a
tile returns the number of links and a local root per class; roots are merged into groups by star contraction.

N-grams and classes are 64-bit and 128-bit hashes. Nothing is capped: every bucket's every pair is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from wardline.llm.repetition import mixed
from wardline.llm.texts import as_text, map_texts, named, quoted, slices, split_words
from wardline.session import stage

_BLOCK = 1 << 17


@dataclass(frozen=True)
class JoinOptions:
    """``recall`` is the least chance that a pair at the threshold shares a band; ``most_hashes`` bounds the signature.

    A tile holds about ``tile_rows`` classes and ``tile_grams`` n-grams of either side.
    """

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    most_hashes: int = 128
    tile_rows: int = 256
    tile_grams: int = 2_000_000


def choose_bands(options: JoinOptions) -> tuple[int, int]:
    """(bands, rows) with the most rows, hence fewest chance meetings, whose bands reach the recall within the hashes."""
    for rows in range(options.most_hashes, 0, -1):
        share = options.threshold**rows
        bands = math.ceil(math.log(1 - options.recall) / math.log1p(-share)) if share < 1 else 1
        if bands * rows <= options.most_hashes:
            return bands, rows
    raise ValueError("the recall cannot be reached with that many hashes")


def word_values(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


@dataclass
class Grams:
    """Word n-gram hashes of texts, flat with offsets, and a 128-bit class per text. Texts of fewer words have one gram."""

    hashes: np.ndarray
    offsets: np.ndarray
    classes: pa.Array


def grams(texts: pa.Array, n: int) -> Grams:
    words = split_words(texts)
    values = mixed(word_values(words.distinct))[words.codes]
    counts, size = words.counts, len(words.codes)
    owners = words.owners
    windows = max(0, size - n + 1)
    rolled = np.zeros(windows, np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + values[k : k + windows]
    inside = np.flatnonzero(owners[:windows] == owners[n - 1 :]) if windows else np.zeros(0, np.int64)
    # The class: two sums over words of a mix of word and place; short texts use the first as their only gram.
    place = mixed(np.arange(size, dtype=np.uint64) - np.repeat(words.offsets[:-1], counts).astype(np.uint64))
    halves = []
    for salt in (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ mixed(place + salt)))])
        halves.append(mixed(total[words.offsets[1:]] - total[words.offsets[:-1]] + counts.astype(np.uint64)))
    short = np.flatnonzero((counts > 0) & (counts < n))
    keys = np.concatenate([mixed(rolled[inside]), halves[0][short]])
    owner = np.concatenate([owners[inside], short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64)
    raw = np.stack(halves, axis=1).tobytes()
    return Grams(keys, offsets, pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()))


def band_hashes(found: Grams, bands: int, rows: int) -> np.ndarray:
    """One hash per text and band; rows of texts without grams are meaningless."""
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    live = np.flatnonzero(np.diff(found.offsets) > 0)
    result = np.zeros((len(found.offsets) - 1, bands), np.uint64)
    starts = found.offsets[:-1][live]
    cuts = np.searchsorted(starts, np.arange(0, len(found.hashes) + _BLOCK, _BLOCK))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        begin, end = starts[a], starts[b] if b < len(starts) else len(found.hashes)
        block, own = found.hashes[begin:end], starts[a:b] - begin
        scratch = np.empty_like(block)
        for band in range(bands):
            total = np.full(b - a, np.uint64(band))
            for row in range(rows):
                np.multiply(block, factors[band * rows + row], out=scratch)
                total = mixed(total ^ np.minimum.reduceat(scratch, own))
            result[live[a:b], band] = total
    return result


_SIGNED = StructType([StructField("cls", BinaryType()), StructField("grams", IntegerType()), StructField("bands", ArrayType(LongType()))])


def _signatures(texts: pa.Array, options: JoinOptions, bands: int, rows: int) -> tuple[Grams, dict]:
    found = grams(texts, options.words)
    counts = np.diff(found.offsets)
    hashed = band_hashes(found, bands, rows).view(np.int64)
    live = counts > 0
    ends = np.concatenate([[0], np.cumsum(live * bands)]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed[live].ravel()))
    return found, {"cls": found.classes, "grams": counts.astype(np.int32), "bands": listed}


def _sets(candidates: DataFrame, options: JoinOptions, bands: int, rows: int) -> DataFrame:
    """``cls``, ``bands`` and the sorted gram set of each text of ``candidates`` (column ``text``)."""
    schema = StructType([StructField("cls", BinaryType()), StructField("bands", ArrayType(LongType())), StructField("grams", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found, columns = _signatures(as_text(batch.column("text")), options, bands, rows)
            sets = [np.unique(found.hashes[a:b]).tobytes() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([columns["cls"], columns["bands"], pa.array(sets, pa.binary())], ["cls", "bands", "grams"])

    return candidates.select("text").mapInArrow(run, schema)


def verify_tile(classes: list[bytes], bands: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links per class of a tile, and the index of the smallest class it is connected to within the tile.

    ``sides``: 0 for both, 1 and 2 for the two blocks of a tile between blocks (pairs are then taken across).
    Pairs that share an earlier band are left to that band's bucket.
    """
    m = len(classes)
    first = np.triu(np.ones((m, m), bool), 1)
    if sides.any():
        first &= sides[:, None] != sides[None, :]
    for b in range(band):
        first &= bands[:, b][:, None] != bands[:, b][None, :]
    first &= bands[:, band][:, None] == bands[:, band][None, :]
    root, links = np.arange(m), np.zeros(m, np.int64)
    if not first.any():
        return links, root
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[code] > 1
    owner, code = owner[shared], np.cumsum(df > 1)[code[shared]] - 1
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common, width = np.zeros((m, m)), 2_048
    edges = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + width, width))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            part = np.zeros((m, width), np.float32)
            part[owner[a:b], code[a:b] % width] = 1
            common += part @ part.T
    alike = first & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
    left, right = np.nonzero(alike)
    links += np.bincount(left, minlength=m) + np.bincount(right, minlength=m)
    rank = np.empty(m, np.int64)
    by_class = sorted(range(m), key=classes.__getitem__)
    rank[by_class] = np.arange(m)
    low = rank.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, left, low[right])
        np.minimum.at(low, right, low[left])
        if (before == low).all():
            break
    return links, np.array(by_class)[low]


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    schema = StructType([StructField("cls", BinaryType()), StructField("root", BinaryType()), StructField("n_links", LongType())])

    def run(table: pa.Table) -> pa.Table:
        classes, sides = table.column("cls").to_pylist(), table.column("side").to_numpy()
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("grams").to_pylist()]
        links, roots = verify_tile(classes, bands, sets, sides, table.column("band")[0].as_py(), threshold)
        linked = np.flatnonzero(links)
        return pa.table({
            "cls": pa.array([classes[i] for i in linked], pa.binary()), "root": pa.array([classes[roots[i]] for i in linked], pa.binary()),
            "n_links": pa.array(links[linked]),
        })

    return tiles.groupBy("tile").applyInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and its component's smallest node ``root``, for undirected ``edges`` (``u``, ``v``); alternating stars.

    Every round is written to the shared folder and read back. A hub is a skewed join, which is split, and its smallest
    neighbour a partial aggregate.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        moved = large.join(small, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(moved.unionByName(small.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = tuple(row)


def signed(docs: DataFrame, options: JoinOptions, text: str = "text") -> DataFrame:
    """``docs`` with the class, the number of n-grams and the band hashes of each text; no shuffle."""
    bands, rows = choose_bands(options)
    return map_texts(docs, _SIGNED, lambda: lambda texts: _signatures(texts, options, bands, rows)[1], text, drop_text=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", options: JoinOptions | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id``, ``copy_id``, ``n_copies``, ``n_links``, and the
    hashes ``cls`` of the text and ``root`` of its group.

    ``class_id`` is the smallest key among all texts connected by links, ``copy_id`` the smallest among texts with
    the same words, ``n_copies`` their number, and ``n_links`` the number of different texts whose n-gram sets have at
    least the threshold in common. Null and empty texts are copies of each other without links. A key that is null
    counts as larger than any other; repeated rows are copies.
    """
    options = options or JoinOptions()
    bands, rows = choose_bands(options)
    docs = docs.select(named(docs, key).alias("id"), named(docs, text).alias("text"))
    marked = stage(signed(docs, options), "signatures")
    # Grams and bands follow from the class, so its smallest row stands for it.
    classes = stage(marked.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("grams").alias("grams"), F.max("bands").alias("bands")), "classes")
    rows_of_bands = classes.where("grams > 0").select("cls", "grams", F.posexplode("bands").alias("band", "hash"))
    buckets = rows_of_bands.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("total")).where("m > 1")
    buckets = buckets.select(F.col("band").alias("b"), F.col("hash").alias("h"), F.greatest(F.ceil(F.col("m") / options.tile_rows), F.ceil(F.col("total") / options.tile_grams)).cast("int").alias("blocks"))
    met = stage(rows_of_bands.join(buckets, (F.col("band") == F.col("b")) & (F.col("hash") == F.col("h"))).select("cls", "band", "hash", "blocks"), "buckets")
    members = _small_tiles(met.where("blocks = 1")).unionByName(_large_tiles(met.where("blocks > 1")))
    wanted = met.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("wanted")).distinct()
    candidates = docs.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = _sets(candidates, options, bands, rows).dropDuplicates(["cls"])
    links = stage(_verified(members.join(sets, "cls"), options.threshold), "links")
    groups = connected(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy(F.col("cls").alias("node")).agg(F.sum("n_links").alias("n_links"))
    known = classes.select("cls", "rep", "n_copies").join(counts, F.col("cls") == F.col("node"), "left").drop("node")
    known = known.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    known = stage(known, "known")
    firsts = known.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("class_id"))
    known = known.join(firsts, F.col("root") == F.col("r"))
    joined = marked.select("id", F.col("cls")).join(known.select(F.col("cls").alias("c"), "class_id", "rep", "n_copies", "n_links", "root"), F.col("cls") == F.col("c"))
    return joined.select(F.col("id").alias(key), "class_id", F.col("rep").alias("copy_id"), "n_copies", "n_links", "cls", "root")


def _small_tiles(met: DataFrame) -> DataFrame:
    """One tile per set of classes that meet: a set that meets again in later bands has nothing new to verify."""
    lists = met.groupBy("band", "hash").agg(F.array_sort(F.collect_list("cls")).alias("members"))  # tile_rows at most
    unique = lists.groupBy("members").agg(F.min(F.struct("band", "hash")).alias("at"))
    return unique.select(_tile(F.col("at.band"), F.col("at.hash"), F.lit(0), F.lit(0)), F.col("at.band").alias("band"), F.lit(0).alias("side"), F.explode("members").alias("cls"))


def _large_tiles(met: DataFrame) -> DataFrame:
    """Tiles between all pairs of blocks of a bucket; a class is sent to one tile per block."""
    own = F.pmod(F.xxhash64("cls", "band"), F.col("blocks").cast("long")).cast("int")
    sent = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return sent.select(_tile(F.col("band"), F.col("hash"), F.least("own", "other"), F.greatest("own", "other")), "band", side.alias("side"), "cls")


def _tile(band: Column, bucket: Column, low: Column, high: Column) -> Column:
    return F.struct(band.cast("int").alias("band"), bucket.alias("hash"), low.cast("int").alias("low"), high.cast("int").alias("high")).alias("tile")


def keep_one(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", options: JoinOptions | None = None) -> DataFrame:
    """``docs`` with one row of each group that ``near_duplicates`` found: that of the smallest key; of repeated rows one.

    The rows meet by key, which is nearly unique, not by group.
    """
    chosen = found.where(F.col(quoted(key)).eqNullSafe(F.col("class_id"))).select(F.col(quoted(key)).alias("_key"), F.col("cls").alias("_cls"), F.col("root").alias("_root"))
    one = chosen.groupBy("_key", "_root").agg(F.min("_cls").alias("_cls"))
    options = options or JoinOptions()
    only = StructType([StructField("_own", BinaryType())])
    marked = map_texts(docs, only, lambda: lambda texts: {"_own": grams(texts, options.words).classes}, text)
    kept = marked.join(one, marked[quoted(key)].eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_cls")))
    return kept.dropDuplicates(["_key", "_own"]).select(*[F.col(quoted(c)) for c in docs.columns])
