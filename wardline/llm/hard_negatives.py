"""Hard negatives by a multiway hyperplane tree with distance ranges (after GNAT).

Every node of the tree has several split points; a vector goes to the nearest one. A split point keeps the smallest and
largest distance to the vectors below each of its siblings (and itself). A search for scores in a window turns, with
the norms below a sibling, into a search for distances in an annulus; a sibling is left out when, by some split point's
range and the triangle inequality, no vector below it can lie in the annulus.

The upper tree is fitted on a bounded sample, its ranges cover every row. Its leaves, the *cells*, are cut into blocks
of bounded size by a hash of the id; a block meets the queries that its cell was not left out for in one task, which
builds the lower tree of the block, goes through it in the same way and compares leaves exactly. Nothing is
approximate: what is left out cannot be in the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm.texts import named
from wardline.session import stage

_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_FOUND = StructType([StructField(c, LongType()) for c in ("anchor_id", "place", "id", "score")])
_SAFE_BITS = 48  # scores below this leave room for a row's rank in the same 64-bit number


@dataclass(frozen=True)
class GnatOptions:
    """``sample_rows``: rows the upper tree is fitted on. ``arity``: most split points of a node.

    ``block_rows`` and ``query_rows`` bound what one task compares; a cell of more rows has several blocks.
    ``most_cells`` bounds the upper tree, which every task gets. ``leaf_rows``: rows of a leaf of a lower tree.
    """

    sample_rows: int = 8_192
    arity: int = 8
    block_rows: int = 4_096
    query_rows: int = 4_096
    most_cells: int = 1_024
    leaf_rows: int = 256
    seed: int = 11


# --- the tree


@dataclass
class Node:
    """Split points, what each child is (a node, or -1 - leaf), and what lies below the children.

    ``near[i, j]`` and ``far[i, j]``: distances from split point i to the vectors below child j; ``small[j]`` and
    ``large[j]``: their squared norms. Children without vectors have empty ranges.
    """

    points: np.ndarray
    children: list[int]
    near: np.ndarray = field(init=False)
    far: np.ndarray = field(init=False)
    small: np.ndarray = field(init=False)
    large: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        k = len(self.children)
        self.near, self.far = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        self.small, self.large = np.full(k, np.inf), np.full(k, -np.inf)

    def widen(self, child: int, distances: np.ndarray, norms: np.ndarray) -> None:
        """Takes in rows below ``child``: their distances to all split points, and squared norms."""
        self.near[:, child] = np.minimum(self.near[:, child], distances.min(axis=0))
        self.far[:, child] = np.maximum(self.far[:, child], distances.max(axis=0))
        self.small[child] = min(self.small[child], norms.min())
        self.large[child] = max(self.large[child], norms.max())

    def meets(self, distances: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which children may hold a score in one of a query's windows ``low[q, w]..high[q, w]``: (query, child)."""
        at = distances[:, :, None]
        least = np.maximum(at - self.far, self.near - at).max(axis=1)  # no vector below is nearer to the query
        most = (at + self.far).min(axis=1)  # or further away
        slack = 1e-9 * (1 + np.abs(most)) + 1e-6
        open_low, open_high = low == _LOWEST, high == _HIGHEST
        with np.errstate(invalid="ignore"):  # empty children have infinite ranges
            inner = norms[:, None, None] + self.small[None, :, None] - 2 * np.where(open_high, np.inf, high.astype(float))[:, None, :]
            outer = norms[:, None, None] + self.large[None, :, None] - 2 * np.where(open_low, -np.inf, low.astype(float))[:, None, :]
            inside = np.sqrt(np.maximum(inner, 0)) <= (most + slack)[:, :, None]
            inside &= (outer >= 0) & (np.sqrt(np.maximum(outer, 0)) >= (least - slack)[:, :, None])
        inside &= (low <= high)[:, None, :]
        return inside.any(axis=2) & (self.far[0] >= 0)[None, :]


def squared(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, norms: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms[:, None] + squared(points) - 2 * (x @ points.T), 0))


def split_points(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``count`` different rows of ``x``, each furthest from those before it among a few candidates for each."""
    x = x[rng.choice(len(x), min(len(x), 8 * count), replace=False)]
    norms = squared(x)
    chosen = [0]
    gap = distances(x, norms, x[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x, norms, x[chosen[-1:]])[:, 0])
    return x[chosen]


def grow(x: np.ndarray, weight: float, leaf_rows: int, arity: int, most_leaves: int, seed: int) -> tuple[list[Node], list[np.ndarray]]:
    """Nodes (the root first; none for a single leaf) and the rows of ``x`` in each leaf, the largest split first.

    A row stands for ``weight`` rows; leaves aim at ``leaf_rows``. Equal rows are not divided.
    """
    rng = np.random.default_rng(seed)
    nodes: list[Node] = []
    leaves: list[np.ndarray] = [np.arange(len(x))]
    link: list[tuple[int, int] | None] = [None]  # the leaf's place in its parent
    queue = [(-len(x), 0)]
    norms = squared(x)
    while queue and len(leaves) < most_leaves:
        size, leaf = heapq.heappop(queue)
        rows = leaves[leaf]
        if -size * weight <= leaf_rows or len(rows) < 2:
            continue
        room = most_leaves - len(leaves) + 1
        points = split_points(x[rows], int(min(arity, room, max(2, -(-len(rows) * weight // leaf_rows)))), rng)
        if len(points) < 2:
            continue
        nearest = distances(x[rows], norms[rows], points).argmin(axis=1)
        number = len(nodes)
        if link[leaf] is not None:
            parent, place = link[leaf]
            nodes[parent].children[place] = number
        nodes.append(Node(points, []))
        for j in range(len(points)):
            where = leaf if j == 0 else len(leaves)
            if j:
                leaves.append(rows)
                link.append(None)
            leaves[where], link[where] = rows[nearest == j], (number, j)
            nodes[number].children.append(-1 - where)
            heapq.heappush(queue, (-len(leaves[where]), where))
        nodes[number].__post_init__()
    return nodes, leaves


def route(nodes: list[Node], x: np.ndarray, widen: bool = False) -> np.ndarray:
    """The leaf of every row; with ``widen`` the nodes' ranges take the rows in."""
    out = np.zeros(len(x), np.int64)
    norms = squared(x)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        number, rows = todo.pop()
        node = nodes[number]
        if not len(rows):
            continue
        gaps = distances(x[rows], norms[rows], node.points)
        nearest = gaps.argmin(axis=1)
        for j, child in enumerate(node.children):
            own = nearest == j
            if widen and own.any():
                node.widen(j, gaps[own], norms[rows[own]])
            if child >= 0:
                todo.append((child, rows[own]))
            else:
                out[rows[own]] = -1 - child
    return out


def reached(nodes: list[Node], x: np.ndarray, low: np.ndarray, high: np.ndarray, prune: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves with the queries that may find something there; ``low`` may rise meanwhile."""
    norms = squared(x)
    todo = [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        number, rows = todo.pop()
        if not len(rows):
            continue
        if number < 0:
            yield -1 - number, rows
            continue
        node = nodes[number]
        gaps = distances(x[rows], norms[rows], node.points)
        alive = node.meets(gaps, norms[rows], low[rows], high[rows]) if prune else np.ones((len(rows), len(node.children)), bool)
        nearest = np.argsort(gaps.sum(axis=0))[::-1]  # the last one in is searched first
        todo += [(node.children[j], rows[alive[:, j]]) for j in nearest]


# --- comparing a block


def _top(scores: np.ndarray, allowed: np.ndarray, ranks: np.ndarray, size: int, k: int) -> np.ndarray:
    """For each query the ``k`` best allowed rows as numbers score * size + (size - 1 - rank), largest first, ``_LOWEST`` for none."""
    numbers = np.where(allowed, scores * size + (size - 1 - ranks), _LOWEST)
    if numbers.shape[1] > k:
        numbers = np.partition(numbers, numbers.shape[1] - k, axis=1)[:, -k:]
    return numbers


def search_block(
    ids: np.ndarray, labels: np.ndarray, x: np.ndarray, query_ids: np.ndarray, query_labels: np.ndarray, queries: np.ndarray,
    low: np.ndarray, high: np.ndarray, same: bool, k: int, options: GnatOptions, exact: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query place, window, row id and score of the ``k`` best rows of each window, ties by smaller id.

    ``same`` asks for other rows of the query's label, else for rows of other labels. ``exact`` says that scores
    keep below 2**48; else they are computed in 64-bit integers, a row at a time, and nothing is left out early.
    """
    order = np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], labels[order], x[order]
    low, size = low.copy(), len(ids)
    if not exact:
        return _search_wide(ids, labels, x, query_ids, query_labels, queries, low, high, same, k)
    best = np.full((len(queries), low.shape[1], k), _LOWEST)
    nodes, leaves = grow(x.astype(float), 1, options.leaf_rows, options.arity, size, options.seed)
    route(nodes, x.astype(float), widen=True)
    floats, asked = x.astype(float), queries.astype(float)
    for leaf, rows in reached(nodes, asked, low, high, True):
        members = leaves[leaf]
        if not len(members):
            continue
        scores = (asked[rows] @ floats[members].T).astype(np.int64)
        fits = labels[members][None, :] == query_labels[rows][:, None]
        fits = fits & (ids[members][None, :] != query_ids[rows][:, None]) if same else ~fits
        for w in range(low.shape[1]):
            allowed = fits & (scores >= low[rows, w][:, None]) & (scores <= high[rows, w][:, None])
            some = np.flatnonzero(allowed.any(axis=1))
            if not len(some):
                continue
            now = np.concatenate([best[rows[some], w], _top(scores[some], allowed[some], members[None, :], size, k)], axis=1)
            now = np.partition(now, now.shape[1] - k, axis=1)[:, -k:]
            best[rows[some], w] = now
            last = now.min(axis=1)
            full = last > _LOWEST
            low[rows[some][full], w] = np.maximum(low[rows[some][full], w], last[full] // size)
    place, window, _ = np.nonzero(best > _LOWEST)
    numbers = best[best > _LOWEST]
    return place, window, ids[size - 1 - numbers % size], numbers // size


def _search_wide(ids, labels, x, query_ids, query_labels, queries, low, high, same, k):
    found = [[], [], [], []]
    for q in range(len(queries)):
        scores = x @ queries[q]
        fits = (labels == query_labels[q]) & (ids != query_ids[q]) if same else labels != query_labels[q]
        for w in range(low.shape[1]):
            rows = np.flatnonzero(fits & (scores >= low[q, w]) & (scores <= high[q, w]))
            rows = rows[np.lexsort((ids[rows], -scores[rows]))][:k]
            for part, values in zip(found, (np.full(len(rows), q), np.full(len(rows), w), ids[rows], scores[rows]), strict=True):
                part.append(values)
    return tuple(np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64) for part in found)


# --- the distributed index


@dataclass
class Index:
    """``rows`` (id, label, vec, cell) in the shared folder, the upper tree, and ``cells`` (cell, shares): blocks of each."""

    rows: DataFrame
    cells: DataFrame
    nodes: list[Node]
    dimensions: int
    exact: bool
    options: GnatOptions


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(dimensions, 1)), np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable_rows(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``id``, ``label`` and ``vector`` of the rows without a null or a component that is null or not finite."""
    picked = rows.select(named(rows, key).cast("long").alias("id"), named(rows, label).cast("long").alias("label"), named(rows, vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def build_index(rows: DataFrame, options: GnatOptions = GnatOptions()) -> Index | None:
    """Indexes every row of ``rows`` (``id``, ``label``, ``vec`` array of longs); None for an empty table.

    An id stands for one row: of several the one of the smallest label, then vector. Scores must fit 64 bits.
    """
    single = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.*")
    single = stage(single, "vectors")
    largest = F.max(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    n, dimensions, top = single.agg(F.count(F.lit(1)), F.max(F.size("vec")), largest).first()
    if not n:
        return None
    if dimensions * top * top >= 2.0**63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    exact = dimensions * top * top < 2.0**_SAFE_BITS
    sample = single.orderBy(F.xxhash64("id", F.lit(options.seed)), "id").limit(options.sample_rows).select("vec").toArrow()
    nodes, _ = grow(_matrix(sample.column("vec"), dimensions).astype(float), n / sample.num_rows, options.block_rows, options.arity, options.most_cells, options.seed)
    shared = rows.sparkSession.sparkContext.broadcast(nodes)  # bounded by ``most_cells``
    schema = StructType([*single.schema.fields, StructField("cell", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = route(shared.value, _matrix(batch.column(2), dimensions).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], schema.names)

    placed = stage(single.mapInArrow(place, schema), "cells")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Node(node.points, list(node.children)) for node in shared.value]
        for batch in batches:
            route(own, _matrix(batch.column(2), dimensions).astype(float), widen=True)
        # point -1 stands for the origin, whose distances are the norms
        seen = [(t, i, j, float(node.near[i, j]), float(node.far[i, j])) for t, node in enumerate(own) for j in range(len(node.children)) if node.far[0, j] >= 0 for i in range(len(node.children))]
        seen += [(t, -1, j, float(node.small[j]), float(node.large[j])) for t, node in enumerate(own) for j in range(len(node.children)) if node.far[0, j] >= 0]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in seen], kind) for i, kind in enumerate(kinds)], ["node", "point", "child", "near", "far"])

    ranges = placed.mapInArrow(measure, "node long, point long, child long, near double, far double")
    for t, i, j, near, far in ranges.groupBy("node", "point", "child").agg(F.min("near"), F.max("far")).collect():
        if i < 0:
            nodes[t].small[j], nodes[t].large[j] = near, far
        else:
            nodes[t].near[i, j], nodes[t].far[i, j] = near, far
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(options.block_rows)).cast("int").alias("shares"))
    return Index(placed, stage(sizes, "shares"), nodes, dimensions, exact, options)


def search(index: Index, queries: DataFrame, same: bool, k: int, home: bool | None = None) -> DataFrame:
    """The ``k`` best rows of each window of each query, block by block: at most k for every block, not yet merged.

    ``queries``: ``id``, ``label``, ``vec``, ``cell`` and arrays ``low``, ``high`` of windows. ``home`` asks for the
    query's own cell only (True), all others (False) or all (None).
    """
    options, dimensions, exact = index.options, index.dimensions, index.exact
    shared = queries.sparkSession.sparkContext.broadcast(index.nodes)
    names = [f.name for f in queries.schema]
    schema = StructType([*[f for f in queries.schema if f.name != "cell"], StructField("cell", LongType())])

    def fan_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(names.index("cell")).to_numpy(zero_copy_only=False)
            if home:
                rows, cells = np.arange(batch.num_rows), own
            else:
                low, high = (_windows(batch.column(names.index(c))) for c in ("low", "high"))
                hits = [(np.zeros(0, np.int64), 0), *((r, c) for c, r in reached(shared.value, _matrix(batch.column(names.index("vec")), dimensions).astype(float), low, high, exact))]
                rows, cells = np.concatenate([r for r, _ in hits]), np.concatenate([np.full(len(r), c) for r, c in hits])
                if home is False:
                    rows, cells = rows[cells != own[rows]], cells[cells != own[rows]]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*[taken.column(c) for c in schema.names[:-1]], pa.array(cells.astype(np.int64))], schema.names)

    sent = queries.mapInArrow(fan_out, schema).join(F.broadcast(index.cells), "cell")  # at most ``most_cells`` rows
    count = queries.count()
    groups = max(1, -(-count // options.query_rows))
    keys = ["cell", "share", "part"]
    sent = sent.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")).drop("shares")
    blocks = index.rows.join(F.broadcast(index.cells), "cell").withColumn("share", F.pmod(F.xxhash64("id", F.lit(2)), F.col("shares")).cast("int")).drop("shares")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def compare(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in _FOUND.names})
        value = lambda table, c: table.column(c).to_numpy()
        ids = value(asked, "id")
        place, window, row, score = search_block(
            value(block, "id"), value(block, "label"), _matrix(block.column("vec"), dimensions), ids, value(asked, "label"),
            _matrix(asked.column("vec"), dimensions), _windows(asked.column("low")), _windows(asked.column("high")), same, k, options, exact,
        )
        return pa.table({"anchor_id": ids[place], "place": window, "id": row, "score": score})

    return blocks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(compare, _FOUND)


def _windows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row per query; missing windows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lengths), max(int(lengths.max(initial=0)), 1)), 0, np.int64)
    used = np.arange(out.shape[1]) < lengths[:, None]
    out[used] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` best of each group with their ``rank`` from 1: highest score, then smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_of_label(index: Index, anchors: DataFrame, k: int) -> DataFrame:
    """``anchor_id``, ``id``, ``score`` of the ``k`` best other rows of each anchor's label.

    The anchor's own cell is searched first; its k-th score is the lower end of the window for the others.
    """
    everything = anchors.withColumns({"low": F.array(F.lit(_LOWEST)), "high": F.array(F.lit(_HIGHEST))})
    first = stage(search(index, everything, True, k, home=True), "home")
    bound = best(first, k, "anchor_id").groupBy("anchor_id").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    known = anchors.join(bound, F.col("id") == F.col("anchor_id"), "left").drop("anchor_id")
    low = F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(_LOWEST))
    rest = search(index, known.withColumns({"low": F.array(low), "high": F.array(F.lit(_HIGHEST))}).drop("bound", "n"), True, k, home=False)
    return best(first.unionByName(rest), k, "anchor_id").select("anchor_id", "id", "score")


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
    options: GnatOptions = GnatOptions(),
) -> DataFrame:
    """The best negatives of each anchor and positive, from ``rows`` (``id``, ``label``, ``vec`` array of longs).

    Positives are an anchor's ``n_positives`` best other rows of its label. Negatives are the ``n_negatives`` best rows of
    other labels with low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score. Scores are
    inner products, ties go to the smaller id; shorter vectors count as ending in zeros. Of rows that repeat an id one
    takes part (see ``build_index``). Without rows, anchors or matches the result has no rows.
    """
    index = build_index(rows, options)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if index is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = stage(index.rows.where(is_anchor), "anchors")
    positives = stage(nearest_of_label(index, anchors, n_positives).withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), "positives")
    # whole numbers: the least and the largest score that satisfy the two conditions
    wide = F.col("positive_score").cast("decimal(38,0)")
    ends = {"low": F.ceil(wide * low_percent / 100), "high": F.floor(wide * high_percent / 100)}
    windows = positives.select("anchor_id", F.struct("positive_id", "positive_score", *[c.cast("long").alias(n) for n, c in ends.items()]).alias("w"))
    listed = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # at most n_positives each
    listed = stage(listed, "windows")
    asked = anchors.join(listed, F.col("id") == F.col("anchor_id")).select("id", "label", "vec", "cell", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    negatives = best(search(index, asked, False, n_negatives), n_negatives, "anchor_id", "place")
    owners = listed.select("anchor_id", F.posexplode("w").alias("place", "w")).select("anchor_id", F.col("place").cast("long").alias("place"), "w.positive_id", "w.positive_score")
    joined = negatives.join(owners, ["anchor_id", "place"])
    return joined.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).select(*names)
