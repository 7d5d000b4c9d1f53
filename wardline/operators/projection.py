"""Principal components and clusters of wide tables, by sums over rows and small matrices.

A row is its sparse cells: ``indices`` and ``values`` of the columns that are not zero. Columns are centred and scaled on the
fly, so rows stay sparse. Nothing of size columns x columns is ever made: subspace iteration needs a few numbers for each
column and component, clustering a bounded number of summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from wardline.operators.admissions import SEED
from wardline.operators.columns import quoted
from wardline.session import stage

EXTRA = 10  # directions beyond the wanted ones, for the accuracy of the iteration
PASSES = 6
LEAVES = 256
_MERGED_AT_ONCE = 32
_DENSE = 8  # numbers of a full matrix for each cell, up to which a batch is multiplied as one
_SUMS = StructType([StructField("index", IntegerType()), StructField("sums", ArrayType(DoubleType()))])
_LEAF = StructType([StructField("part", LongType()), StructField("n", DoubleType()), StructField("sums", ArrayType(DoubleType())), StructField("squares", DoubleType()), StructField("width", DoubleType())])


def sparse_cells(df: DataFrame, numbers: list[str], size: int, indices: str = "indices", counts: str = "counts") -> DataFrame:
    """Count arrays over ``size`` positions and complete ``numbers`` after them, as one sparse row (``indices``, ``values``)."""
    more = F.array(*[F.lit(size + i) for i in range(len(numbers))])
    values = F.concat(F.transform(counts, lambda n: n.cast("double")), F.array(*[F.col(quoted(c)).cast("double") for c in numbers]))
    kept = [quoted(c) for c in df.columns if c not in (indices, counts, *numbers)]
    return df.select(*kept, F.concat(F.col(indices), more).alias("indices"), values.alias("values"))


def full_rows(cells: DataFrame, size: int, name: str = "x") -> DataFrame:
    """The other columns of ``cells`` with the whole row of ``size`` numbers, 0 where a cell is absent or null; for few columns."""
    kept = [f for f in cells.schema if f.name not in ("indices", "values")]
    schema = StructType([*kept, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = batch.column("indices").value_lengths().to_numpy(zero_copy_only=False)
                full = np.zeros((batch.num_rows, size))
                values = batch.column("values").flatten().fill_null(0.0)
                full[np.repeat(np.arange(batch.num_rows), lengths), batch.column("indices").flatten().to_numpy(zero_copy_only=False)] = values.to_numpy(zero_copy_only=False)
                ends = pa.array(np.arange(0, full.size + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.ListArray.from_arrays(ends, pa.array(full.ravel()))], schema.names)

    return cells.mapInArrow(run, schema)


def column_scale(cells: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and mean and sample deviation of every column, zeros included; a constant column has deviation 0."""
    rows = cells.count()
    pairs = cells.select(F.explode(F.arrays_zip("indices", "values")).alias("c")).select("c.*")
    sums = pairs.groupBy("indices").agg(F.sum("values"), F.sum(F.col("values") * F.col("values"))).collect()  # one row a column
    total, squares = np.zeros(size), np.zeros(size)
    for index, s, q in sums:
        total[index], squares[index] = s, q
    mean = total / max(rows, 1)
    spread = np.maximum(squares - rows * mean * mean, 0) / max(rows - 1, 1)
    return rows, mean, np.where(spread > 1e-12 * np.maximum(squares, 1e-300), np.sqrt(spread), 0.0)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner row, column and value of every cell."""
    lengths = batch.column("indices").value_lengths().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(batch.num_rows), lengths)
    return owner, batch.column("indices").flatten().to_numpy(zero_copy_only=False), batch.column("values").flatten().to_numpy(zero_copy_only=False)


def _times(cells: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, matrix: np.ndarray) -> np.ndarray:
    owner, index, value = cells
    weighted = value[:, None] * matrix[index]
    return np.stack([np.bincount(owner, weighted[:, k], rows) for k in range(matrix.shape[1])], axis=1)


def _covariance_times(cells: DataFrame, basis: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """(Z' Z) basis for the centred and scaled rows Z: a task adds up its rows, the sums by column add up before the driver."""
    size, width = basis.shape
    shared = cells.sparkSession.sparkContext.broadcast((basis * inverse[:, None], mean))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, centre = shared.value
        shift, out, ones = centre @ scaled, np.zeros((size, width)), np.zeros(width)
        for batch in batches:
            owner, index, value = cell = _flat(batch)
            if batch.num_rows * size <= _DENSE * len(value):  # few columns: as a full matrix
                full = np.bincount(owner * size + index, value, batch.num_rows * size).reshape(batch.num_rows, size)
                image = full @ scaled - shift
                out += full.T @ image
            else:
                image = _times(cell, batch.num_rows, scaled) - shift
                weighted = value[:, None] * image[owner]
                for k in range(width):
                    out[:, k] += np.bincount(index, weighted[:, k], size)
            ones += image.sum(axis=0)
        out -= centre[:, None] * ones
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(out), pa.list_(pa.float64()))], _SUMS.names)

    parts = cells.select("indices", "values").mapInArrow(add, _SUMS)
    sums = parts.groupBy("index").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]).toArrow().to_pandas()
    out = np.zeros((size, width))
    out[sums["index"].to_numpy()] = sums.drop(columns="index").to_numpy()
    return out * inverse[:, None]


def principal_components(cells: DataFrame, size: int, k: int = 2, passes: int = PASSES, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first components (columns x k), their variances, and the columns' mean and inverse deviation.

    Randomised subspace iteration; each pass reads the rows once and orthogonalises columns x (k + extra) numbers.
    Constant columns take no part. A component's sign is that of its largest weight.
    """
    rows, mean, deviation = column_scale(cells, size)
    inverse = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
    width = min(size, k + extra)
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, width)) * (inverse > 0)[:, None])[0]
    for _ in range(passes):
        basis = np.linalg.qr(_covariance_times(cells, basis, mean, inverse))[0]
    small = basis.T @ _covariance_times(cells, basis, mean, inverse) / max(rows - 1, 1)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    found = basis @ vectors[:, order]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return found * np.where(signs == 0, 1, signs), values[order], mean, inverse


def project(cells: DataFrame, components: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """The other columns of ``cells`` with the scores ``PC1`` and so on."""
    k = components.shape[1]
    shared = cells.sparkSession.sparkContext.broadcast((components * inverse[:, None], mean))
    kept = [f for f in cells.schema if f.name not in ("indices", "values")]
    schema = StructType([*kept, *[StructField(f"PC{i + 1}", DoubleType()) for i in range(k)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, centre = shared.value
        for batch in batches:
            scores = _times(_flat(batch), batch.num_rows, scaled) - centre @ scaled
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *[pa.array(scores[:, i]) for i in range(k)]], schema.names)

    return cells.mapInArrow(run, schema)


# --- clusters


class _Leaves:
    """At most ``most`` summaries: rows, sum, sum of squares and reach, the largest distance of a member from the centre.

    A row joins the nearest summary within ``width``, else it starts one; when there are too many, the width doubles and
    summaries are merged in the same way. Centres are kept beside the sums; one product of matrix and vector leaves
    the few that may be the nearest, whose distances are then taken exactly.
    """

    def __init__(self, most: int, width: float = 0.0):
        self.most, self.width = most, width
        self.n, self.sums, self.squares = np.zeros(0), None, np.zeros(0)
        self.centres = self.norms = None

    def add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        size, room = len(self.n), self.most + 1
        if self.sums is None:
            self.sums = np.zeros((0, sums.shape[1]))
        own = [np.zeros((room, *x.shape[1:])) for x in (self.n, self.sums, self.squares, self.sums, self.squares)]
        held = (self.n, self.sums, self.squares) + ((self.centres, self.norms) if size else ())
        for whole, x in zip(own, held):
            whole[:size] = x
        counts, totals, second, centres, norms = own
        points = sums / n[:, None]
        lengths = (points * points).sum(axis=1)
        slack, top = 16 * max(1, points.shape[1]) * np.finfo(float).eps, norms.max()
        for i in range(len(n)):
            point, near = points[i], -1
            if size:
                rough = norms[:size] - 2 * (centres[:size] @ point)
                at = int(rough.argmin())
                close = rough <= rough[at] + slack * (top + lengths[i])
                if np.count_nonzero(close) > 1:
                    among = np.flatnonzero(close)
                    at = int(among[np.sqrt(((centres[among] - point) ** 2).sum(axis=1)).argmin()])
                apart = centres[at] - point
                if np.sqrt((apart * apart).sum()) <= self.width:
                    near = at
            if near < 0:
                near, size = size, size + 1
                counts[near], totals[near], second[near] = 0.0, 0.0, 0.0
            counts[near] += n[i]
            totals[near] += sums[i]
            second[near] += squares[i]
            centre = centres[near] = totals[near] / counts[near]
            norms[near] = centre @ centre
            top = max(top, norms[near])
            while size > self.most:
                self.n, self.sums, self.squares, self.centres, self.norms = (x[:size] for x in own)
                self._merge()
                size = len(self.n)
                for whole, x in zip(own, (self.n, self.sums, self.squares, self.centres, self.norms), strict=True):
                    whole[:size] = x
                top = norms[:size].max()
        self.n, self.sums, self.squares, self.centres, self.norms = (x[:size].copy() for x in own)

    def _merge(self) -> None:
        centre = self.sums / self.n[:, None]
        gaps = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(axis=2), 0)) + np.diag(np.full(len(centre), np.inf))
        self.width = max(2 * self.width, float(gaps.min()))
        n, sums, squares = self.n.copy(), self.sums.copy(), self.squares.copy()
        self.n, self.sums, self.squares = np.zeros(0), np.zeros((0, sums.shape[1])), np.zeros(0)
        self.add(n, sums, squares)

    def batch(self, part: int) -> pa.RecordBatch:
        rows = [] if self.sums is None else list(self.sums)
        size = len(self.n)
        columns = [pa.array(np.full(size, part)), pa.array(self.n), pa.array(rows, pa.list_(pa.float64())), pa.array(self.squares), pa.array(np.full(size, self.width))]
        return pa.RecordBatch.from_arrays(columns, _LEAF.names)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def summaries(df: DataFrame, column: str, most: int = LEAVES) -> DataFrame:
    """At most ``most`` summaries of all rows: every task makes its own, groups of tasks' are merged until one is left."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = _Leaves(most)
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows)
            if len(x):
                own.add(np.ones(len(x)), x, (x * x).sum(axis=1))
        yield own.batch(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        part, rows = table.column("part")[0].as_py(), table.num_rows
        own = _Leaves(most, max(table.column("width").to_pylist()))
        own.add(table.column("n").to_numpy(), _matrix(table.column("sums"), rows), table.column("squares").to_numpy())
        return pa.Table.from_batches([own.batch(part // _MERGED_AT_ONCE)])

    leaves = stage(df.select(quoted(column)).mapInArrow(build, _LEAF), "leaves")
    while leaves.agg(F.max("part")).first()[0]:
        groups = leaves.withColumn("_g", F.expr(f"part div {_MERGED_AT_ONCE}")).groupBy("_g")
        leaves = stage(groups.applyInArrow(lambda t: merge(t.sort_by([("part", "ascending"), ("n", "descending")])), _LEAF), "leaves")
    return leaves


def merges(gaps: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Merges, again and again, the two clusters whose furthest members are nearest, down to ``k``: (kept, gone), the first
    pair on ties, ``kept`` the smaller number."""
    gaps = gaps.copy()
    np.fill_diagonal(gaps, np.inf)
    for _ in range(len(gaps) - k):
        a, b = (int(i) for i in sorted(np.unravel_index(int(gaps.argmin()), gaps.shape)))
        far = np.maximum(gaps[a], gaps[b])
        gaps[a], gaps[:, a] = far, far
        gaps[b], gaps[:, b] = np.inf, np.inf
        gaps[a, a] = np.inf
        yield a, b


def complete_linkage(points: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers of the points, ``k`` clusters by complete linkage."""
    label = np.arange(len(points))
    for a, b in merges(np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(axis=2), 0)), k):
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def linkage_order(gaps: np.ndarray) -> list[int]:
    """Leaves from left to right: a merge puts the members of the cluster that goes after those of the one that stays."""
    members = {i: [i] for i in range(len(gaps))}
    for a, b in merges(gaps, 1):
        members[a] += members.pop(b)
    return members[0] if members else []


def cluster_by_linkage(df: DataFrame, column: str, k: int = 4, most: int = LEAVES, name: str = "cluster", linkage: Callable = complete_linkage) -> DataFrame:
    """All rows with a cluster from 0: complete linkage over the summaries, each row in the cluster of its nearest one.

    ``column`` holds complete arrays of one length. Clusters are numbered by size, the largest first; fewer summaries than
    ``k`` give fewer clusters, no rows give none.
    """
    leaves = summaries(df, column, most).toArrow()  # at most ``most`` rows
    schema = StructType([*df.schema.fields, StructField(name, IntegerType())])
    if not leaves.num_rows:
        return df.withColumn(name, F.lit(None).cast("int"))
    n = leaves.column("n").to_numpy()
    centres = _matrix(leaves.column("sums"), leaves.num_rows) / n[:, None]
    label = linkage(centres, k)
    size = np.bincount(label, n)
    rank = np.empty(len(size), np.int32)
    rank[np.lexsort((np.arange(len(size)), -size))] = np.arange(len(size))
    shared = df.sparkSession.sparkContext.broadcast((centres, rank[label]))
    at = df.columns.index(column)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = shared.value
        squares = (own * own).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(at), batch.num_rows)
            near = (squares - 2 * (x @ own.T)).argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[near].astype(np.int32))], schema.names)

    return df.mapInArrow(assign, schema)


def scaled_array(df: DataFrame, columns: list[str], scale: dict[str, tuple[float, float]], name: str = "x") -> Column:
    return F.array(*[(F.col(quoted(c)).cast("double") - F.lit(scale[c][0])) / F.lit(scale[c][1]) for c in columns]).alias(name)
