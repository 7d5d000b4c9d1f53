"""Token packing by Karmarkar-Karp multiway differencing.

Each task tokenises its documents and packs them in groups of bounded size, so nothing is shuffled. Whole windows
of a long document stand alone; the remainders of a group are partitioned into near-equal windows: partial
partitions with the largest spreads are merged first, the fullest window of one with the emptiest of the other.
The window count starts at the tokens over the capacity and rises whenever a window would exceed it. With
``cut`` (the default) what sticks out of a near-equal window is cut off and put where there is room, so the
count need rise only when the tokens themselves exceed it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from wardline.llm.bpe import RUN_BYTES, public_path, word_encoder
from wardline.llm.texts import as_text, named, quoted, slices

RESULTS = StructType([
    StructField("start", LongType()), StructField("length", LongType()), StructField("doc_tokens", LongType()),
    StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("ids", BinaryType()),
])


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item: multiway differencing of positive ``sizes`` into ``k`` windows."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges, node = [], n  # (new nodes, their left parts, their right parts)
    order = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)
        left, right = len(a) - both, len(b) - both
        sums, nodes = np.concatenate([a, b[:right]]), np.concatenate([a_nodes, b_nodes[:right]])
        if both:
            sums[left : len(a)] += b[right:][::-1]
            fresh = np.arange(node, node + both)
            merges.append((fresh, a_nodes[left:], b_nodes[right:][::-1]))
            nodes[left : len(a)] = fresh
            node += both
        down = np.argsort(-sums, kind="stable")
        sums, nodes = sums[down], nodes[down]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, order, sums, nodes))
        order += 1
    labels = np.zeros(node, np.int64)
    labels[heap[0][3]] = np.arange(len(heap[0][3]))
    for fresh, one, other in reversed(merges):
        labels[one] = labels[fresh]
        labels[other] = labels[fresh]
    return labels[:n]


def windows(sizes: np.ndarray, capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Near-equal windows of pieces (item, start in the item, length) that hold every token once.

    No item may exceed ``capacity``. Items of size zero get no piece.
    """
    live = np.flatnonzero(sizes > 0)
    total = int(sizes.sum())
    k = -(-total // capacity)
    if not k:
        return []
    while True:
        labels = difference(sizes[live], k)
        sums = np.bincount(labels, weights=sizes[live], minlength=k).astype(np.int64)
        if cut or sums.max() <= capacity:
            break
        k += 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for item, label in zip(live.tolist(), labels.tolist(), strict=True):
        found[label].append((item, 0, int(sizes[item])))
    loose = []
    for w in np.flatnonzero(sums > capacity).tolist():
        over = int(sums[w]) - capacity
        while over:
            item, start, length = found[w].pop()
            taken = min(over, length)
            if taken < length:
                found[w].append((item, start, length - taken))
            loose.append((item, start + length - taken, taken))
            over -= taken
        sums[w] = capacity
    for w in np.argsort(sums, kind="stable").tolist() if loose else []:
        room = capacity - int(sums[w])
        while room and loose:
            item, start, length = loose.pop()
            taken = min(room, length)
            if taken < length:
                loose.append((item, start + taken, length - taken))
            found[w].append((item, start, taken))
            room -= taken
    return found


@dataclass
class _Piece:
    """Tokens of one document: ``ids[start:start + length]`` with its key value."""

    key: object
    ids: np.ndarray
    start: int
    length: int


def _pack_task(batches: Iterator[pa.RecordBatch], key: str, text: str, path: str, end: int, capacity: int, group: int, cut: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    waiting: list[_Piece] = []
    held = 0

    def emit(sequences: list[list[_Piece]]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        columns: list[list] = [[] for _ in schema]
        for sequence in sequences:
            offset = 0
            for p in sequence:
                row = (p.key, p.start, p.length, len(p.ids), number, offset, p.ids[p.start : p.start + p.length].astype("<u4").tobytes())
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset += p.length
            number += 1
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def pack(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, held
        spare, rest = 0 if last or not cut else held % capacity, []
        while spare:  # what would leave a window half empty goes to the next group
            p = waiting.pop()
            taken = min(spare, p.length)
            if taken < p.length:
                waiting.append(_Piece(p.key, p.ids, p.start, p.length - taken))
            rest.append(_Piece(p.key, p.ids, p.start + p.length - taken, taken))
            spare -= taken
        sizes = np.array([p.length for p in waiting], np.int64)
        yield from emit([
            [_Piece(waiting[i].key, waiting[i].ids, waiting[i].start + start, length) for i, start, length in window]
            for window in windows(sizes, capacity, cut)
        ])
        waiting, held = rest, sum(p.length for p in rest)

    for batch in slices(batches, text, RUN_BYTES):
        keys = batch.column(key).to_pylist()
        ids, offsets = encoder.texts(as_text(batch.column(text)))
        whole: list[list[_Piece]] = []
        done = 0
        for i, name in enumerate(keys):
            own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end))
            full = len(own) // capacity * capacity
            whole += [[_Piece(name, own, at, capacity)] for at in range(0, full, capacity)]
            done += full
            if full < len(own):
                waiting.append(_Piece(name, own, full, len(own) - full))
                held += len(own) - full
            if done >= group:
                yield from emit(whole)
                whole, done = [], 0
            if held >= group:
                yield from pack(last=False)
        yield from emit(whole)
    yield from pack(last=True)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 1, capacity: int = 2048, group: int = 1 << 20, cut: bool = True) -> DataFrame:
    """One row per piece: the key, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers; ``doc_tokens`` counts the closing ``end`` id. A null or
    empty text is the closing id alone. Repeated rows are packed as documents of their own, a null key stays
    null. Sequences hold at most ``capacity`` tokens, their pieces are gapless from offset 0, and only the
    last group of a task may leave windows short. Other columns are not carried. The same partitions give
    the same sequences, so a retried task repeats its rows.
    """
    frame = docs.select(named(docs, key), named(docs, text))
    schema = StructType([frame.schema.fields[0], *RESULTS.fields])
    arrow = pa.schema([pa.field("f0", _arrow(schema.fields[0].dataType)), *[pa.field(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in RESULTS]])
    path = vocabulary or public_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack_task((b.rename_columns(["key", "text"]) for b in batches), "key", "text", path, end, capacity, group, cut, arrow)

    return frame.toDF("key", "text").mapInArrow(run, StructType([StructField("key", schema.fields[0].dataType), *RESULTS.fields])).withColumnRenamed("key", key)


def digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of their ids in place of the ids."""
    columns = [F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(quoted(c)) for c in pieces.columns]
    return pieces.select(*columns)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
