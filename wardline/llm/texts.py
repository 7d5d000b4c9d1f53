"""Columnar text helpers shared by the operators that run numpy inside Spark tasks.

A task sees Arrow batches. ``slices`` cuts them into runs of bounded size (one text is never cut), and
``split_words`` turns a run into integer word codes over the run's distinct words, so that per-word work
happens once per distinct word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 8 << 20


@dataclass
class Words:
    """Words of a run of texts: ``codes[offsets[i]:offsets[i + 1]]`` are the words of text i."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Null texts become empty; 64-bit offsets, as a run may hold long texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D; ``lower`` folds A-Z only."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    encoded = lists.flatten().dictionary_encode()
    codes, distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py() if len(distinct) else -1
    if blank >= 0:  # leading, trailing or no words at all leave empty strings
        kept = codes != blank
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return Words(offsets, codes, distinct)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty segments give zero."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(offsets: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and new offsets that list segment ``order[0]``, then ``order[1]``, and so on."""
    lengths = np.diff(offsets)[order]
    ends = np.cumsum(lengths)
    kind = np.int32 if len(ends) and max(ends[-1], offsets[-1]) < 2**31 else np.int64
    at = np.repeat((offsets[:-1][order] - (ends - lengths)).astype(kind), lengths)
    at += np.arange(len(at), dtype=kind)
    return at, np.concatenate([[0], ends]).astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's byte offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of at most ``limit`` bytes of ``column``; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(frame: DataFrame, results: StructType | list[str]) -> list[str]:
    """Columns of ``frame`` that a result of the same name (in any case) does not replace."""
    taken = {n.lower() for n in (results.names if isinstance(results, StructType) else results)}
    return [c for c in frame.columns if c.lower() not in taken]


def named(frame: DataFrame, name: str) -> Column:
    """A top-level column, also when its name holds dots or back-quotes."""
    return F.col(quoted(name))


def map_texts(
    docs: DataFrame,
    results: StructType,
    start: Callable[[], Callable[[pa.Array], dict[str, np.ndarray | pa.Array]]],
    text: str = "text",
    drop_text: bool = False,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Appends ``results`` computed from the texts; every input column stays unless a result has its name.

    ``start`` runs once per task and returns the function from texts to result arrays. No shuffle.
    """
    kept = [i for i, c in enumerate(docs.columns) if c in others(docs, results) and not (drop_text and c == text)]
    at = docs.columns.index(text)
    # mapInArrow resolves columns by name, so names with dots travel under their place.
    fields = [StructField(f"c{i}", docs.schema[i].dataType) for i in kept] + [StructField(f"r{i}", f.dataType) for i, f in enumerate(results)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in slices(batches, f"c{at}", limit):
            work = work or start()
            found = work(as_text(batch.column(at)))
            columns = [found[f.name] for f in results]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [f.name for f in fields])
            del found, columns
            pa.default_memory_pool().release_unused()  # workers are reused, and would keep what one task has needed

    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return placed.mapInArrow(run, StructType(fields)).toDF(*[docs.columns[i] for i in kept], *results.names)
