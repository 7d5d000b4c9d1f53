"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over each whole text; the rules measure the share of characters that
lie inside n-grams or lines found more than once. Equal hashes are compared word by word before they count.
No shuffle: a document is judged on its own, whatever its source or size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from wardline.llm.texts import Words, map_texts, split_words, sums, utf8

SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepetitionLimits:
    """``coverage``: n-gram length to the largest share of characters inside repeated n-grams of that length;
    ``lines``: the same for lines equal to an earlier line. ``min_words`` and ``repeat_percent`` are the base rules.
    """

    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.25, 8: 0.20, 10: 0.15})
    lines: float = 0.30
    min_words: int = 10
    repeat_percent: int = 20


RESULTS = StructType([
    StructField("n_words", LongType()), StructField("word_chars", LongType()), StructField("n_symbols", LongType()),
    StructField("n_dup_lines", LongType()), StructField("n_repeat_words", LongType()),
    StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
    StructField("line_coverage", DoubleType()), StructField("ngram_coverage", DoubleType()),
])


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix finaliser)."""
    z = values.astype(np.uint64) + _BASE
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def repeated_words(words: Words, owners: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Marks words that lie in an n-word window found at least twice in the same text."""
    codes, size = words.codes, len(words.codes)
    covered = np.zeros(size, bool)
    if size < n:
        return covered
    windows = size - n + 1
    hashes = np.zeros(windows, np.uint64)
    for k in range(n):
        hashes = hashes * _BASE + values[k : k + windows]
    inside = np.flatnonzero(owners[:windows] == owners[n - 1 :])
    keys = hashes[inside] + mixed(owners[inside])
    ranked = np.sort(keys)
    doubled = ranked[1:][ranked[1:] == ranked[:-1]]
    marks = np.zeros(1 << 22, bool)  # a sieve: only windows whose hash may occur twice are put in order
    marks[doubled & np.uint64((1 << 22) - 1)] = True
    maybe = np.flatnonzero(marks[keys & np.uint64((1 << 22) - 1)])
    inside, keys = inside[maybe], keys[maybe]
    order = np.argsort(keys)
    ranked = keys[order]
    equal = np.flatnonzero(ranked[1:] == ranked[:-1])
    first, second = inside[order[equal]], inside[order[equal + 1]]
    same = owners[first] == owners[second]
    for k in range(n):
        same &= codes[first + k] == codes[second + k]
    hits = np.unique(np.concatenate([first[same], second[same]]))
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, hits, 1)
    np.add.at(steps, hits + n, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines with a word equal to an earlier line, their characters, and the characters of all such lines."""
    lists = pc.split_pattern(texts, "\n")
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.utf8_length(encoded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.not_equal(pc.utf8_trim(encoded.dictionary, _WHITE), "").to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owners = np.repeat(np.arange(len(texts)), counts)
    live = worded[codes] if len(codes) else np.zeros(0, bool)
    owners, codes = owners[live], codes[live]
    keys = owners * max(1, len(lengths)) + codes
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[firsts] = False
    size = len(texts)
    return (
        np.bincount(owners[later], minlength=size),
        np.bincount(owners[later], weights=lengths[codes[later]], minlength=size),
        np.bincount(owners, weights=lengths[codes], minlength=size),
    )


def measure(texts: pa.Array, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    words = split_words(texts)
    owners = words.owners
    lengths = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = lengths[words.codes]
    n_words, word_chars = words.counts.astype(np.int64), sums(chars, words.offsets)
    raw, ends = utf8(texts)
    is_symbol = np.zeros(256, np.int8)
    is_symbol[[ord(c) for c in SYMBOLS]] = 1
    symbols = sums(is_symbol[raw], ends)
    values = mixed(np.arange(len(words.distinct)))[words.codes]
    n_repeat, worst, failed = None, np.zeros(len(texts)), np.zeros(len(texts), bool)
    for n in sorted({5, *limits.coverage}):
        covered = repeated_words(words, owners, n, values)
        if n == 5:
            n_repeat = sums(covered.astype(np.int64), words.offsets)
        if n in limits.coverage:
            share = sums(np.where(covered, chars, 0), words.offsets) / np.maximum(word_chars, 1)
            worst, failed = np.maximum(worst, share), failed | (share > limits.coverage[n])
    n_dup_lines, dup_chars, line_chars = repeated_lines(texts)
    line_share = dup_chars / np.maximum(line_chars, 1)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup_lines.astype(np.int64),
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & ~failed & (line_share <= limits.lines),
        "line_coverage": line_share, "ngram_coverage": worst,
    }


def quality_rules(docs: DataFrame, text: str = "text", limits: RepetitionLimits | None = None, drop_text: bool = False) -> DataFrame:
    """All rows of ``docs`` with the measures and the verdict ``kept``.

    Words are runs of characters other than 0x20 and 0x09-0x0D. Null and empty texts have no words and fail
    (fewer than ``min_words``). Repeated rows are judged alike, each on its own. A column of ``docs`` that has
    a result's name is replaced; every other column stays.
    """
    limits = limits or RepetitionLimits()
    return map_texts(docs, RESULTS, lambda: lambda texts: measure(texts, limits), text, drop_text)
