"""Word splitting, the BPE encoder, quality rules and packing against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardline.llm import packing, repetition
from wardline.llm.bpe import public_path, word_encoder
from wardline.llm.texts import as_text, split_words
from wardline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\t", "a", " lead and trail ", "one\x0btwo\x0cthree\r\nfour", "Σας ΣΑΣ İstanbul é á ́x a\xa0b c \x1c\x1d y", "it's DON'T 12a3 ½ — “q” 日本語 👍🏽",
    "<|endoftext|> in a word<|startoftext|>x", "ⅷ Ǆ ß ẞ ﬁ K", "a\x1fb 'S 'LL", "x" * 70_000, "la " * 3_000, "#*$%&|<> ## same\nsame line\nsame line\n\n\n",
]
EXTRA_SCHEMA = "doc_id long, text string, `N_Words` string, `odd.name` int, Score string, kept int"


def extra_rows():
    return [(i, t, "x", 1, None, 5) for i, t in enumerate(ODD)] + [(0, None, None, None, None, None), (None, "a b c", None, None, None, None)]


def test_words_match_the_pattern():
    for lower in (False, True):
        words = split_words(as_text(pa.array(ODD, pa.string())), lower)
        names = words.distinct.to_pylist()
        for i, text in enumerate(ODD):
            found = [names[c] for c in words.codes[words.offsets[i] : words.offsets[i + 1]]]
            plain = WORD.findall(text or "")
            assert found == ([re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in plain] if lower else plain)


def test_encoder_gives_the_ids_of_the_vocabulary_file(spark, folder):
    path = public_path("word_bpe_49k.json")
    reference, encoder = Tokenizer.from_file(path), word_encoder(path)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    ids, offsets = encoder.texts(as_text(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode(text or "", add_special_tokens=False).ids, repr(text)[:80]


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def plain_verdict(text, limits):
    """The method's own verdict by exact n-grams."""
    words = WORD.findall(text or "")
    total = max(1, sum(map(len, words)))
    for n, most in limits.coverage.items():
        windows = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered = {i + k for i in range(len(words) - n + 1) if windows[tuple(words[i : i + n])] > 1 for k in range(n)}
        if sum(len(words[i]) for i in covered) / total > most:
            return False
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, repeated = set(), 0
    for x in lines:
        repeated += len(x) if x in seen else 0
        seen.add(x)
    return repeated / max(1, sum(map(len, lines))) <= limits.lines


def test_quality_rules_equal_plain_counts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    limits = repetition.RepetitionLimits()
    rows = repetition.quality_rules(docs.unionAll(odd)).collect()
    for r in rows:
        expected = plain_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected, r["doc_id"]
        assert r["kept"] == (not expected[-1] and plain_verdict(r["text"], limits))
    assert queries.QUERIES["op7_quality_rules"](spark, folder).count() == docs.count()


def test_quality_rules_replace_clashing_columns_and_accept_empty_tables(spark):
    frame = spark.createDataFrame(extra_rows(), EXTRA_SCHEMA)
    found = repetition.quality_rules(frame)
    assert "odd.name" in found.columns and "Score" in found.columns and [c.lower() for c in found.columns].count("n_words") == 1
    assert found.count() == len(extra_rows())
    assert repetition.quality_rules(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_windows_hold_every_token_once(cut):
    rng = np.random.default_rng(3)
    for n, capacity in ((0, 8), (1, 8), (40, 64), (300, 128)):
        sizes = rng.integers(0, capacity + 1, n)
        found = packing.windows(sizes, capacity, cut)
        assert all(0 < sum(p[2] for p in w) <= capacity for w in found)
        covered = sorted((i, s, size) for w in found for i, s, size in w)
        for item in range(n):
            at = 0
            for i, start, size in covered:
                if i == item:
                    assert start == at
                    at += size
            assert at == sizes[item]
        if cut:
            assert len(found) == -(-int(sizes.sum()) // capacity)


def test_differencing_is_near_equal():
    sizes = np.arange(1, 201)
    sums = np.bincount(packing.difference(sizes, 8), weights=sizes)
    assert sums.sum() == sizes.sum() and np.ptp(sums) <= 4
    textbook = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.difference(textbook, 2), weights=textbook)) == [14, 16]


def test_packing_is_an_exact_round_trip(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.unionAll(odd).repartition(3)
    pieces = packing.pack(both, group=20_000).collect()
    reference = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    joined = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = joined.setdefault(p["doc_id"], [])
        assert p["start"] == len(own)
        own += np.frombuffer(p["ids"], "<u4").tolist()
    for r in both.collect():
        assert joined[r["doc_id"]] == reference.encode(r["text"] or "", add_special_tokens=False).ids + [1]
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 2048 and sum(2048 - e for e in ends.values()) <= 3 * 2048
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(spark.createDataFrame(pieces)).collect()}
    assert all(digest[p["doc_id"], p["start"]] == zlib.crc32(bytes(p["ids"])) for p in pieces)


def test_packing_of_repeated_null_and_no_rows(spark):
    frame = spark.createDataFrame(extra_rows() * 2, EXTRA_SCHEMA)
    assert packing.pack(frame).where("start = 0").count() == 2 * len(extra_rows())
    assert packing.pack(frame.limit(0)).count() == 0
