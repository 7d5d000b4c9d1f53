"""Ids of a public word-level BPE vocabulary for whole columns of text.

The vocabulary (lower case, white space dropped, a word-end mark) never looks across white space, so each
distinct word of a run is encoded once and the ids are gathered. The distinct words go through ``tiktoken`` with
the same merges: the word-end mark becomes a blank, which no piece contains. ``tests/llm`` compares the ids
with those of the vocabulary file's own library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from wardline.llm.texts import split_words, spread

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
_BLANKS = regex.compile(r"[\x09\x0b-\x0d\x85\p{Z}]+")
_LEFT = regex.compile(r"(?<=[ \n]) +")
RUN_BYTES = 16 << 20
_END = "</w>"
_ASCII_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _mark_letters(words: pa.Array) -> str:
    """One line for each word, each piece followed by a blank; the same for the two below."""
    return " \n".join(pc.utf8_lower(words).to_pylist()) + " "


def _mark_ascii(words: pa.Array) -> str:
    return _ASCII_PIECES.sub(r"\g<0> ", "\n".join(words.to_pylist()).lower())


def _mark_any(words: pa.Array) -> str:
    text = _BLANKS.sub(" ", "\n".join(words.to_pylist())).replace("Σ", "σ").lower()
    return _LEFT.sub("", "\n" + _PIECES.sub(r"\g<0> ", text))[1:]


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """Encodes distinct words; ``path`` is a vocabulary file whose merges follow the ids in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        to_byte = _byte_of()
        ranks = {}
        for token, rank in vocabulary.items():
            ended = token.endswith(_END)
            body = token[: -len(_END)] if ended else token
            if all(c in to_byte for c in body) and body:
                ranks[bytes(to_byte[c] for c in body) + (b" " if ended else b"")] = rank
        self.size = max(ranks.values()) + 1
        self.newline = ranks[b"\n"]
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, with offsets."""
        joined = "\n".join(distinct.to_pylist())
        if not unicodedata.is_normalized("NFC", joined):
            joined = unicodedata.normalize("NFC", joined)
        normal = pa.array(joined.split("\n"), pa.large_string())[: len(distinct)]
        # Words of letters only are one piece; a dotted capital I is two characters in lower case.
        letters = pc.and_(pc.utf8_is_alpha(normal), pc.invert(pc.match_substring(normal, "\u0130")))
        plain = pc.and_(pc.invert(letters), pc.string_is_ascii(normal))
        kinds = [k.to_numpy(zero_copy_only=False) for k in (letters, plain, pc.invert(pc.or_(letters, plain)))]
        order, flat, ends, done = np.empty(len(distinct), np.int64), [], [np.zeros(1, np.int64)], 0
        for kind, mark in zip(kinds, (_mark_letters, _mark_ascii, _mark_any), strict=True):
            count = int(kind.sum())
            order[kind] = np.arange(done, done + count)
            done += count
            if count:
                ids, offsets = self._lines(mark(pc.filter(normal, pa.array(kind))), count)
                flat.append(ids)
                ends.append(offsets[1:] + ends[-1][-1])
        at, offsets = spread(np.concatenate(ends), order)
        return np.concatenate([np.zeros(0, np.uint32), *flat])[at], offsets

    def _lines(self, marked: str, count: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encoding.encode_to_numpy(marked, allowed_special=set(), disallowed_special=())
        breaks = ids == self.newline
        kept = ids[~breaks]
        offsets = np.concatenate([[0], np.flatnonzero(breaks) - np.arange(int(breaks.sum())), [len(kept)]]).astype(np.int64)
        if len(offsets) != count + 1:
            raise ValueError("words and encoded lines differ in number")
        return kept, offsets


    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each whole text, flat, with offsets.

        Texts that spell out a special token, which may stand inside a word, take the library's own path.
        """
        words = split_words(texts)
        ids, offsets = self.words(words.distinct)
        at, ends = spread(offsets, words.codes)
        ids, ends = ids[at], ends[words.offsets]
        spelled = np.zeros(len(texts), bool)
        for token in self.special:
            spelled |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if spelled.any():
            each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for i in np.flatnonzero(spelled):
                each[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, ends = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return ids, ends


def token_counts(encoder: WordEncoder, texts: pa.Array) -> np.ndarray:
    """The number of ids of each whole text."""
    return np.diff(encoder.texts(texts)[1])


def public_path(name: str) -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)
