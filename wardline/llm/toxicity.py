"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed vectors of the word and of its character four-grams and five-grams, so
that unseen forms of a known stem are recognised. Filters of several widths run over the words, each
filter's maximum over the whole text is pooled, and a logistic layer gives the logit. Thresholds are calibrated
for each language as told from the text itself; the score is shifted so that 0.5 is that threshold.

Fitting learns from every labelled row: rows are dealt to blocks, a block takes its steps from the common start in its own
task, and after each pass the blocks' changes are averaged, those of a hashed vector over the blocks that changed it. A
fifth of the rows is kept from training and sets the thresholds. Scoring reads every whole text where it lies, without a shuffle. As the convolution is linear, each width is a sum of per-word projections: words
are projected once per distinct word of a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from wardline.llm.repetition import mixed
from wardline.llm.texts import Words, as_text, map_texts, named, slices, split_words, utf8
from wardline.plans.skew import join_lookup
from wardline.session import stage

# Frequent function words that tell the languages apart, lower case.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "as", "are", "this"],
    "fr": ["le", "la", "de", "et", "les", "des", "que", "un", "une", "est", "du", "dans", "pour", "qui"],
    "de": ["der", "die", "und", "das", "von", "den", "ist", "nicht", "ein", "eine", "mit", "sich", "auf", "dem"],
    "es": ["el", "la", "de", "que", "y", "los", "las", "un", "por", "con", "una", "su", "para", "del"],
}
_WORDS_AT_ONCE = 1 << 15
_RUN_BYTES = 8 << 20  # texts of a block that are split into words at once
_SCORED_BYTES = 2 << 20  # texts that are scored at once: each byte takes some 50 bytes of arrays for a moment
_PART = 2_048  # hashed vectors in a row while changes are added
_ENOUGH = 10  # held rows of each label that a language's own threshold needs
_HELD = 5  # one labelled row of so many sets the thresholds
_PARTS = StructType([StructField("block", IntegerType()), StructField("part", IntegerType()), StructField("rows", LongType()), StructField("total", BinaryType())])
_JUDGED = StructType([StructField("language", IntegerType()), StructField("logit", DoubleType()), StructField("label", IntegerType())])
LANGUAGES = ["", *FUNCTION_WORDS]  # the first: no function word seen
RESULTS = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("language", StringType())])


@dataclass(frozen=True)
class ToxicityOptions:
    """``block_rows`` labelled rows make a block, which one task learns from in each of the ``epochs`` passes."""

    block_rows: int = 12_000
    buckets: int = 1 << 17
    width: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 5
    batch: int = 32
    rate: float = 0.03
    seed: int = 7


def word_features(distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, flat, with offsets: the word, its byte four-grams and five-grams with edges.

    Letters are folded to lower case; the grams run over UTF-8 bytes.
    """
    lowered = pc.utf8_lower(distinct.cast(pa.large_string()))
    edged = pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\x02", lowered, "\x03", "")])
    raw, ends = utf8(edged)
    lengths = np.diff(ends)
    data = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    at = np.arange(len(raw))
    room = np.repeat(ends[1:], lengths) - at
    four = data[at] | data[at + 1] << np.uint64(8) | data[at + 2] << np.uint64(16) | data[at + 3] << np.uint64(24)
    five = four | data[at + 4] << np.uint64(32) | np.uint64(1 << 40)
    words = np.zeros(len(lengths), np.uint64)
    if len(raw):  # a polynomial over the bytes; positions count from the word's start
        power = mixed(at - np.repeat(ends[:-1], lengths))
        words = np.add.reduceat(mixed(data[: len(raw)]) * power, ends[:-1])
    fours, fives = np.maximum(lengths - 3, 0), np.maximum(lengths - 4, 0)
    found = np.concatenate([[0], np.cumsum(1 + fours + fives)])
    ids = np.empty(found[-1], np.uint32)
    ids[found[:-1]] = mixed(words) % np.uint64(buckets)
    ids[_places(found[:-1] + 1, fours)] = mixed(four[room >= 4]) % np.uint64(buckets)
    ids[_places(found[:-1] + 1 + fours, fives)] = mixed(five[room >= 5]) % np.uint64(buckets)
    return ids, found


def all_features(distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` of many words, some at a time."""
    parts = [word_features(distinct[at : at + _WORDS_AT_ONCE], buckets) for at in range(0, len(distinct), _WORDS_AT_ONCE)]
    counts = np.concatenate([np.zeros(0, np.int64), *[np.diff(ends) for _, ends in parts]])
    return np.concatenate([np.zeros(0, np.uint32), *[ids for ids, _ in parts]]), np.concatenate([[0], np.cumsum(counts)])


def windows(embedded: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """What a kernel's filters give at each word of texts that follow each other, none empty; past a text's end words are zeros."""
    here = (embedded @ kernel[0]).take(codes, axis=0)
    for k in range(1, min(len(kernel), len(codes))):
        later = (embedded @ kernel[k]).take(codes[k:], axis=0)
        for j in range(1, k + 1):  # the last k words of a text reach past it
            past = ends - j
            later[past[(past >= starts) & (past < len(later))]] = 0
        here[: len(later)] += later
    return here


@dataclass
class ToxicityModel:
    """Embedding table, filters by width (position, embedding, filter), biases, output weights, thresholds in logits."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: np.ndarray

    def embed(self, distinct: pa.Array) -> np.ndarray:
        found = np.zeros((len(distinct), self.table.shape[1]), np.float32)
        for at in range(0, len(distinct), _WORDS_AT_ONCE):
            ids, ends = word_features(distinct[at : at + _WORDS_AT_ONCE], len(self.table))
            found[at : at + _WORDS_AT_ONCE] = np.add.reduceat(self.table.take(ids, axis=0), ends[:-1])
        return found

    def pooled(self, words: Words) -> np.ndarray:
        """Each filter's maximum over all windows of each text; windows past a text's end see zeros, no words give zeros."""
        embedded = self.embed(words.distinct)
        live = np.flatnonzero(words.counts > 0)
        found = np.zeros((len(words.counts), sum(f.shape[2] for f in self.filters.values())), np.float32)
        if not len(live):
            return found
        starts, column, ends = words.offsets[:-1][live], 0, words.offsets[1:][live]
        for width, kernel in self.filters.items():
            here = windows(embedded, words.codes, starts, ends, kernel)
            here += self.biases[width]
            found[live, column : column + kernel.shape[2]] = np.maximum.reduceat(here, starts)
            column += kernel.shape[2]
        return found

    def logits(self, words: Words) -> np.ndarray:
        return self.pooled(words) @ self.output + self.bias


def language_of(words: Words) -> np.ndarray:
    """The language (index into ``LANGUAGES``) whose function words are most frequent; ties go to the earlier one."""
    lowered = pc.ascii_lower(words.distinct)
    size = len(words.counts)
    votes = np.zeros((size, len(LANGUAGES)))
    owners = words.owners
    for i, name in enumerate(LANGUAGES[1:], start=1):
        hit = pc.is_in(lowered, pa.array(FUNCTION_WORDS[name], lowered.type)).to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else np.zeros(0, bool)
        votes[:, i] = np.bincount(owners[hit], minlength=size)
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), 0)


def _start(options: ToxicityOptions, rng: np.random.Generator) -> tuple[ToxicityModel, dict]:
    """A model before its first step, and the sums of squares of its steps."""
    model = ToxicityModel(
        rng.normal(0, 0.02, (options.buckets, options.width)).astype(np.float32),
        {w: rng.normal(0, 0.5 / np.sqrt(w), (w, options.width, options.filters)).astype(np.float32) for w in options.widths},
        {w: np.zeros(options.filters, np.float32) for w in options.widths},
        rng.normal(0, 0.3, len(options.widths) * options.filters).astype(np.float32), -1.0, np.zeros(len(LANGUAGES)),
    )
    state = {"table": np.full(options.buckets, 1e-2, np.float32), "output": np.full(len(model.output), 1e-2), "bias": 1e-2}
    state |= {w: np.full(model.filters[w].shape, 1e-2) for w in options.widths} | {("b", w): np.full(options.filters, 1e-2) for w in options.widths}
    return model, state


def _constant(model: ToxicityModel, toxic: bool) -> ToxicityModel:
    """One label or none was seen: a constant on its side."""
    model.output[:] = 0
    model.bias = 2.0 if toxic else -2.0
    return model


def _class_weights(labels: np.ndarray, share: float) -> np.ndarray:
    return np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))


def fit(texts: list[str | None], labels: np.ndarray, options: ToxicityOptions) -> ToxicityModel:
    """Trains on whole texts in memory by Adagrad; a fifth of the rows is kept from training and sets the thresholds."""
    rng = np.random.default_rng(options.seed)
    model, state = _start(options, rng)
    if not len(texts) or labels.min() == labels.max():
        return _constant(model, bool(len(labels) and labels[0]))
    column = as_text(pa.array(texts, pa.string()))
    words = split_words(column)
    features, ends = all_features(words.distinct, options.buckets)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // _HELD], order[len(order) // _HELD :]
    weight = _class_weights(labels, labels.mean())
    for _ in range(options.epochs):
        for at in range(0, len(train), options.batch):
            _step(model, state, words, features, ends, train[at : at + options.batch], labels, weight, options)
        train = rng.permutation(train)
    words = split_words(column.take(pa.array(held)))
    logits, found, truth = model.logits(words), language_of(words), labels[held]
    ones = np.ones(len(held))
    _set_thresholds(model, found, logits, logits, ones, truth)
    return model


def learn(docs: DataFrame, labels: DataFrame, options: ToxicityOptions, allowed: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model of every labelled text; null keys and labels are left out, ``allowed`` is a test of the column ``key``.

    Rows that repeat a key take part once, with the largest label and the first text. The driver holds one averaged model.
    """
    model, state = _start(options, np.random.default_rng(options.seed))
    marks = labels.select(named(labels, key).alias("key"), named(labels, label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    marks = (marks.where(allowed) if allowed is not None else marks).groupBy("key").agg(F.max("label").alias("label"))
    blocks = max(1, -(-marks.count() // options.block_rows))
    texts = docs.select(named(docs, key).alias("key"), named(docs, text).alias("text")).where("key IS NOT NULL")
    found = join_lookup(texts.where(allowed) if allowed is not None else texts, marks, ["key"], "inner", heavy=None)
    own = found.repartition(blocks, "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    order = F.xxhash64(F.col("key").cast("string"), F.lit(options.seed))
    # a file, or some where there are more, is a block: its rows lie in hash order, and so few bytes are one row group
    rows = stage(own.withColumn("held", F.pmod(order, F.lit(_HELD)) == 0).sortWithinPartitions(order, "key").select("label", "text", "held"), "labelled")
    seen, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not seen or toxic in (0, seen):
        return _constant(model, bool(toxic))
    train = rows.where("NOT held").select("text", "label").coalesce(blocks)
    for turn in range(options.epochs):
        shared = docs.sparkSession.sparkContext.broadcast((model, state))
        parts = train.mapInArrow(_learn_block(shared, toxic / seen, options, turn), _PARTS)
        added = parts.groupBy("part").applyInArrow(_add_part, _PARTS).toArrow()
        shared.unpersist()
        _apply(model, state, added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    judged = rows.where("held").select("text", "label").mapInArrow(_judge(shared), _JUDGED)
    cut = F.round("logit", 2)  # at most a row for each language and hundredth
    bins = judged.groupBy("language", cut.alias("cut")).agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    bins = bins.orderBy("language", "cut").toArrow()
    shared.unpersist()
    _set_thresholds(model, *(bins.column(c).to_numpy() for c in ("language", "low", "high", "n", "hits")))
    return model


def _learn_block(shared, share: float, options: ToxicityOptions, turn: int):
    """How a block's steps change the parameters: of hashed vectors, sums over blocks; of the others, times the block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        model, state = _copied(*shared.value)
        rng, rows = np.random.default_rng([options.seed, turn, block]), 0
        for batch in slices(batches, "text", _RUN_BYTES):
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            words = split_words(as_text(batch.column("text")))
            features, ends = all_features(words.distinct, options.buckets)
            order, weight = rng.permutation(len(labels)), _class_weights(labels, share)
            for at in range(0, len(order), options.batch):
                _step(model, state, words, features, ends, order[at : at + options.batch], labels, weight, options)
            rows += len(labels)
            del words, features, ends
            pa.default_memory_pool().release_unused()
        if rows:
            old, old_state = shared.value
            yield _part(block, -1, rows, (_dense(model, state) - _dense(old, old_state)) * rows)
            for part in range(-(-options.buckets // _PART)):
                at = slice(part * _PART, (part + 1) * _PART)
                moved = state["table"][at] != old_state["table"][at]
                change = np.column_stack([model.table[at] - old.table[at], state["table"][at] - old_state["table"][at], moved])
                if moved.any():
                    yield _part(block, part, rows, change.ravel())

    return run


def _part(block: int, part: int, rows: int, total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _PARTS.names)


def _add_part(key: tuple, table: pa.Table) -> pa.Table:
    """The sum of a part over the blocks, in their order."""
    table, total = table.sort_by("block"), 0.0
    for piece in table.column("total"):
        total = total + np.frombuffer(piece.as_buffer(), np.float32).astype(np.float64)
    return pa.Table.from_batches([_part(0, key[0].as_py(), sum(table.column("rows").to_pylist()), total)])


def _apply(model: ToxicityModel, state: dict, added: pa.Table) -> None:
    for part, rows, total in zip(*(added.column(c).to_pylist() for c in ("part", "rows", "total")), strict=True):
        change = np.frombuffer(total, np.float32).astype(np.float64)
        if part < 0:
            _set_dense(model, state, _dense(model, state) + change / rows)
            continue
        at = slice(part * _PART, (part + 1) * _PART)
        change = change.reshape(-1, model.table.shape[1] + 2)
        mean = change[:, :-1] / np.maximum(change[:, -1:], 1)
        model.table[at] += mean[:, :-1].astype(np.float32)
        state["table"][at] += mean[:, -1].astype(np.float32)


def _copied(model: ToxicityModel, state: dict) -> tuple[ToxicityModel, dict]:
    copied = ToxicityModel(
        model.table.copy(), {w: f.copy() for w, f in model.filters.items()}, {w: b.copy() for w, b in model.biases.items()},
        model.output.copy(), model.bias, model.thresholds.copy(),
    )
    return copied, {k: np.copy(v) if np.ndim(v) else v for k, v in state.items()}


def _dense(model: ToxicityModel, state: dict) -> np.ndarray:
    """Everything but the hashed vectors, in a row."""
    own = [model.output, [model.bias], *model.filters.values(), *model.biases.values()]
    sums = [state["output"], [state["bias"]], *[state[w] for w in model.filters], *[state["b", w] for w in model.biases]]
    return np.concatenate([np.ravel(x).astype(np.float64) for x in [*own, *sums]])


def _set_dense(model: ToxicityModel, state: dict, flat: np.ndarray) -> None:
    at = 0

    def take(like):
        nonlocal at
        at += np.size(like)
        return flat[at - np.size(like) : at].reshape(np.shape(like))

    model.output, model.bias = take(model.output).astype(np.float32), float(take([0.0])[0])
    model.filters = {w: take(f).astype(np.float32) for w, f in model.filters.items()}
    model.biases = {w: take(b).astype(np.float32) for w, b in model.biases.items()}
    state["output"], state["bias"] = take(state["output"]), float(take([0.0])[0])
    state |= {w: take(state[w]) for w in model.filters}
    state |= {("b", w): take(state["b", w]) for w in model.biases}


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SCORED_BYTES):
            words = split_words(as_text(batch.column("text")))
            logits = np.clip(shared.value.logits(words).astype(np.float64), -30, 30)
            yield pa.RecordBatch.from_arrays([pa.array(language_of(words).astype(np.int32)), pa.array(logits), batch.column("label").cast(pa.int32())], _JUDGED.names)

    return run


def _set_thresholds(model: ToxicityModel, languages: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> None:
    """Thresholds from counts of held rows by language and range of logits; a language with fewer than ``_ENOUGH`` rows of
    either label takes that of all: the best cut around two or three rows flags a large part of the others."""
    overall = _threshold(low, high, n, hits, 0.0)
    for i in range(len(LANGUAGES)):
        own = languages == i
        model.thresholds[i] = _threshold(low[own], high[own], n[own], hits[own], overall) if min(hits[own].sum(), (n - hits)[own].sum()) >= _ENOUGH else overall


def _threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray, default: float) -> float:
    """The middle of the cut with the best F1 among held rows, counted by ranges of logits that do not overlap; ``default``
    where one label is missing."""
    if not 0 < hits.sum() < n.sum():
        return default
    order = np.argsort(-low, kind="stable")
    low, high, rows, found = low[order], high[order], np.cumsum(n[order]), np.cumsum(hits[order])
    f1 = 2 * found / (rows + found[-1])
    ok = np.append(high[1:] < low[:-1], True)
    best = int(np.argmax(np.where(ok, f1, -1)))
    below = high[best + 1] if best + 1 < len(low) else low[best] - 2.0
    return float((low[best] + below) / 2)


def _step(model, state, words, features, ends, rows, labels, weight, options) -> None:
    """One Adagrad step over the pooled windows of a batch of texts."""
    rows = rows[words.counts[rows] > 0]
    if not len(rows):
        return
    spans = [np.arange(words.offsets[r], words.offsets[r + 1]) for r in rows]
    used, local = np.unique(words.codes[np.concatenate(spans)], return_inverse=True)
    sizes = (ends[used + 1] - ends[used]).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    flat = features.take(_places(ends[used], sizes))
    embedded = np.add.reduceat(model.table.take(flat, axis=0), firsts)
    sequence, lengths = embedded.take(local, axis=0), np.array([len(s) for s in spans])
    starts = np.cumsum(lengths) - lengths
    pooled, where = [], []
    for w in options.widths:
        here = windows(embedded, local, starts, starts + lengths, model.filters[w])
        here += model.biases[w]
        best = np.stack([s + here[s : s + n].argmax(axis=0) for s, n in zip(starts, lengths, strict=True)])
        pooled.append(here[best, np.arange(options.filters)])
        where.append(best)
    hidden = np.concatenate(pooled, axis=1)
    logit = hidden @ model.output + model.bias
    error = (weight[rows] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) / len(rows)).astype(np.float32)
    back = error[:, None] * model.output
    update = _adagrad(state, options.rate)
    model.output -= update("output", hidden.T @ error + 1e-4 * model.output)
    model.bias -= float(update("bias", error.sum()))
    to_sequence = np.zeros_like(sequence)
    for i, w in enumerate(options.widths):
        own = back[:, i * options.filters : (i + 1) * options.filters]
        grad = np.zeros_like(model.filters[w])
        for k in range(w):
            at = where[i] + k
            inside = at < (starts + lengths)[:, None]
            at = np.minimum(at, len(sequence) - 1)
            push = own * inside
            grad[k] = np.einsum("rfd,rf->df", sequence[at], push)
            np.add.at(to_sequence, at.ravel(), (push[:, :, None] * model.filters[w][k].T[None]).reshape(-1, sequence.shape[1]))
        model.filters[w] -= update(w, grad)
        model.biases[w] -= update(("b", w), own.sum(axis=0))
    touched = np.flatnonzero(to_sequence.any(axis=1))
    if not len(touched):
        return
    to_words = np.zeros_like(embedded)
    np.add.at(to_words, local[touched], to_sequence[touched])
    moved = np.flatnonzero(to_words.any(axis=1))
    ids = flat.take(_places(firsts[moved], sizes[moved]))
    unique, inverse = np.unique(ids, return_inverse=True)
    grads = np.zeros((len(unique), to_words.shape[1]), np.float32)
    np.add.at(grads, inverse, np.repeat(to_words[moved], sizes[moved], axis=0))
    state["table"][unique] += (grads**2).mean(axis=1)
    model.table[unique] -= 5 * options.rate * grads / np.sqrt(state["table"][unique])[:, None]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _adagrad(state: dict, rate: float):
    def update(key, grad):
        state[key] = state[key] + np.square(grad)
        return (rate * grad / np.sqrt(state[key])).astype(np.float32)

    return update


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and the ``language`` told from the text.

    Nothing but the text enters the score. Null and empty texts get the score of no evidence. Columns of
    ``docs`` that have a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def start():
        own = shared.value

        def work(texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
            words = split_words(texts)
            language = language_of(words)
            scores = 1 / (1 + np.exp(-np.clip(own.logits(words) - own.thresholds[language], -30, 30)))
            return {"score": scores.astype(np.float64), "predicted": (scores >= 0.5).astype(np.int32), "language": pa.array([LANGUAGES[i] for i in language])}

        return work

    return map_texts(docs, RESULTS, start, text, drop_text, limit=_SCORED_BYTES)
