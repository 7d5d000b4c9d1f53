"""Quality by a byte-level convolutional network trained in numpy.

A text is its UTF-8 bytes, cut into chunks of ``chunk`` bytes. Filters of ``width`` bytes step through every
chunk and reach into the next one, so neighbouring chunks overlap and no byte is left out, however long the text.
Each filter's maximum over a chunk is rectified; a text is described by the mean and by the maximum of its
chunks, and a logistic layer makes one probability of both.

Fitting uses a bounded, documented sample of labelled rows on the driver; scoring reads every whole text where
it lies, without a shuffle. A step of two bytes lets scoring look up pairs of bytes: three lookups per window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wardline.llm.texts import as_text, map_texts, named, utf8

RESULTS = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])
_STRIDE = 2  # bytes; windows start at every second byte, so byte pairs are units
_LOWEST = np.float32(-1e30)
_BYTES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class QualityOptions:
    """``sample_rows`` bounds the labelled rows used for fitting, half of them of each label where there are as many.

    ``sample_bytes`` bounds the bytes they bring: a sampled text over ``sample_bytes / sample_rows`` bytes gives
    pieces of ``piece`` bytes at even distances. Scoring has no such bound. ``cut`` is the score from which on
    a text counts as good.
    """

    sample_rows: int = 4_000
    sample_bytes: int = 8_192_000
    piece: int = 256
    chunk: int = 128
    width: int = 6
    embedding: int = 8
    filters: int = 16
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    cut: float = 0.7
    seed: int = 13


@dataclass
class QualityModel:
    """Byte embeddings, filters (tap, embedding, filter), biases, output weights (means, then maxima), threshold in logits."""

    table: np.ndarray
    filters: np.ndarray
    biases: np.ndarray
    output: np.ndarray
    bias: float
    threshold: float
    chunk: int
    cut: float

    @property
    def taps(self) -> np.ndarray:
        """What each byte adds to each filter at each place of a window: (tap, byte, filter)."""
        return np.einsum("be,kef->kbf", self.table, self.filters).astype(np.float32)

    @property
    def pairs(self) -> list[np.ndarray]:
        """The same for two bytes at a time, by their little-endian 16-bit number."""
        taps, number = self.taps, np.arange(1 << 16)
        return [taps[k][number & 255] + taps[k + 1][number >> 8] for k in range(0, len(taps), 2)]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """Increasing in the logit; the threshold becomes ``cut``."""
        shifted = logits - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def padded(data: np.ndarray, ends: np.ndarray, chunk: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with zero bytes up to whole chunks, at least ``width`` of them: the bytes, first chunk of each text (and
    the end), and which windows start past their text. An empty text has no chunk."""
    sizes = np.diff(ends)
    chunks = np.where(sizes > 0, -(-(sizes + width) // chunk), 0)
    firsts = np.concatenate([[0], np.cumsum(chunks)])
    out = np.zeros(firsts[-1] * chunk, np.uint8)
    at = np.arange(len(data)) + np.repeat(firsts[:-1] * chunk - ends[:-1], sizes)
    out[at] = data
    windows = np.arange(0, len(out), _STRIDE)
    return out, firsts, windows >= np.repeat(firsts[:-1] * chunk + sizes, chunks * (chunk // _STRIDE))


def chunk_maxima(flat: np.ndarray, outside: np.ndarray, pairs: list[np.ndarray], chunk: int) -> np.ndarray:
    """Each filter's maximum over the windows that start in each chunk; each chunk has one inside its text or more,
    except the last of a text, which may hold none: it then has the lowest value."""
    units = np.concatenate([flat.view("<u2"), np.zeros(len(pairs), np.uint16)])
    found = pairs[0][units[: len(outside)]]
    for k, table in enumerate(pairs[1:], start=1):
        found += table[units[k : k + len(outside)]]
    found[outside] = _LOWEST
    return found.reshape(-1, chunk // _STRIDE, found.shape[1]).max(axis=1)


def describe(maxima: np.ndarray, firsts: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Mean and maximum of the rectified chunk maxima of each text; zeros for a text without chunks."""
    rectified = np.maximum(maxima + biases, 0)
    live = np.flatnonzero(np.diff(firsts) > 0)
    out = np.zeros((len(firsts) - 1, 2 * rectified.shape[1]), rectified.dtype)
    if len(live):
        starts = firsts[:-1][live]
        out[live, : rectified.shape[1]] = np.add.reduceat(rectified, starts) / np.diff(firsts)[live][:, None]
        out[live, rectified.shape[1] :] = np.maximum.reduceat(rectified, starts)
    return out


def logits(model: QualityModel, pairs: list[np.ndarray], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per text from all of its bytes, ``data[ends[i]:ends[i + 1]]``; an empty text gets the bias."""
    width = len(model.filters)
    first, parts = 0, [np.zeros(0)]
    while first < len(ends) - 1:  # runs of bounded size; one long text goes through in runs of whole chunks
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + _BYTES_AT_ONCE, side="right")) - 1)
        flat, firsts, outside = padded(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], model.chunk, width)
        step = _BYTES_AT_ONCE // model.chunk * model.chunk
        maxima = [np.zeros((0, model.filters.shape[2]), np.float32)]
        for at in range(0, len(flat), step):
            stop = min(at + step, len(flat))
            seen = flat[at : stop + model.chunk]  # one chunk further, for the windows that reach into it
            masked = np.concatenate([outside[at // _STRIDE : stop // _STRIDE], np.ones((len(seen) - (stop - at)) // _STRIDE, bool)])
            maxima.append(chunk_maxima(seen, masked, pairs, model.chunk)[: (stop - at) // model.chunk])
        parts.append(describe(np.concatenate(maxima), firsts, model.biases) @ model.output + model.bias)
        first = last
    return np.concatenate(parts)


def fit(texts: list[bytes | None], labels: np.ndarray, options: QualityOptions) -> QualityModel:
    """Trains by Adam on whole given texts; a fifth of the rows is kept from training and sets the threshold."""
    rng = np.random.default_rng(options.seed)
    shape = (options.width, options.embedding, options.filters)
    model = QualityModel(
        rng.normal(0, 0.5, (256, options.embedding)), rng.normal(0, 0.3, shape), np.zeros(options.filters),
        rng.normal(0, 0.3, 2 * options.filters), 0.0, 0.0, options.chunk, options.cut,
    )
    if not len(texts) or labels.min() == labels.max():  # one label or none: a constant on the side of what was seen
        model.output[:] = 0
        model.bias = -2.0 if len(labels) and not labels[0] else 2.0
        return model
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    places = ("table", "filters", "biases", "output")
    state = {name: (np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))) for name in places}
    state["bias"] = (0.0, 0.0)
    step = 0
    for _ in range(options.epochs):
        for at in range(0, len(train), options.batch):
            rows, step = train[at : at + options.batch], step + 1
            grads = gradients(model, [texts[r] or b"" for r in rows], labels[rows], weight[rows] / len(rows))
            for name, grad in grads.items():
                first, second = state[name]
                first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
                state[name] = first, second
                rate = options.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(model, name, getattr(model, name) - rate * first / (np.sqrt(second) + 1e-8))
        train = rng.permutation(train)
    kept = [texts[r] or b"" for r in held]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in kept])])
    model.threshold = threshold(logits(model, model.pairs, np.frombuffer(b"".join(kept), np.uint8), ends), labels[held])
    return model


def gradients(model: QualityModel, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss over a batch; only the windows that gave a maximum pass them on."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    width, per_chunk = len(model.filters), model.chunk // _STRIDE
    flat, firsts, outside = padded(np.frombuffer(b"".join(texts), np.uint8), ends, model.chunk, width)
    taps, count = model.taps, model.filters.shape[2]
    longer = np.concatenate([flat, np.zeros(width, np.uint8)])
    scores = np.zeros((len(outside), count), np.float32)
    for k in range(width):
        scores += taps[k][longer[k : k + len(flat) : _STRIDE]]
    scores[outside] = _LOWEST
    cut = scores.reshape(-1, per_chunk, count)
    best = cut.argmax(axis=1)
    maxima = np.take_along_axis(cut, best[:, None], axis=1)[:, 0]
    hidden = describe(maxima, firsts, model.biases)
    logit = hidden @ model.output + model.bias
    error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels)
    back = error[:, None] * model.output
    chunks = np.diff(firsts)
    owner = np.repeat(np.arange(len(texts)), chunks)
    rectified = np.maximum(maxima + model.biases, 0)
    to_chunk = (back[:, :count] / np.maximum(chunks, 1)[:, None])[owner]
    leads = rectified == hidden[owner, count:]  # ties share the gradient of the maximum
    shared = np.add.reduceat(np.concatenate([leads, np.zeros((1, count))]), firsts[:-1]) if len(owner) else np.ones((len(texts), count))
    to_chunk = (to_chunk + leads * (back[:, count:] / np.maximum(shared, 1))[owner]) * (rectified > 0)
    to_taps = np.zeros((width, 256, count))
    starts = (best + np.arange(len(best))[:, None] * per_chunk) * _STRIDE
    column = np.arange(count)
    for k in range(width):
        place = longer[np.minimum(starts + k, len(longer) - 1)].astype(np.int64) * count + column
        to_taps[k] = np.bincount(place.ravel(), to_chunk.ravel(), 256 * count).reshape(256, count)
    return {
        "table": np.einsum("kbf,kef->be", to_taps, model.filters), "filters": np.einsum("kbf,be->kef", to_taps, model.table),
        "biases": to_chunk.sum(axis=0), "output": hidden.T @ error + 1e-4 * model.output, "bias": error.sum(),
    }


def threshold(values: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the cut with the largest sum of both labels' shares told right; 0 where one label is missing."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-values, kind="stable")
    ranked, good = values[order], labels[order]
    gain = np.cumsum(good) / good.sum() - np.cumsum(1 - good) / (1 - good).sum()
    ends = np.append(ranked[1:] < ranked[:-1], False)  # a cut lies between two different values
    if not ends.any():
        return 0.0
    best = int(np.argmax(np.where(ends, gain, -2.0)))
    return float((ranked[best] + ranked[best + 1]) / 2)


def sample_labelled(docs: DataFrame, labels: DataFrame, options: QualityOptions, allowed: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[list[bytes | None], np.ndarray]:
    """Bytes of at most ``sample_rows`` labelled texts in hash order of their key, at most ``sample_bytes`` in all.

    Null keys and labels other than 0 and 1 are left out. A key with several labels takes the lowest; of several
    texts of one key the one of the smallest hash. The chosen keys are bounded, so their join may broadcast them.
    """
    rows = labels.select(named(labels, key).alias("key"), named(labels, label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(allowed) if allowed is not None else rows
    rows = rows.groupBy("key").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.col("key").cast("string"), F.lit(options.seed))
    half = options.sample_rows // 2
    chosen = rows.where("label = 1").orderBy(order, "key").limit(half).unionAll(rows.where("label = 0").orderBy(order, "key").limit(options.sample_rows - half))
    most = max(options.piece, options.sample_bytes // options.sample_rows)
    raw, size = F.col("raw"), F.octet_length("raw")
    pieces = max(most // options.piece, 1)
    spread = F.concat(*[F.substring(raw, F.floor((size - options.piece) * F.lit(i) / max(pieces - 1, 1)).cast("int") + 1, F.lit(options.piece)) for i in range(pieces)])
    found = docs.select(named(docs, key).alias("key"), named(docs, text).cast("binary").alias("raw")).join(F.broadcast(chosen), "key")
    short = found.select("key", "label", F.xxhash64("raw").alias("mark"), F.when(size <= most, raw).otherwise(spread).alias("bytes"))
    once = short.groupBy("key").agg(F.min_by(F.struct("label", "bytes"), F.struct("mark", "bytes")).alias("row"))
    collected = once.select("key", "row.*").orderBy("key").toArrow()
    return collected.column("bytes").to_pylist(), collected.column("label").to_numpy().astype(np.float64)


def score(docs: DataFrame, model: QualityModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the model's ``cut`` on).

    Nothing but the text enters the score. Null and empty texts get the score of no evidence. Columns of
    ``docs`` that have a result's name are replaced; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, a few kilobytes

    def start():
        own = shared.value
        pairs = own.pairs

        def work(texts: pa.Array) -> dict[str, np.ndarray]:
            scores = own.probabilities(logits(own, pairs, *utf8(as_text(texts)))).astype(np.float64)
            return {"score": scores, "predicted": (scores >= own.cut).astype(np.int32)}

        return work

    return map_texts(docs, RESULTS, start, text, drop_text)
