"""Trained operators: held-out accuracy, exact base counts, gradients, and odd rows."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import lm, queries, toxicity

from .test_texts_and_rules import EXTRA_SCHEMA, extra_rows


def test_classifier_finds_held_out_toxic_texts():
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, 60))
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(60)), rng.choice(["stinker", "stinkers", "stinkerly", "blockhead"]))
        texts.append(" ".join(words))
        labels.append(float(toxic))
    model = toxicity.fit(texts[:700], np.array(labels[:700]), toxicity.ToxicityOptions(epochs=8))
    words = toxicity.split_words(toxicity.as_text(toxicity.pa.array(texts[700:])))
    found = model.logits(words) >= model.thresholds[toxicity.language_of(words)]
    assert (found == np.array(labels[700:])).mean() > 0.97


def test_scores_cover_odd_rows_and_replace_clashing_columns(spark):
    model = toxicity.fit(["good words", "bad words"] * 20, np.array([0.0, 1.0] * 20), toxicity.ToxicityOptions(epochs=3))
    frame = spark.createDataFrame(extra_rows(), EXTRA_SCHEMA)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(extra_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.score(frame.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [0.0, 0.0], [1.0, 1.0]])
def test_one_label_gives_a_constant(labels):
    model = toxicity.fit(["a b", "c"][: len(labels)], np.array(labels), toxicity.ToxicityOptions())
    words = toxicity.split_words(toxicity.as_text(toxicity.pa.array(["a b", "", None], toxicity.pa.string())))
    logits = model.logits(words) - model.thresholds[0]
    assert np.allclose(logits, 2.0 if labels and labels[0] else -2.0)


def test_learns_from_every_labelled_row_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(7_000):
        words = [f"word{k}" for k in rng.integers(300, size=8)] + (["stinker" if i % 8 else "blockhead"] if i % 4 == 0 else [])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in [*rows, *rows[:50]]] + [(None, 1), (8_000, 1), (3, None)], "doc_id long, toxic int")
    seen, apply = [], toxicity._apply

    def noted(model, state, added):
        seen.append({p: n for p, n in zip(added.column("part").to_pylist(), added.column("rows").to_pylist(), strict=True)}[-1])
        apply(model, state, added)

    monkeypatch.setattr(toxicity, "_apply", noted)
    model = toxicity.learn(docs, labels, toxicity.ToxicityOptions(block_rows=2_000))
    held = spark.range(7_000).where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(toxicity.ToxicityOptions().seed)), F.lit(5)) == 0).count()
    assert seen == [7_000 - held] * 5
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([scored[i] == x for i, _, x in rows]) > 0.97


def test_few_toxic_rows_of_a_language_set_no_threshold():
    model, _ = toxicity._start(toxicity.ToxicityOptions(buckets=8), np.random.default_rng(0))
    logits = np.concatenate([np.linspace(2, 3, 20), np.linspace(-3, -1, 180), [-2.5], np.linspace(-3, -2, 40)])
    hits = np.concatenate([np.ones(20), np.zeros(180), [1.0], np.zeros(40)])
    toxicity._set_thresholds(model, np.repeat([1, 2], [200, 41]), logits, logits, np.ones(len(logits)), hits)
    assert (model.thresholds == model.thresholds[0]).all() and -1 < model.thresholds[0] < 2


def test_toxicity_query_keeps_the_folds(spark, folder):
    rows = queries.QUERIES["op2_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def small_model():
    options = lm.LmOptions(bands=4, band=4, width=5, key_width=3, window=6, overlap=2, batch=2)
    return lm.new_model(np.bincount(np.arange(40) % 23, minlength=30), options), options


def test_gradients_are_the_slopes():
    model, options = small_model()
    ids = np.array([0, 3, 5, 1, 2, 6, 7, 8, 9, 1, 1, 2])
    inputs, targets, counted, _ = lm.cut_windows(model.slots[ids], np.array([0, 8, 12]), options, model.start)
    params = model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    grads = lm._gradients(params, inputs, targets, counted, options)
    loss = lambda: -lm.log_probabilities(model, inputs, targets, counted).mean() * math.log(10)
    rng = np.random.default_rng(0)
    for name, values in params.items():
        for _ in range(5):
            at = tuple(int(rng.integers(n)) for n in values.shape)
            values[at] += 1e-5
            above = loss()
            values[at] -= 2e-5
            slope = (above - loss()) / 2e-5
            values[at] += 1e-5
            assert abs(slope - grads[name][at]) < 1e-6, name


def test_every_id_is_counted_once_and_probabilities_sum_to_one():
    model, options = small_model()
    lengths = [0, 1, 5, 6, 7, 11, 40]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    slots = np.random.default_rng(1).integers(0, 16, offsets[-1])
    inputs, targets, counted, text = lm.cut_windows(slots, offsets, options, model.start)
    assert counted.sum() == offsets[-1] and targets[counted].tolist() == slots.tolist()
    assert np.repeat(text, counted.sum(axis=1)).tolist() == np.repeat(np.arange(len(lengths)), lengths).tolist()
    every = np.array([[3, 5, i] for i in range(30)]).ravel()
    third = [lm.score_ids(model, every[3 * i : 3 * i + 3], np.array([0, 3]))[0] - lm.score_ids(model, every[3 * i : 3 * i + 2], np.array([0, 2]))[0] for i in range(30)]
    assert abs(sum(10**x for x in third) - 1) < 1e-4


def test_windows_agree_where_the_context_is_the_same():
    model, options = small_model()
    ids = np.random.default_rng(2).integers(0, 30, 6)
    whole = lm.score_ids(model, np.tile(ids, 3), np.array([0, 6, 12, 18]))
    assert np.allclose(whole, whole[0])


def base_scores(docs, learned):
    folded = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(folded)) + ["\n"] for t in docs]
    counts = Counter(w for t, own in zip(tokens, learned, strict=True) if own for w in t)
    total = sum(counts.values()) + len(counts) + 1
    return [(len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / total) for w in t)) for t in tokens], sum(counts.values())


QUICK = lm.LmOptions(sample_rows=40, train_ids=20_000, bands=16, band=16, width=16, block_bytes=60_000)


@pytest.mark.parametrize("block_bytes", [60_000, 1 << 30])
def test_base_scores_equal_plain_counts_over_blocks(spark, folder, block_bytes):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, r[1]) for i, r in enumerate(extra_rows())], "doc_id long, text string")
    both = docs.unionAll(odd)
    held = lm.F.crc32(lm.F.col("id").cast("string")) % 7 == 2
    found = {r["doc_id"]: r for r in lm.score_corpus(both, held, options=replace(QUICK, block_bytes=block_bytes)).collect()}
    rows = both.collect()
    learned = [zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for r in rows]
    expected, total = base_scores([r["text"] for r in rows], learned)
    assert len(found) == len(rows)
    for r, own, (n, known, base) in zip(rows, learned, expected, strict=True):
        got = found[r["doc_id"]]
        assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == (not own, n, known, total)
        assert abs(got["base_score"] - base) < 1e-6 * max(1, abs(base)) and got["score"] < 0 and math.isfinite(got["score"])


def test_training_beats_the_frequencies(spark, folder):
    texts = lm.as_text(spark.read.parquet(f"{folder}/documents.parquet").select("text").toArrow().column("text"))
    encoder = lm.word_encoder(lm.public_path("word_bpe_49k.json"))
    ids, offsets = encoder.texts(texts)
    options = lm.LmOptions(train_ids=150_000, bands=32, band=32, width=24)
    counts = np.bincount(ids, minlength=encoder.size)
    cut = 150
    model, untrained = lm.train(ids[: offsets[cut]], offsets[: cut + 1], counts, options), lm.new_model(counts, options)
    held = ids[offsets[cut] :], offsets[cut:] - offsets[cut]
    assert lm.score_ids(model, *held).sum() > 0.95 * lm.score_ids(untrained, *held).sum()


def test_lm_of_empty_all_held_out_and_clashing_columns(spark):
    frame = spark.createDataFrame(extra_rows(), EXTRA_SCHEMA)
    assert lm.score_corpus(frame.limit(0), lm.F.lit(False), options=QUICK).count() == 0
    rows = lm.score_corpus(frame, lm.F.lit(True), options=QUICK).collect()
    assert len(rows) == len(extra_rows()) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in rows)


def test_every_training_text_is_learned_from(spark):
    words = "alpha river stone cloud paper green seven winter maple copper orange silver ladder window garden bridge".split()
    cycle = " ".join(words) + " "
    docs = spark.createDataFrame([(1, cycle * 9_000), (2, cycle * 20)], "doc_id long, text string")  # the long one has over 750,000 bytes
    row = lm.score_corpus(docs, lm.F.col("id") == 2, options=lm.LmOptions(block_bytes=200_000, train_ids=1, bands=16, band=16, width=16)).where("doc_id = 2").first()
    assert row["score"] > 0.5 * row["base_score"]


def test_averaged_blocks_beat_the_frequencies(spark, folder):
    docs, held = spark.read.parquet(f"{folder}/documents.parquet"), lm.F.col("id") % 5 == 0
    options = lm.LmOptions(train_ids=150_000, bands=32, band=32, width=24)
    found = [lm.score_corpus(docs, held, options=o).where("held_out").agg(lm.F.sum("score")).first()[0] for o in (replace(options, block_bytes=200_000), options, replace(options, rate=0.0))]
    assert found[0] > found[2] and found[1] > 0.95 * found[2]


def test_ids_are_predicted_from_at_least_six_before():
    options = lm.LmOptions()
    _, _, counted, text = lm.cut_windows(np.arange(500), np.array([0, 500]), options, -1)
    firsts = counted.argmax(axis=1)
    assert firsts[1:].min() >= 6 and options.heads == 2


def test_texts_are_scored_in_little_memory(monkeypatch):
    """A run of scored texts takes little more than its arrays; the executor of the pipeline passed 3 GB on 8 MB runs."""
    model, _ = toxicity._start(toxicity.ToxicityOptions(), np.random.default_rng(0))
    limits = []
    monkeypatch.setattr(toxicity, "map_texts", lambda *a, limit, **k: limits.append(limit))
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    toxicity.score(frame, model)
    texts = toxicity.pa.array([" ".join(f"word{i % 997}" for i in range(k, k + 1000)) for k in range(1200)])
    run = next(toxicity.slices(iter([toxicity.pa.RecordBatch.from_arrays([texts], ["text"])]), "text", limits[0])).column(0)
    tracemalloc.start()
    model.logits(toxicity.split_words(toxicity.as_text(run)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_windows_stop_at_the_end_of_their_text():
    rng = np.random.default_rng(0)
    counts = np.array([1, 2, 3, 1, 7])
    ends, kernel, embedded = np.cumsum(counts), rng.normal(size=(3, 4, 2)).astype(np.float32), rng.normal(size=(5, 4)).astype(np.float32)
    codes = rng.integers(0, 5, ends[-1])
    found = toxicity.windows(embedded, codes, ends - counts, ends, kernel)
    for at in range(len(codes)):
        own = [codes[at + k] for k in range(3) if at + k < ends[np.searchsorted(ends, at, side="right")]]
        assert np.allclose(found[at], sum(embedded[c] @ kernel[k] for k, c in enumerate(own)), atol=1e-5)
    assert toxicity.windows(embedded, codes[:1], np.array([0]), np.array([1]), kernel).shape == (1, 2)
