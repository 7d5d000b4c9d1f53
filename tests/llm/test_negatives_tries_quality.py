"""Hard negatives, prefix tries and the byte-level classifier against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import hard_negatives as hn
from wardline.llm import prefix_trie as pt
from wardline.llm import quality, queries

from .test_texts_and_rules import EXTRA_SCHEMA, ODD, extra_rows

# --- hard negatives


def plain_negatives(rows, every=50, n_positives=5, n_negatives=3):
    """``rows``: (id, label, vector of whole numbers), each id once."""
    out, vectors = [], {i: (label, v) for i, label, v in rows}
    for a, (label, v) in vectors.items():
        if a % every:
            continue
        scores = [(-sum(int(x) * int(y) for x, y in zip(v, w)), i, other == label) for i, (other, w) in vectors.items() if i != a]
        for score, p, _ in sorted(s for s in scores if s[2])[:n_positives]:
            fits = sorted((s, i) for s, i, own in scores if not own and 50 * -score <= 100 * -s <= 95 * -score)
            out += [(a, p, r, i, -score, -s) for r, (s, i) in enumerate(fits[:n_negatives], start=1)]
    return sorted(out)


def mined(spark, rows, every=50, options=hn.GnatOptions()):
    frame = spark.createDataFrame([(i, label, [int(x) for x in v]) for i, label, v in rows], "id long, label long, vec array<long>")
    return sorted(tuple(r) for r in hn.mine(frame, F.col("id") % every == 0, options=options).collect())


def cluster_rows(n=900, width=6, scale=60, seed=3):
    """Clusters, one vector that a third of the rows share, ties, zeros and opposite vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (12, width))
    x = np.floor(centres[rng.integers(0, 12, n)] + rng.normal(0, scale / 8, (n, width))).astype(int)
    x[rng.random(n) < 0.33] = x[0]
    x[5], x[6], x[50] = 0, -x[0], 0
    return [(i, int(l), v.tolist()) for i, (l, v) in enumerate(zip(rng.integers(0, 4, n), x))]


SMALL_TREE = hn.GnatOptions(sample_rows=200, arity=4, block_rows=64, query_rows=8, most_cells=12, leaf_rows=16)


def test_negatives_equal_all_comparisons(spark):
    rows = cluster_rows()
    want = plain_negatives(rows, 10)
    assert len(want) > 300 and mined(spark, rows, 10, SMALL_TREE) == want


def test_siblings_are_left_out_and_nothing_is_lost():
    rows = cluster_rows(3000)
    x = np.array([v for _, _, v in rows], float)
    nodes, _ = hn.grow(x[:500], 6, 100, 6, 64, 1)
    leaf = hn.route(nodes, x, widen=True)
    scores = x[:40] @ x.T
    high = np.sort(scores, axis=1)[:, [-10, -100]].astype(np.int64)
    low = (high * 0.9).astype(np.int64)
    seen, most = np.zeros((40, 3000), bool), np.zeros((40, 3000), bool)
    for cell, asked in hn.reached(nodes, x[:40], low, high, True):
        seen[np.ix_(asked, np.flatnonzero(leaf == cell))] = True
    for w in (0, 1):
        most |= (scores >= low[:, w : w + 1]) & (scores <= high[:, w : w + 1])
    assert not (most & ~seen).any() and seen.mean() < 0.8


@pytest.mark.parametrize("scale", [3.0e8, 1.5e5])
def test_scores_beyond_floating_point_stay_whole(spark, scale):
    rows = cluster_rows(120, 4, scale)
    assert mined(spark, rows, 10, SMALL_TREE) == plain_negatives(rows, 10)


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(OverflowError):
        mined(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40])])


def test_negatives_of_odd_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [3])]) == [] and mined(spark, [(1, 1, [3]), (2, 2, [3])]) == []
    rows = [(0, 1, [4, 4]), (1, 1, [4]), (2, 2, [2, 1, 9]), (3, 2, []), (4, 3, [2])]
    padded = [(i, l, (v + [0] * 3)[:3]) for i, l, v in rows]
    assert mined(spark, rows + rows) == plain_negatives(padded) != []


def test_usable_rows_leave_out_nulls_and_not_finite_numbers(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0], 1, "x"), (2, None, 1, None), (3, [1.0], None, "x"), (4, [1.0, None], 1, "x"), (5, [nan], 1, "x"), (6, [-inf], 1, "x"), (None, [1.0], 1, "x"), (7, [], 2, "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, ID string")
    assert sorted(r["id"] for r in hn.usable_rows(frame.drop("ID")).collect()) == [1, 7]
    assert hn.usable_rows(frame).columns == ["id", "label", "vector"]


def test_the_trees_index_every_row(spark):
    rows = cluster_rows()
    frame = spark.createDataFrame(rows, "id long, label long, vec array<long>")
    index = hn.build_index(frame, SMALL_TREE)
    assert index.rows.count() == 900 and 1 < index.cells.count() <= 12
    assert index.cells.agg(F.sum("shares")).first()[0] >= 900 // 64


# --- prefix tries


def plain_nodes(rows, base=lambda c: c - c % 5, taken=lambda c: zlib.crc32(str(c).encode()) % 9):
    """``rows``: (conv_id, turn, role, text) with turns that differ within a conversation."""
    turns = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((role or "", text or ""))
    rebuilt = {c: turns.get(base(c), [])[: taken(c)] + own[taken(c) :] for c, own in list(turns.items())}
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    leaf = {p for p in members} - {p[:-1] for p in members if p}
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(p)))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), sum(q in leaf for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


CHAT_SCHEMA = "conv_id long, turn long, role string, text string"


def trie(spark, rows, options=pt.TrieOptions()):
    own = pt.conversations(spark.createDataFrame(rows, CHAT_SCHEMA))
    whole = pt.join_prefix(own, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9, 8)
    return sorted((tuple(r) for r in pt.trie_nodes(pt.paths(whole), options).collect()), key=repr)


def chat_rows(n=120, seed=5):
    """A third of all conversations are equal, many more open alike; null turns, roles and texts."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        hot = rng.random()
        length = int(rng.integers(1, 14))
        for t in range(6 if hot < 0.33 else length):
            text = f"hot {t}" if hot < 0.33 or (hot < 0.6 and t < 4) else rng.choice(["é", "two words", "", "x" * 30, str(int(rng.integers(9)))])
            rows.append((c, None if t == 0 and c % 4 == 0 else t, None if rng.random() < 0.1 else ("user", "assistant")[t % 2], None if text == "" else str(text)))
    return rows


@pytest.mark.parametrize("options", [pt.TrieOptions(), pt.TrieOptions(shard_turns=40), pt.TrieOptions(shard_turns=1)])
def test_tries_equal_plain_prefixes(spark, options):
    rows = chat_rows()
    assert trie(spark, rows, options) == plain_nodes(rows)


def test_tries_of_odd_rows(spark):
    assert trie(spark, []) == []
    rows = [(7, 0, "user", "a"), (-3, 0, None, None), (-3, 1, "user", "ü"), (0, 5, "user", "z")]
    assert trie(spark, rows + [(None, 1, "user", "b")]) == plain_nodes(rows, lambda c: c - int(np.fmod(c, 5)))
    twice = trie(spark, [(5, 1, "user", "a"), (5, 1, "user", "a")])
    assert [r[:2] for r in twice] == [(5, 0), (5, 1), (5, 2)]


def test_one_long_conversation(spark):
    rows = [(0, t, "user", "same") for t in range(5_000)] + [(5, t, "user", "same") for t in range(4_000)]
    found = trie(spark, rows)
    assert len(found) == 5_001 and {r[3] for r in found} == {1, 2}
    assert max(r[6] for r in found) == 4_000 * 4 and all(r[5] == 1 for r in found)


def test_double_array_keeps_every_path_and_no_other():
    rng = np.random.default_rng(1)
    seqs = sorted({tuple(rng.integers(0, 30, rng.integers(0, 6)).tolist()) for _ in range(800)})
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    trie_ = pt.pack(np.array([c for s in seqs for c in s]), offsets)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    states = {(): 0}
    for p in sorted(prefixes, key=len)[1:]:
        states[p] = int(trie_.step(np.array([states[p[:-1]]]), np.array([p[-1]]))[0])
    assert min(states.values()) >= 0 and len(set(states.values())) == len(prefixes) == (trie_.check != -1).sum()
    for p, s in states.items():
        went = trie_.step(np.full(30, s), np.arange(30))
        assert {c for c in range(30) if went[c] >= 0} == {q[-1] for q in prefixes if q and q[:-1] == p}
    assert len(trie_.check) < 1.5 * len(prefixes)


# --- quality


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    return quality.QualityModel(rng.normal(0, 1, (256, 3)), rng.normal(0, 1, (6, 3, 4)), rng.normal(0, 0.5, 4), rng.normal(0, 1, 8), 0.3, 0.1, 16, 0.7)


def plain_logit(model, text):
    """Chunk by chunk, window by window."""
    data = (text or "").encode("utf-8")
    if not data:
        return model.bias
    vectors = np.concatenate([model.table[list(data)], np.repeat(model.table[:1], 64, axis=0)])
    chunks = []
    for first in range(0, -(-(len(data) + 6) // 16) * 16, 16):
        best = np.full(4, -1e30)
        for at in range(first, min(first + 16, len(data)), 2):
            best = np.maximum(best, np.einsum("ke,kef->f", vectors[at : at + 6], model.filters))
        chunks.append(np.maximum(best + model.biases, 0))
    return float(np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ model.output + model.bias)


def logits_of(model, texts):
    return quality.logits(model, model.pairs, *quality.utf8(quality.as_text(quality.pa.array(texts, quality.pa.string()))))


def test_logits_equal_plain_loops(monkeypatch):
    model = small_model()
    texts = [t if t is None else t[:3000] for t in ODD] + ["y" * n for n in range(9, 40)]
    want = [plain_logit(model, t) for t in texts]
    assert np.allclose(logits_of(model, texts), want, atol=1e-4)
    monkeypatch.setattr(quality, "_BYTES_AT_ONCE", 64)  # long texts in runs
    assert np.allclose(logits_of(model, texts), want, atol=1e-4)


def test_gradients_equal_differences():
    model, texts = small_model(1), [b"some bytes here", b"", "é and more of it, over two chunks".encode()]
    labels, weight = np.array([1.0, 0.0, 0.0]), np.array([0.2, 0.5, 0.3])

    def loss():
        out = np.array([plain_logit(model, t.decode()) for t in texts])
        return float((weight * (np.log1p(np.exp(out)) - labels * out)).sum()) + 0.5e-4 * float((model.output**2).sum())

    grads, rng = quality.gradients(model, texts, labels, weight), np.random.default_rng(2)
    for name in ("filters", "biases", "output", "table"):
        values = getattr(model, name)
        spots = [tuple(s) for s in np.argwhere(np.abs(grads[name]) > 1e-4)]
        for spot in [spots[i] for i in rng.permutation(len(spots))[:6]]:
            step = np.zeros_like(values)
            step[spot] = 1e-5
            setattr(model, name, values + step)
            up = loss()
            setattr(model, name, values - step)
            down = loss()
            setattr(model, name, values)
            assert abs((up - down) / 2e-5 - grads[name][spot]) < 2e-3 * max(1, abs(grads[name][spot]))


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op13_quality_classifier"](spark, folder).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([t == p for t, p in held]) > 0.93


def test_sample_is_bounded_and_defined(spark):
    docs = spark.createDataFrame([(i, "z" * (10_000 if i == 3 else 50)) for i in range(20)] + [(4, "other"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    options = quality.QualityOptions(sample_rows=12, sample_bytes=12 * 512)
    texts, found = quality.sample_labelled(docs, labels, options)
    again = quality.sample_labelled(docs.orderBy(F.desc("text")), labels, options)
    assert len(texts) == 12 and found.sum() == 6 and sum(map(len, texts)) <= options.sample_bytes
    assert [bytes(t) for t in texts] == [bytes(t) for t in again[0]] and (found == again[1]).all()


def test_quality_scores_cover_odd_rows_and_replace_clashing_columns(spark):
    frame = spark.createDataFrame(extra_rows(), EXTRA_SCHEMA)
    model = small_model()
    rows = quality.score(frame, model).collect()
    assert len(rows) == len(extra_rows()) and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.score(frame.limit(0), model).count() == 0
    for labels in ([], [0.0], [1.0, 1.0]):
        one = quality.fit([b"a"] * len(labels), np.array(labels), quality.QualityOptions())
        assert (one.probabilities(logits_of(one, ["a", None])) >= 0.7).all() == (labels != [0.0])
