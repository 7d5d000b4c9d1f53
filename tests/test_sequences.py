"""Recurrences along long groups, batches of like length, the heat map's row order, the mark for missing values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import projection, sequences
from wardline.operators import tests_of_difference as diff
from wardline.plans import skew
from wardline.plans.recurrence import affine_before
from wardline.session import new_path
from wardline.sources import csv


def history_rows():
    """One subject owns most rows; nulls, and a null subject."""
    rows = [(1, i, i + 1, None if i % 13 == 0 else float(i % 7), float(i % 3)) for i in range(700)]
    return rows + [(2, 1000, 1, 5.0, 1.0), (3, 1001, 1, 2.0, None), (3, 1002, 2, 4.0, 1.0), (None, 1003, 1, 9.0, 0.0)]


@pytest.mark.parametrize("run", [3, 50, 1000])
@pytest.mark.parametrize("limit", ["40", "1000000"])
def test_decayed_history_equals_a_loop(spark, run, limit):
    df = spark.createDataFrame(history_rows(), "subject_id long, hadm_id long, admission_no long, `a b` double, v double")
    spark.conf.set(skew.MIN_ROWS, limit)
    try:
        got = {r["hadm_id"]: (r["a b_decayed"], r["v_decayed"]) for r in sequences.decayed_history(df, ["a b", "v"], 0.9, run=run).collect()}
    finally:
        spark.conf.unset(skew.MIN_ROWS)
    want, state = {}, {}
    for s, hadm, _, a, v in history_rows():
        h = state.get(s, (0.0, 0.0))
        want[hadm] = h
        state[s] = (0.9 * h[0] + (a or 0.0), 0.9 * h[1] + (v or 0.0))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_recurrence_with_own_factors_and_no_rows(spark):
    rows = [("k", i, 0.5 if i % 2 else 2.0, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, p long, a double, c array<double>")
    got = {r["p"]: list(r["h"]) for r in affine_before(df, ["k"], "p", "a", "c", "h", run=4).collect()}
    h = np.zeros(2)
    for _, p, a, c in rows:
        assert got[p] == pytest.approx(list(h))
        h = h * a + c
    assert affine_before(df.limit(0), ["k"], "p", "a", "c", "h").count() == 0


def test_batches_hold_sequences_of_like_length(spark):
    rows = [(s, s * 100 + i, i + 1, float(i), 1) for s in range(50) for i in range(1 + (s * 7) % 23)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, admission_no long, v double, y int")
    built = sequences.build_sequences(df, ["v"], "y", segment_size=10)
    batches = sequences.padded_batches(built, 1, batch_rows=8)
    found = batches.select("batch", "batch_length", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.filter("mask", lambda t: t)).alias("real")).collect()
    lengths = sorted(r["real"] for r in found)
    assert sum(lengths) == len(rows) and all(r["n"] == r["m"] == r["batch_length"] for r in found)
    for b in range(max(r["batch"] for r in found) + 1):
        own = sorted(r["real"] for r in found if r["batch"] == b)
        assert own == lengths[8 * b : 8 * b + 8] and {r["batch_length"] for r in found if r["batch"] == b} == {max(own)}
    assert sum(r["n"] for r in found) < 10 * len(found)
    real = {(r["subject_id"], r["pos"]): r["x"][0] for r in sequences.mask_padding(batches.drop("batch", "batch_length", "length")).collect()}
    assert len(real) == len(rows) and all(v == p for (_, p), v in real.items())
    assert sequences.padded_batches(built.limit(0), 1).count() == 0


def test_heat_map_rows_follow_the_linkage(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.7, (12, 40))
    x[5] = x[2]
    cells = spark.createDataFrame([(j, f"c{i:02d}", int(x[i, j])) for i in range(12) for j in range(40)], "hadm_id long, ccs_code string, n long")
    got = [r["ccs_code"] for r in diff.heatmap_row_order(cells).orderBy("position").collect()]
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2).astype(float))
    clusters = [[i] for i in range(12)]
    while len(clusters) > 1:
        _, p, q = min((max(gaps[i, j] for i in a for j in b), p, q) for p, a in enumerate(clusters) for q, b in enumerate(clusters) if p < q)
        clusters[p] += clusters.pop(q)
    assert sorted(got) == sorted(f"c{i:02d}" for i in range(12))
    assert abs(got.index("c02") - got.index("c05")) == 1
    assert projection.linkage_order(gaps) == [int(c[1:]) for c in got] and set(clusters[0]) == set(range(12))


def test_a_text_like_the_mark_is_refused(spark):
    df = spark.createDataFrame([(1, "NA"), (2, None)], "a long, b string")
    with pytest.raises(Exception, match="mark for missing"):
        csv.sink_csv(df, new_path(spark, "refused"))
    path = new_path(spark, "other")
    csv.sink_csv(df, path, missing="\\N")
    assert sorted(map(tuple, csv.scan_csv(spark, path, df.schema, missing="\\N").collect())) == [(1, "NA"), (2, None)]
