"""Components and clusters against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import projection


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 30)) * [3.0] * 1
    x = np.where(rng.random((400, 30)) < 0.6, 0.0, base + rng.normal(size=(400, 30)))
    x[:, 7], x[:, 8] = 0.0, 5.0  # constant columns
    return x


def as_cells(spark, x):
    rows = [(i, [int(c) for c in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, indices array<int>, values array<double>").repartition(5, "id")


def test_scores_equal_exact_components(spark, matrix):
    cells = as_cells(spark, matrix)
    found, variances, mean, inverse = projection.principal_components(cells, 30, k=3, passes=25)
    got = np.array([list(r)[1:] for r in sorted(projection.project(cells, found, mean, inverse).collect())])
    live = matrix.std(axis=0) > 0
    z = np.where(live, (matrix - matrix.mean(axis=0)) / np.where(live, matrix.std(axis=0, ddof=1), 1), 0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    want = z @ vectors[:, ::-1][:, :3]
    assert np.allclose(variances, values[::-1][:3], rtol=1e-6)
    for k in range(3):
        assert np.allclose(got[:, k], want[:, k] * np.sign(got[:, k] @ want[:, k]), atol=1e-4)


def test_components_of_odd_tables(spark):
    cells = as_cells(spark, np.zeros((3, 4)))
    found, variances, mean, inverse = projection.principal_components(cells, 4, k=2)
    assert np.allclose(variances, 0) and projection.project(cells, found, mean, inverse).count() == 3
    assert projection.project(cells.limit(0), *[projection.principal_components(cells.limit(0), 4, k=2)[i] for i in (0, 2, 3)]).count() == 0


def plain_linkage(x, k):
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        pairs = [(max(np.linalg.norm(x[i] - x[j]) for i in a for j in b), p, q) for p, a in enumerate(clusters) for q, b in enumerate(clusters) if p < q]
        _, p, q = min(pairs)
        clusters[p] += clusters.pop(q)
    return {frozenset(c) for c in clusters}


def test_clusters_equal_complete_linkage_on_separated_groups(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [30, 0, 0], [0, 40, 0], [0, 0, 50], [0, 2, 55]], float)
    x = centres[rng.integers(0, 5, 120)] + rng.normal(0, 0.5, (120, 3))
    frame = spark.createDataFrame([(i, [float(v) for v in r], "kept") for i, r in enumerate(x)], "id long, x array<double>, note string").repartition(40)
    for most in (256, 20):
        rows = projection.cluster_by_linkage(frame, "x", 4, most).collect()
        got = {frozenset(r["id"] for r in rows if r["cluster"] == c) for c in {r["cluster"] for r in rows}}
        assert got == plain_linkage(x, 4) and len(rows) == 120
        sizes = [sum(r["cluster"] == c for r in rows) for c in range(4)]
        assert sizes == sorted(sizes, reverse=True)


def test_linkage_equals_plain_loops_and_odd_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    label = projection.complete_linkage(x, 6)
    assert {frozenset(np.flatnonzero(label == c)) for c in set(label)} == plain_linkage(x, 6)
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, x array<double>")
    assert {r["cluster"] for r in projection.cluster_by_linkage(frame, "x").collect()} == {0}
    assert projection.cluster_by_linkage(frame.limit(0), "x").count() == 0
    assert projection.summaries(frame.repartition(3), "x").agg(F.sum("n")).first()[0] == 9


def test_whole_rows_of_cells_with_nulls_and_without_cells(spark):
    rows = [(1, [0, 3], [2.0, None]), (2, [], []), (3, [2], [-1.5])]
    cells = spark.createDataFrame(rows, "id long, indices array<int>, values array<double>")
    got = {r["id"]: r["x"] for r in projection.full_rows(cells, 4).collect()}
    assert got == {1: [2.0, 0.0, 0.0, 0.0], 2: [0.0] * 4, 3: [0.0, 0.0, -1.5, 0.0]}
    assert projection.full_rows(cells.limit(0), 4).count() == 0


def plain_summaries(x, most):
    n, sums, width, todo = [], [], 0.0, [(1.0, r) for r in x]
    while todo:
        k, s = todo.pop(0)
        gaps = [float(np.sqrt(((b / a - s / k) ** 2).sum())) for a, b in zip(n, sums)]
        if gaps and min(gaps) <= width:
            at = gaps.index(min(gaps))
            n[at], sums[at] = n[at] + k, sums[at] + s
        else:
            n, sums = [*n, k], [*sums, s]
        if len(n) > most:
            centres = [b / a for a, b in zip(n, sums)]
            width = max(2 * width, min(float(np.sqrt(((p - q) ** 2).sum())) for i, p in enumerate(centres) for q in centres[:i]))
            todo, n, sums = [*zip(n, sums), *todo], [], []
    return n, sums, width


def test_summaries_equal_a_plain_loop():
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=(150, 3)) * 1e3, rng.integers(0, 3, (150, 2)).astype(float), np.repeat(rng.normal(size=(12, 4)), 9, axis=0)):
        own = projection._Leaves(10)
        for part in np.array_split(x, 4):
            own.add(np.ones(len(part)), part, (part * part).sum(axis=1))
        n, sums, width = plain_summaries(x, 10)
        assert np.array_equal(own.n, n) and np.allclose(own.sums, sums, rtol=1e-12) and own.width == width
        assert np.array_equal(own.centres, own.sums / own.n[:, None])  # kept, not divided anew for each row


def test_diagnoses_of_components_are_counted_where_they_lie(spark, monkeypatch):
    from wardline.catalog import modelling

    staged = []
    write = modelling.stage
    monkeypatch.setattr(modelling, "stage", lambda df, name, *more: staged.append(name) or write(df, name, *more))
    modelling.pca_project(spark, "/root/testdata/sf0.001")
    assert staged == ["cells"]
    cells = [modelling.feature_matrix(spark, "/root/testdata/sf0.001", in_files)[0].drop("n_null", "n_unknown") for in_files in (True, False)]
    assert sorted(map(str, cells[0].collect())) == sorted(map(str, cells[1].collect()))


def test_race_is_cleaned_step_by_step(spark):
    from wardline.catalog.prepared import race_bucket

    rows = [(None,), ("",), ("WHITE - BRAZILIAN",), ("black other",), ("PORTUGUESE",), ("Asian",), ("hispanic or white",)]
    found = race_bucket(spark.createDataFrame(rows, "race string"))
    unknown = "Unknown/Other"
    assert [r[0] for r in found.collect()] == [unknown, unknown, "White", unknown, unknown, "Asian", "White"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unable to obtain") == 1  # nested, the first step stood in the plan once for each of its uses
