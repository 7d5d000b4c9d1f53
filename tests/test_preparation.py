"""Saved preparation: raw rows with nulls and unseen values, and encodings that see no own target."""

from __future__ import annotations

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wardline.operators import models, preparation, scaling
from wardline.session import new_path

SCHEMA = "subject_id long, a double, b double, `odd name` double, empty double, race string, y double, flag int"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (i // 3, None if i % 5 == 0 else float(i % 17), None if i % 3 else float(i), float(i % 4), None, None if i % 11 == 0 else f"r{i % 4}", float(i % 17) * 2 + i % 4, int(i % 17 > 8))
        for i in range(300)
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()


NUMBERS = ["a", "b", "odd name", "empty"]


def scored(df):
    return sorted((r["subject_id"], str(r["a"]), r["y"], r["pred"]) for r in df.collect())


@pytest.mark.parametrize("label, is_class", [("y", False), ("flag", True)])
def test_a_saved_pipeline_scores_raw_rows(spark, raw, label, is_class):
    model = preparation.fit_prepared(raw, NUMBERS, ["race"], label, is_class, optional=["a", "b"], maxIter=3, maxDepth=3)
    path = new_path(spark, "prepared")
    models.save_model(model, path)
    loaded = models.load_model(path)
    assert isinstance(loaded, PipelineModel)
    fresh = raw.unionByName(spark.createDataFrame([(999, None, None, None, None, "never seen", 0.0, 0), (998, None, None, None, 7.0, None, 0.0, 1)], SCHEMA))
    assert scored(preparation.score_raw(loaded, fresh)) == scored(preparation.score_raw(model, fresh))
    out = preparation.score_raw(loaded, fresh)
    assert out.count() == 302 and out.columns[:8] == fresh.columns and out.where("pred IS NULL").count() == 0
    assert preparation.score_raw(loaded, fresh.limit(0)).count() == 0


def test_learned_values(spark, raw):
    model = preparation.fit_prepared(raw, NUMBERS, ["race"], "y", False, maxIter=1, maxDepth=1)
    medians, means, scale = model.stages[0], model.stages[1], model.stages[2]
    exact = raw.agg(*[F.median(f"`{c}`").alias(c) for c in NUMBERS]).first()
    assert medians.getOrDefault("medians") == [exact["a"], exact["b"], exact["odd name"], 0.0] and medians.getOrDefault("empty") == ["empty"]
    assert means.getOrDefault("levels") == ["r0", "r1", "r2", "r3"] and means.getOrDefault("of_null") != means.getOrDefault("prior")
    filled = means.transform(medians.transform(raw))
    ready = scale.transform(filled)
    row = ready.agg(F.avg("a_filled_scaled"), F.stddev_pop("a_filled_scaled")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)


def test_too_many_values_are_refused_not_cut(spark):
    wide = spark.range(10_050).select(F.col("id").cast("string").alias("c"), F.lit(1.0).alias("y"))
    with pytest.raises(ValueError, match="more than"):
        preparation.TargetMeans(columns=["c"], ending="_m", label="y").fit(wide)


def weigh(n, s, prior):
    own = 1 / (1 + math.exp(-(n - 20) / 10))
    return prior * (1 - own) + s / n * own if n else prior


def test_cross_fitted_encoding_equals_plain_loops(raw):
    got = scaling.target_encode_cross_fitted(raw, "race", "y", folds=4)
    rows = [r.asDict() for r in got.withColumn("fold", scaling.fold_of("subject_id", 4)).collect()]
    assert len(rows) == 300 and len({r["fold"] for r in rows}) == 4
    for r in rows:
        others = [o for o in rows if o["fold"] != r["fold"]]
        own = [o["y"] for o in others if o["race"] == r["race"]]
        assert r["race_encoded"] == pytest.approx(weigh(len(own), sum(own), sum(o["y"] for o in others) / len(others)))


def test_cross_fitted_encoding_of_odd_rows(spark):
    rows = [(1, "a", 1.0), (1, "a", None), (2, None, 3.0), (None, "b", 5.0)]
    frame = spark.createDataFrame(rows, "subject_id long, race string, y double")
    got = scaling.target_encode_cross_fitted(frame, "race", "y", folds=50).collect()
    by_race = {(r["race"], r["y"]): r["race_encoded"] for r in got}
    assert by_race[("a", 1.0)] == by_race[("a", None)] == pytest.approx(4.0) and by_race[(None, 3.0)] == pytest.approx(3.0)
    assert scaling.target_encode_cross_fitted(frame.limit(0), "race", "y").count() == 0
