"""Properties of the fitted models, the search and the importances."""

from __future__ import annotations

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from wardline.catalog.modelling import _FEATURES, _features, _outcome_model, _stay_model
from wardline.operators import importance, models
from wardline.operators.metrics import roc_auc
from wardline.session import new_path
from wardline.sources import tables


@pytest.fixture(scope="module")
def data(spark):
    train, rows = _features(spark, "/root/testdata/sf0.001")
    return train.cache(), rows.cache()


@pytest.fixture(scope="module")
def outcome(data):
    return _outcome_model(data[0])


def scores(df):
    return {r["hadm_id"]: r["score"] for r in df.collect()}


def test_features_have_no_nulls(data):
    rows = data[1]
    assert rows.where(" OR ".join(f"{c} IS NULL" for c in _FEATURES)).count() == 0
    assert data[0].count() < rows.count()


def test_probabilities_and_labels(data, outcome):
    out = models.score_batch(outcome, data[1], threshold=0.3)
    row = out.agg(F.min("score"), F.max("score"), F.max(F.abs((F.col("score") >= 0.3).cast("int") - F.col("pred")))).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] == 0
    assert out.count() == data[1].count() and "LoS" in out.columns


def test_same_seed_same_scores(data, outcome):
    again = _outcome_model(data[0])
    assert scores(models.score_batch(again, data[1])) == scores(models.score_batch(outcome, data[1]))


def test_saved_model_scores_alike(spark, data, outcome):
    path = new_path(spark, "model")
    models.save_model(outcome, path)
    loaded = models.load_model(path)
    assert loaded.stages[0].getInputCols() == _FEATURES
    assert scores(models.score_batch(loaded, data[1])) == scores(models.score_batch(outcome, data[1]))


def test_split_counts_are_the_internal_nodes(data, outcome):
    counted = models.split_counts(data[1], outcome)
    internal = sum((t.numNodes - 1) // 2 for t in outcome.stages[-1].trees)
    assert counted.agg(F.sum("importance")).first()[0] == internal
    assert {r["feature"] for r in counted.collect()} <= set(_FEATURES)


def test_partners_are_a_permutation(data):
    rows = data[1].select("hadm_id", "LoS", "age", "cost")
    paired = importance.with_partners(rows, "hadm_id", "LoS", ["hadm_id", "cost"], repeats=3)
    n = rows.count()
    got = paired.groupBy("repeat").agg(
        F.count_distinct(F.col("z")[0]).alias("lenders"), F.count("*").alias("n"), F.count_if(F.col("z")[0] == F.col("hadm_id")).alias("own")
    ).collect()
    assert [(r["lenders"], r["n"]) for r in got] == [(n, n)] * 3 and all(r["own"] < 10 for r in got)
    assert paired.groupBy("hadm_id").agg(F.count_distinct(F.col("z")[0]).alias("k")).agg(F.avg("k")).first()[0] > 2.9


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_network_is_a_bijection_at_every_size(spark, rows):
    left, right, walks = importance.network_shape(rows)
    assert left * right >= rows and walks >= 1
    out = spark.range(rows).select("id", importance.permuted(F.col("id"), rows, F.lit("k")).alias("to")).collect()
    assert sorted(r["to"] for r in out) == list(range(rows))
    if rows > 50:
        other = spark.range(rows).select(importance.permuted(F.col("id"), rows, F.lit("l")).alias("to")).collect()
        assert sum(a["to"] == b["to"] for a, b in zip(out, other)) < rows / 5 and sum(r["to"] == r["id"] for r in out) < rows / 5


def test_unused_feature_has_no_importance(data):
    rows = data[1].withColumns({"flat": F.lit(1.0), "useful": F.col("LoS") * 2})
    model = models.fit_stay_trees(rows, ["useful", "flat"], maxIter=2, maxDepth=3)
    got = importance.importance_by_rmse(model, rows, "hadm_id", ["useful", "flat"], repeats=2)
    by_name = {r["feature"]: r["importance_rmse_increase"] for r in got.collect()}
    assert by_name["flat"] == pytest.approx(0, abs=1e-9) and by_name["useful"] > 1
    labelled = rows.withColumn("useful", F.col("hospital_expire_flag") * 1.0)
    weighted = models.add_class_weight(labelled, "hospital_expire_flag")
    model = models.fit_outcome_trees(weighted, ["useful", "flat"], maxIter=2, maxDepth=2)
    got = importance.importance_by_auc(model, labelled, "hadm_id", ["useful", "flat"])
    by_name = {r["feature"]: r["importance_auc_drop"] for r in got.collect()}
    assert by_name["flat"] == 0 and by_name["useful"] > 0.3


def test_class_weight(data):
    weighted = models.add_class_weight(data[0], "hospital_expire_flag", factor=0.5)
    sums = {r["hospital_expire_flag"]: r["w"] for r in weighted.groupBy("hospital_expire_flag").agg(F.sum("weight").alias("w")).collect()}
    assert sums[1] == pytest.approx(sums[0] / 2)


def test_search_reports_every_setting(data):
    train, rows = data
    small = {**models.SEARCH_RANGES, "maxDepth": (2, 3)}
    fitted, settings = models.search_hyperparameters(
        train, _FEATURES, "hospital_expire_flag", settings=2, folds=2, ranges=small, maxIter=2
    )
    table = models.search_table(rows, fitted, settings).collect()
    assert len(table) == 2 and all(0 <= r["score"] <= 1 for r in table)
    assert all(0.001 <= s["stepSize"] <= 1 and 2 <= s["maxDepth"] <= 3 for s in settings)
    assert all(0.5 <= float(s["featureSubsetStrategy"]) <= 1 for s in settings)


def test_search_reads_every_labelled_row(spark, monkeypatch):
    """A hundred thousand rows were the most that the fits read; whole subjects beyond them were left out."""
    n, read, write = 120_000, [], models.stage
    monkeypatch.setattr(models, "stage", lambda df, name: read.append(write(df, name)) or read[-1])
    rows = spark.range(n).selectExpr("id AS subject_id", "CAST(id % 7 AS DOUBLE) AS x", "IF(id % 100 = 0, NULL, id % 3) AS y")
    models.search_hyperparameters(rows, ["x"], "y", False, settings=1, folds=2, ranges={"maxDepth": (2, 2)}, maxIter=1)
    assert [df.select("subject_id").distinct().count() for df in read] == [n - n // 100]


def search_rows(spark, n=600):
    return spark.range(n).selectExpr("id AS subject_id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS z", "CAST((id % 7) * (id % 5) AS DOUBLE) AS y", "CAST(id % 3 = 0 AS INT) AS flag")


def test_fits_of_all_folds_share_one_pool(spark, monkeypatch):
    """Settings of one fold ran at a time: with one setting there never were two fits at once."""
    running, most, lock, fit = [0], [0], threading.Lock(), models.GBTRegressor._fit

    def counted(self, dataset):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit(self, dataset)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models.GBTRegressor, "_fit", counted)
    models.search_hyperparameters(search_rows(spark), ["x", "z"], "y", False, settings=1, folds=3, parallelism=3, ranges={"maxDepth": (2, 2)}, maxIter=2)
    assert most[0] > 1


@pytest.mark.parametrize(("label", "is_class"), [("y", False), ("flag", True)])
def test_search_scores_are_those_of_the_cross_validator(spark, monkeypatch, label, is_class):
    given, validate = [], models.cross_validate
    monkeypatch.setattr(models, "cross_validate", lambda search, folded: given.append((search, folded)) or validate(search, folded))
    found, _ = models.search_hyperparameters(search_rows(spark), ["x", "z"], label, is_class, settings=2, folds=3, maxIter=2)
    search, folded = given[0]
    expected = search.fit(folded)
    assert found.avgMetrics == expected.avgMetrics and found.stdMetrics == expected.stdMetrics
    assert found.bestModel.stages[-1].toDebugString.split("\n", 1)[1] == expected.bestModel.stages[-1].toDebugString.split("\n", 1)[1]


def test_an_empty_fold_is_refused(spark):
    with pytest.raises(ValueError, match="is empty"):
        models.search_hyperparameters(search_rows(spark, 2), ["x", "z"], "y", False, settings=1, folds=3, maxIter=1)


def test_validation_is_by_subject(data):
    marked = models.validation_slice(data[0])
    mixed = marked.groupBy("subject_id").agg(F.count_distinct("is_validation").alias("k")).where("k > 1").count()
    share = marked.agg(F.avg(F.col("is_validation").cast("int"))).first()[0]
    assert mixed == 0 and 0.05 < share < 0.4


def test_early_stopping_keeps_fewer_trees(data):
    marked = models.add_class_weight(models.validation_slice(data[0]), "hospital_expire_flag")
    model = models.fit_outcome_trees(marked, _FEATURES, validation="is_validation", maxIter=12, maxDepth=3, validationTol=0.2)
    assert model.stages[-1].getNumTrees < 12


def test_components_are_ordered(spark, folder):
    vectors = models.as_vector(tables.table(spark, folder, "embeddings"), "embedding")
    scored, model = models.pca_project(vectors, k=3)
    explained = list(model.stages[-1].explainedVariance)
    assert explained == sorted(explained, reverse=True)
    row = scored.agg(*[F.var_samp(f"PC{i}") for i in (1, 2, 3)]).first()
    assert row[0] >= row[1] >= row[2] > 0


def test_four_clusters(data):
    rows = models.assemble([*_FEATURES, "LoS"]).transform(data[1])
    assert models.cluster(rows).select("cluster").distinct().count() == 4


def test_text_model_separates(spark):
    df = spark.createDataFrame([("sky blue", 0), ("blue sea", 0), ("red fire", 1), ("fire ant red", 1)] * 5, "text string, label int")
    out = models.score_batch(models.fit_text_classifier(df, buckets=256), df)
    assert roc_auc(out, "label").first()["auc"] == 1.0


def test_stay_model_beats_the_mean_on_training_rows(data):
    train = data[0]
    out = models.score_batch(_stay_model(train), train)
    row = out.agg(F.avg((F.col("LoS") - F.col("pred")) ** 2), F.var_pop("LoS")).first()
    assert row[0] < row[1]


def test_patience_waits_four_rounds_and_stops_after_five():
    dip = [5.0, 4.0, 4.5, 4.6, 4.7, 4.8, 3.0, 2.9]
    assert models.best_round(dip, patience=5) == 8
    assert models.best_round([5.0, 4.0, 4.5, 4.6, 4.7, 4.8, 4.9, 3.0], patience=5) == 2
    assert models.best_round([1.0]) == 1


def test_early_stopping_keeps_the_best_round(data):
    weighted = models.add_class_weight(models.validation_slice(data[0]), "hospital_expire_flag")
    model, losses = models.fit_outcome_trees_early(weighted, _FEATURES, rounds=8, patience=2, maxDepth=3)
    assert len(losses) == 8 and model.stages[-1].getNumTrees == models.best_round(losses, 2)


def test_the_cohort_leads_to_subgroups_with_orphans_present(spark, folder):
    from wardline.catalog import QUERIES

    rows = QUERIES["cohort_subgroups"](spark, folder).collect()
    assert rows and all(r["race"].startswith("race_") and r["n_patients"] > 0 for r in rows)


@pytest.mark.parametrize("rows", [2, 7, 50])
def test_permutation_is_the_network_walked_until_in_range(spark, rows):
    left, right, walks = importance.network_shape(rows)

    def walked(number):
        for step in range(walks * importance.ROUNDS):
            a, b = divmod(number, right)
            noise = int(hashlib.md5(f"k-{step % 4}-{a if step % 2 else b}".encode()).hexdigest()[:8], 16)
            a, b = (a, (b + noise) % right) if step % 2 else ((a + noise) % left, b)
            number = a * right + b
            if step % 4 == 3 and number < rows:
                return number

    found = spark.range(rows).select("id", importance.permuted(F.col("id"), rows, F.lit("k")).alias("to"))
    assert {r["id"]: r["to"] for r in found.collect()} == {i: walked(i) for i in range(rows)}


def test_partners_are_drawn_once_for_each_row(spark):
    """A join on a key that may be null tests it first, which would walk the network a second time."""
    drawn = spark.range(50).withColumn("to", importance.partner(F.col("id"), 50, F.lit("k")))
    assert not drawn.schema["to"].nullable


def test_sequence_histories_are_built_once(spark, monkeypatch):
    from wardline.catalog import modelling

    built, fitted = [], []
    decayed, fit = modelling.sequences.decayed_history, models.fit_sequence_baseline
    monkeypatch.setattr(modelling.sequences, "decayed_history", lambda df, *a, **k: built.append(df) or decayed(df, *a, **k))
    monkeypatch.setattr(models, "fit_sequence_baseline", lambda train, features: fitted.append((train, features)) or fit(train, features))
    out = modelling.fit_sequence_baseline(spark, "/root/testdata/sf0.001")
    train, rows = _features(spark, "/root/testdata/sf0.001")
    assert len(built) == 1 and out.count() == rows.count()
    # the training rows have the histories that they have on their own
    (used, features), lagged = fitted[0], ["LoS", "cost", "hospital_expire_flag"]
    own = decayed(modelling.sequences.lag_features(train, lagged), lagged).na.fill(0.0, features)
    as_rows = lambda df: sorted(tuple(r) for r in df.select("hadm_id", *features).collect())
    assert as_rows(used) == as_rows(own)
