"""Models on stay features, over all rows."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.catalog.prepared import CODE_LEVELS, RACE_LEVELS, grouped, race_bucket, stays
from wardline.catalog.registry import query, rounded
from wardline.catalog.views import with_views
from wardline.functions import clean
from wardline.operators import admissions as adm
from wardline.operators import codes, importance, models, preparation, projection, scaling, sequences
from wardline.plans.skew import find_heavy
from wardline.session import stage
from wardline.sources import tables

_MISSING = ["ER_LoS", "days_since_discharge"]
_NUMBERS = ["age", "admission_no", "cost", "language", *_MISSING]
_FEATURES = [*_NUMBERS, *[f"{c}_missing" for c in _MISSING]]


def _features(spark, d) -> tuple[DataFrame, DataFrame]:
    """Imputed stay features with ``is_train`` and the training part, staged once for all fits of a query."""
    rows = stays(spark, d).withColumn("language", clean.encode_language(F.col("language")))
    rows = race_bucket(rows).select("hadm_id", "subject_id", "hospital_expire_flag", "LoS", "race", *_NUMBERS)
    split = adm.stratified_split(adm.subject_labels(rows)).where("is_train")
    rows = stage(scaling.missing_flags(rows, _MISSING), "stays")
    train = stage(adm.rows_of_subjects(rows, split), "train")
    medians = scaling.learn_medians(train, _MISSING)
    return scaling.impute(train, medians), scaling.impute(rows, medians)


def _outcome_model(train):
    return models.fit_outcome_trees(
        models.add_class_weight(train, "hospital_expire_flag"), _FEATURES
    )


def _stay_model(train):
    return models.fit_stay_trees(train, _FEATURES)


@query("fit_mortality_gbt")
def fit_mortality_gbt(spark, d):
    train, rows = _features(spark, d)
    return models.score_batch(_outcome_model(train), rows).select("hadm_id", "hospital_expire_flag", "score", "pred")


@query("fit_los_gbt")
def fit_los_gbt(spark, d):
    train, rows = _features(spark, d)
    return models.score_batch(_stay_model(train), rows).select("hadm_id", "LoS", "pred")


@query("search_hyperparameters")
def search_hyperparameters(spark, d):
    """Ten settings, ten folds and the full ranges for both targets, over all labelled rows."""
    train, rows = _features(spark, d)

    def report(label: str, is_class: bool) -> DataFrame:
        fitted, settings = models.search_hyperparameters(train, _FEATURES, label, classification=is_class)
        return models.search_table(rows, fitted, settings).withColumn("target", F.lit(label))

    with ThreadPool(2) as pool:  # many small jobs each: one search fills the gaps of the other
        reports = pool.starmap(inheritable_thread_target(spark)(report), [("hospital_expire_flag", True), ("LoS", False)])
    return reports[0].unionByName(reports[1])


_RAW = ["age", "admission_no", "cost", *_MISSING]


def raw_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stays as they are, nulls and all, and the training part."""
    rows = stage(race_bucket(stays(spark, d)).select("hadm_id", "subject_id", "hospital_expire_flag", "LoS", "race", *_RAW), "raw")
    split = adm.stratified_split(adm.subject_labels(rows)).where("is_train")
    return stage(adm.rows_of_subjects(rows, split), "train"), rows


@query("score_batch")
def score_batch(spark, d):
    """Both targets predicted for raw rows with nulls; the preparation is part of the fitted pipelines."""
    train, rows = raw_rows(spark, d)
    weighted = models.add_class_weight(train, "hospital_expire_flag")
    outcome = preparation.fit_prepared(weighted, _RAW, ["race"], "hospital_expire_flag", True, optional=_MISSING, weight="weight")
    stay = preparation.fit_prepared(train, _RAW, ["race"], "LoS", False, optional=_MISSING)
    scored = preparation.score_raw(outcome, rows, threshold=0.2).withColumnRenamed("pred", "outcome_pred")
    return preparation.score_raw(stay, scored).select("hadm_id", "score", F.col("outcome_pred").alias("pred"), F.col("pred").alias("predicted_los"))


@query("early_stopping")
def early_stopping(spark, d):
    """Trees for both targets, kept up to the round after which whole held-out subjects gain no more."""
    train, rows = _features(spark, d)
    weighted = models.add_class_weight(models.validation_slice(train), "hospital_expire_flag")
    outcome, _ = models.fit_outcome_trees_early(weighted, _FEATURES)
    stay, _ = models.fit_stay_trees_early(weighted, _FEATURES)
    scored = models.score_batch(outcome, rows).select("hadm_id", *_FEATURES, "score")
    both = models.score_batch(stay, scored).select("hadm_id", "score", F.col("pred").alias("predicted_los"))
    kept = {f"{name}_trees": F.lit(m.stages[-1].getNumTrees) for name, m in (("outcome", outcome), ("stay", stay))}
    return both.withColumns(kept)


@query("fit_sequence_baseline")
def fit_sequence_baseline(spark, d):
    train, rows = _features(spark, d)
    lagged = ["LoS", "cost", "hospital_expire_flag"]
    features = [*_FEATURES, *[f"{c}_prev_{s}" for c in lagged for s in ("mean", "sum", "max")], *[f"{c}_decayed" for c in lagged]]

    # the training part holds whole subjects, so their histories are those of all rows: built once, and flagged before
    subjects = train.select("subject_id").distinct().withColumn("is_train", F.lit(True))
    flagged = adm.attach_split(rows, subjects)
    heavy = find_heavy(rows, ["subject_id"])
    history = sequences.decayed_history(sequences.lag_features(flagged, lagged, heavy), lagged, heavy=heavy)
    history = stage(history.na.fill(0.0, [c for c in features if c not in _FEATURES]), "history")
    weighted = models.add_class_weight(history.where("is_train"), "hospital_expire_flag")
    classifier, regressor = models.fit_sequence_baseline(weighted, features)
    scored = models.score_batch(classifier, history).select("hadm_id", *features, "score", "pred")
    return models.score_batch(regressor, scored.withColumnRenamed("pred", "outcome_pred")).select(
        "hadm_id", "score", "outcome_pred", F.col("pred").alias("predicted_los")
    )


@query("fit_text_classifier")
def fit_text_classifier(spark, d):
    """The outcome from each stay written as text, learned from training subjects and judged on all others."""
    train, rows = raw_rows(spark, d)
    columns = ["race", *_RAW]
    text = clean.row_to_text(columns, set(_RAW))
    model = models.fit_text_classifier(models.labelled(train, "hospital_expire_flag").select(text.alias("text"), F.col("hospital_expire_flag").alias("label")))
    held = adm.rows_without_subjects(rows, train.select("subject_id").distinct())
    judged = held.select("hadm_id", text.alias("text"), F.col("hospital_expire_flag").alias("label"))
    return models.score_batch(model, judged).select("hadm_id", "label", "score", "pred")


def feature_matrix(spark, d, in_files: bool = True) -> tuple[DataFrame, list[str]]:
    """Diagnosed admissions with code counts, race flags and numbers, and the names of those columns; no ids, no outcome.

    With ``in_files`` the coded diagnoses are written first, which fixes the layout of the rows. Without, they are counted
    where they lie, by admission, and need no shuffle for the two counts.
    """
    rows = race_bucket(stays(spark, d)).withColumn("language", clean.encode_language(F.col("language")))
    wide = adm.one_hot_encode(rows.select("hadm_id", "race", "LoS", "age", "admission_no", "cost", "language"), {"race": RACE_LEVELS})
    known = wide.where("age IS NOT NULL AND LoS IS NOT NULL AND cost IS NOT NULL")
    coded = grouped(spark, d).select("hadm_id", "ccs_code")
    counts = codes.count_vectors(stage(coded, "grouped") if in_files else coded, _code_index(spark))
    names = [c for c in known.columns if c != "hadm_id"]
    return projection.sparse_cells(counts.join(known, "hadm_id"), names, len(CODE_LEVELS)), [*CODE_LEVELS, *names]


def _code_index(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CODE_LEVELS)], "ccs_code string, ccs_index long")


@query("pca_project")
def pca_project(spark, d):
    """Scores of the feature matrix on its first two components, columns centred and scaled."""
    cells, names = feature_matrix(spark, d, in_files=False)  # sums over rows: any layout gives the same
    cells = stage(cells.select("hadm_id", "indices", "values"), "cells")
    found, _, mean, inverse = projection.principal_components(cells, len(names), k=2)
    return projection.project(cells, found, mean, inverse)


@query("cluster_k4")
def cluster_k4(spark, d):
    """Four clusters of the feature matrix, unscaled, by complete linkage over summaries of all rows."""
    cells, names = feature_matrix(spark, d)
    rows = stage(projection.full_rows(cells.select("hadm_id", "indices", "values"), len(names)), "matrix")
    return projection.cluster_by_linkage(rows, "x").select("hadm_id", "cluster")


@query("importance_split_count")
def importance_split_count(spark, d):
    train, rows = _features(spark, d)
    return models.split_counts(rows, _outcome_model(train))


@query("topk_importance")
def topk_importance(spark, d):
    train, rows = _features(spark, d)
    return models.top_importance(models.split_counts(rows, _outcome_model(train)), k=15)


@query("permutation_importance_auc")
def permutation_importance_auc(spark, d):
    train, rows = _features(spark, d)
    return importance.importance_by_auc(_outcome_model(train), rows, "hadm_id", _FEATURES)


@query("permutation_importance_rmse")
def permutation_importance_rmse(spark, d):
    train, rows = _features(spark, d)
    return importance.importance_by_rmse(_stay_model(train), rows, "hadm_id", _FEATURES)


# A known linear score of three features, so that the importances can be checked: weights, then the permutation in SQL.
_LINEAR = {"age": 0.02, "cost": 0.00001, "admission_no": 0.3}
_REPEATS = 2
_NETWORK = (
    "-(list_reduce([i] || range(4 * walks), lambda s, j: CASE WHEN s < 0 THEN s WHEN j % 4 = 3 AND {0} < n THEN -{0} - 1 ELSE {0} END)) - 1"
).replace(
    "{0}",
    "(CASE WHEN j % 2 = 0 THEN ((s // b + {1}(s % b AS VARCHAR)), 1, 8) AS BIGINT)) % a) * b + s % b"
    " ELSE (s // b) * b + (s % b + {1}(s // b AS VARCHAR)), 1, 8) AS BIGINT)) % b END)",
).replace("{1}", "CAST('0x' || substr(md5('67-' || rep || '-' || CAST(j % 4 AS VARCHAR) || '-' || CAST")
_LINEAR_SUM = " + ".join(f"{{{i}}} * CAST({w!r} AS DOUBLE)" for i, w in enumerate(_LINEAR.values()))


def _linear_sql(measure: str, base: str, outer: str) -> str:
    """Rows numbered by admission, partners by the network, one variant of the rows per feature and repeat."""
    own = [f"x.f{i}" for i in range(len(_LINEAR))]
    variants = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, p.rep, x.y, {_LINEAR_SUM.format(*[f'z.f{k}' if k == i else own[k] for k in range(len(own))])} AS score"
        " FROM p JOIN r x ON x.i = p.i JOIN r z ON z.i = p.lender"
        for i, name in enumerate(_LINEAR)
    )
    columns = ", ".join(f'CAST(coalesce("{c}", 0) AS DOUBLE) AS f{i}' for i, c in enumerate(_LINEAR))
    return (
        f'r AS (SELECT row_number() OVER (ORDER BY hadm_id) - 1 AS i, "{outer}" AS y, {columns} FROM stays_v WHERE "{outer}" IS NOT NULL),'
        " shape AS (SELECT n, a, b, least(a * b - n + 1, 64) AS walks FROM (SELECT n, a, (n + a - 1) // a AS b FROM"
        " (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM r)))),"
        f" p AS (SELECT i, rep, {_NETWORK} AS lender FROM r, shape, (SELECT CAST(unnest(range(1, {_REPEATS + 1})) AS VARCHAR) AS rep)),"
        f" v AS ({variants}), own AS (SELECT '' AS feature, '' AS rep, x.y, {_LINEAR_SUM.format(*own)} AS score FROM r x),"
        f" m AS (SELECT feature, rep, {measure} FROM (SELECT * FROM v UNION ALL SELECT * FROM own) GROUP BY feature, rep)"
        f" SELECT k.feature, round(avg({base}), 6) AS importance FROM m k, (SELECT m AS o FROM m WHERE feature = '') WHERE k.feature <> '' GROUP BY k.feature"
    )


_RANKED = (
    "m0 AS (SELECT feature, rep, y, rank() OVER w + (count(*) OVER (PARTITION BY feature, rep, score) - 1) / 2.0 AS r"
    " FROM (SELECT * FROM v UNION ALL SELECT * FROM own) WINDOW w AS (PARTITION BY feature, rep ORDER BY score)),"
    " m AS (SELECT feature, rep, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS m FROM m0 GROUP BY feature, rep)"
)


def _linear_rows(spark, d, label):
    rows = stays(spark, d).where(F.col(label).isNotNull())
    return rows.select("hadm_id", label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _LINEAR])


def _auc_linear_sql() -> str:
    text = _linear_sql("0 AS m", "k.o - k.m", "hospital_expire_flag")
    head, tail = text.split(" m AS (", 1)
    return head + " " + _RANKED + " SELECT" + tail.split(" SELECT k.feature", 1)[1].join([" k.feature", ""]).replace("k.o", "o")


@query("permutation_importance_linear_auc", with_views("stays_v").rstrip() + ", " + _auc_linear_sql())
def permutation_importance_linear_auc(spark, d):
    """Drops of the AUC of a known linear score."""
    rows = _linear_rows(spark, d, "hospital_expire_flag")
    drops = importance.auc_drops(importance.linear_scorer(list(_LINEAR.values())), rows, "hadm_id", list(_LINEAR), "hospital_expire_flag", _REPEATS, batch=2)
    return rounded(drops.withColumnRenamed("importance_auc_drop", "importance"), "importance")


@query("permutation_importance_linear_rmse", with_views("stays_v").rstrip() + ", " + _linear_sql("sqrt(avg((y - score) * (y - score))) AS m", "k.m - o", "LoS"))
def permutation_importance_linear_rmse(spark, d):
    """Increases of the error of a known linear score."""
    rows = _linear_rows(spark, d, "LoS")
    rises = importance.rmse_increases(importance.linear_scorer(list(_LINEAR.values())), rows, "hadm_id", list(_LINEAR), "LoS", _REPEATS, batch=2)
    return rounded(rises.withColumnRenamed("importance_rmse_increase", "importance"), "importance")
