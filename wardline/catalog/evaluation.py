"""Measures of scored and predicted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import query, rounded
from wardline.catalog.views import with_views
from wardline.functions.scores import threshold_label
from wardline.operators import metrics
from wardline.sources import tables

_RATES = ("precision", "recall", "f1")


def _labelled(spark, d):
    return tables.scored(spark, d).withColumn("pred", threshold_label(F.col("score"), 0.5))


_LABELLED_SQL = "SELECT *, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM scored_v"
_COUNTS = (
    "count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,"
    " count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn"
)
_RATES_SQL = (
    "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)"
    " AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
)


def _auc_sql(group: str = "") -> str:
    """Rank-sum form: average ranks of the positives, ties sharing their mean rank."""
    part = f"PARTITION BY {group} " if group else ""
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return (
        f"SELECT {head}(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)"
        f" / nullif(sum(y) * sum(1 - y), 0) AS auc FROM (SELECT *, rank() OVER ({part}ORDER BY score)"
        f" + (count(*) OVER (PARTITION BY {head}score) - 1) / 2.0 AS r FROM scored_v){tail}"
    )


@query("metric_roc_auc", with_views("scored_v") + f"SELECT round(auc, 6) AS auc FROM ({_auc_sql()})")
def metric_roc_auc(spark, d):
    return rounded(metrics.roc_auc(tables.scored(spark, d)), "auc")


@query(
    "metric_confusion_matrix",
    with_views("scored_v")
    + "SELECT t AS true_label, p AS predicted_label, count(y) AS n FROM (SELECT * FROM (VALUES (0), (1)) a(t),"
    f" (VALUES (0), (1)) b(p)) LEFT JOIN ({_LABELLED_SQL}) ON y = t AND pred = p GROUP BY t, p",
)
def metric_confusion_matrix(spark, d):
    return metrics.confusion_matrix(_labelled(spark, d))


@query(
    "metric_precision_recall_f1",
    with_views("scored_v") + f"SELECT {_RATES_SQL} FROM (SELECT {_COUNTS} FROM ({_LABELLED_SQL}))",
)
def metric_precision_recall_f1(spark, d):
    return rounded(metrics.precision_recall_f1(_labelled(spark, d)), *_RATES)


@query(
    "metric_accuracy",
    with_views("scored_v")
    + f"SELECT round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 6) AS accuracy FROM ({_LABELLED_SQL})",
)
def metric_accuracy(spark, d):
    return rounded(metrics.accuracy(_labelled(spark, d)), "accuracy")


@query(
    "metric_sensitivity_specificity",
    with_views("scored_v")
    + "SELECT round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity"
    f" FROM (SELECT {_COUNTS} FROM ({_LABELLED_SQL}))",
)
def metric_sensitivity_specificity(spark, d):
    return rounded(metrics.sensitivity_specificity(_labelled(spark, d)), "sensitivity", "specificity")


_REGRESSION_SQL = (
    "round(avg((y - pred) * (y - pred)), 2) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,"
    " round(avg(abs(y - pred)), 6) AS mae,"
    " round(1 - avg((y - pred) * (y - pred)) / nullif(var_pop(y), 0), 6) AS r2"
)


def _rounded_regression(df):
    return rounded(rounded(df, "rmse", "mae", "r2"), "mse", digits=2)


@query("metric_regression", with_views("predicted_v") + f"SELECT {_REGRESSION_SQL} FROM predicted_v")
def metric_regression(spark, d):
    return _rounded_regression(metrics.regression_measures(tables.predicted(spark, d)))


def _sweep_sql(grid: str) -> str:
    return (
        "SELECT threshold, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,"
        " coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
        " FROM (SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp,"
        " count(*) FILTER (y = 0 AND score >= threshold) AS fp,"
        " count(*) FILTER (y = 1 AND score < threshold) AS fn,"
        f" count(*) FILTER (y = 0 AND score < threshold) AS tn FROM scored_v, ({grid}) GROUP BY threshold)"
    )


@query(
    "threshold_sweep",
    with_views("scored_v")
    + "SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1, 6) AS f1 FROM ("
    + _sweep_sql("SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(10, 50, 5) s(i)")
    + ")",
)
def threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(tables.scored(spark, d)), *_RATES)


@query(
    "threshold_best_f1",
    with_views("scored_v")
    + "SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1, 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,"
    " round(tn / nullif(tn + fp, 0), 6) AS specificity FROM ("
    + _sweep_sql("SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(20, 81) s(i)")
    + ") ORDER BY f1 DESC, threshold LIMIT 1",
)
def threshold_best_f1(spark, d):
    best = metrics.best_f1(tables.scored(spark, d), steps=tuple(range(20, 81)), unit=100.0)
    return rounded(best, *_RATES, "sensitivity", "specificity")


@query(
    "threshold_best_f1_fine",
    with_views("scored_v")
    + "SELECT threshold, tp, fp, fn, tn, round(f1, 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,"
    " round(tn / nullif(tn + fp, 0), 6) AS specificity FROM ("
    + _sweep_sql("SELECT CAST(i AS DOUBLE) / 1000000 AS threshold FROM range(21950, 21972) s(i)")
    + ") ORDER BY f1 DESC, threshold LIMIT 1",
)
def threshold_best_f1_fine(spark, d):
    """The reference's own grid, in millionths."""
    best = metrics.best_f1(tables.scored(spark, d)).drop("precision", "recall")
    return rounded(best, "f1", "sensitivity", "specificity")


_GROUPS = ["de", "en", "es", "fr", "xx"]
_GROUP_ROWS = ", ".join(f"('{g}')" for g in _GROUPS)


@query(
    "subgroup_classification",
    with_views("scored_v")
    + f"SELECT w.grp, m.n_patients, round(a.auc, 6) AS auc, m.precision, m.recall, m.f1 FROM (VALUES {_GROUP_ROWS})"
    f" w(grp) LEFT JOIN ({_auc_sql('grp')}) a ON w.grp = a.grp LEFT JOIN (SELECT grp, n_patients, {_RATES_SQL} FROM"
    f" (SELECT grp, count(DISTINCT doc_id) AS n_patients, {_COUNTS} FROM ({_LABELLED_SQL}) GROUP BY grp)) m"
    " ON w.grp = m.grp",
)
def subgroup_classification(spark, d):
    measured = metrics.subgroup_classification(tables.scored(spark, d), unit="doc_id", groups=_GROUPS)
    return rounded(measured, "auc", *_RATES)


@query(
    "subgroup_regression",
    with_views("predicted_v")
    + f"SELECT w.grp, m.n_patients, m.mse, m.rmse, m.mae, m.r2 FROM (VALUES ('A'), ('N'), ('R'), ('Z')) w(grp)"
    f" LEFT JOIN (SELECT grp, count(*) AS n_patients, {_REGRESSION_SQL} FROM predicted_v GROUP BY grp) m"
    " ON w.grp = m.grp",
)
def subgroup_regression(spark, d):
    return _rounded_regression(
        metrics.subgroup_regression(tables.predicted(spark, d), groups=["A", "N", "R", "Z"])
    )
