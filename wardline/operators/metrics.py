"""Classification and regression measures, overall, per threshold and per subgroup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardline.plans.ordered import ordered_window
from wardline.session import stage

# The threshold grids, in integer units so that every engine makes the same numbers.
SWEEP_PERCENT = tuple(range(10, 50, 5))
FINE_MICRO = tuple(range(21950, 21972))
DEFAULT_THRESHOLD = 0.5


def ratio(top: Column, bottom: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def by_score(df: DataFrame, y: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score: all that ranking measures need."""
    return df.groupBy(*(groups or []), F.col(score).alias("_score")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
    )


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null where one class is missing.

    A positive at a score wins against every negative below it: the running count of negatives in
    score order gives all comparisons at once. The score counts are written first, so that ``df`` is read once.
    """
    groups = groups or []
    counts = stage(by_score(df, y, score, groups), "scores")
    ranked = ordered_window(counts, groups, ["_score"], sum_before={"_below": "_neg"})
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*groups).agg(F.when(pairs > 0, F.try_divide(wins, pairs)).alias("auc"))


def confusion_counts(y: str, pred: str) -> list[Column]:
    t, p = F.col(y), F.col(pred)
    return [
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    ]


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """All four cells, also the empty ones."""
    return df.agg(*confusion_counts(y, pred)).selectExpr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (true_label, predicted_label, n)"
    )


def precision_recall_f1(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    counts = df.agg(*confusion_counts(y, pred))
    return counts.select(*[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("int")).alias("accuracy"))


def sensitivity_specificity(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(*confusion_counts(y, pred)).select(
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def regression_measures(
    df: DataFrame, y: str = "y", pred: str = "pred", groups: list[str] | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """MSE, RMSE, MAE and R2 in one pass; R2 is null where the target is constant."""
    groups = groups or []
    known = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    error = F.col(y) - F.col(pred)
    sums = known.groupBy(*groups).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(F.col(y)).alias("_var"),
        (F.min(y) < F.max(y)).alias("_varies"),
        *(extra or []),
    )
    return sums.withColumns(
        {"rmse": F.sqrt("mse"), "r2": F.when(F.col("_varies"), 1 - F.try_divide(F.col("mse"), F.col("_var")))}
    ).drop("_var", "_varies")


def threshold_sweep(
    df: DataFrame, y: str = "y", score: str = "score", steps: tuple[int, ...] = SWEEP_PERCENT, unit: float = 100.0
) -> DataFrame:
    """Confusion counts and rates at every threshold ``step / unit``.

    Each row is reduced to the number of thresholds it passes; the counts per such number are as few
    as the thresholds, and sums from the top down give every threshold. One pass, no row repeated.
    """
    steps = sorted(steps)
    grid = F.array(*[F.lit(s / unit) for s in steps])
    passed = F.size(F.filter(grid, lambda t: F.col(score) >= t))
    reduced = df.where(F.col(score).isNotNull()).groupBy(passed.alias("_passed")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
    )
    filled = df.sparkSession.range(len(steps) + 1).selectExpr("CAST(id AS INT) AS _passed")
    everything = Window.partitionBy(F.lit(0))
    down = everything.orderBy(F.desc("_passed")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    counted = filled.join(reduced, "_passed", "left").select(
        "_passed",
        F.coalesce(F.sum("_pos").over(down), zero).alias("tp"),
        F.coalesce(F.sum("_neg").over(down), zero).alias("fp"),
        F.coalesce(F.sum("_pos").over(everything), zero).alias("_p"),
        F.coalesce(F.sum("_neg").over(everything), zero).alias("_n"),
    )
    at = counted.where("_passed > 0").select(
        F.element_at(grid, F.col("_passed")).alias("threshold"),
        "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"),
    )
    return at.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def best_f1(
    df: DataFrame, y: str = "y", score: str = "score", steps: tuple[int, ...] = FINE_MICRO, unit: float = 1e6
) -> DataFrame:
    """The threshold with the highest F1 (the lowest on ties), its counts, sensitivity and specificity."""
    swept = threshold_sweep(df, y, score, steps, unit)
    return (
        swept.orderBy(F.desc("f1"), "threshold")
        .limit(1)
        .withColumns(
            {
                "sensitivity": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
                "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")),
            }
        )
    )


def _with_all_groups(measures: DataFrame, group: str, groups: list[str] | None) -> DataFrame:
    """Left join from the wanted list, so that an empty group has a row of nulls."""
    if groups is None:
        return measures
    wanted = measures.sparkSession.createDataFrame([(g,) for g in groups], f"{group} string")
    return wanted.join(measures, group, "left")


def subgroup_classification(
    df: DataFrame, group: str = "grp", y: str = "y", score: str = "score", unit: str | None = None,
    threshold: float = DEFAULT_THRESHOLD, groups: list[str] | None = None,
) -> DataFrame:
    """AUC, precision, recall, F1 and number of patients per group, from one table of score counts."""
    passed = F.col("_score") >= F.lit(threshold)
    counts = stage(by_score(df, y, score, [group]), "scores")
    ranked = ordered_window(counts, [group], ["_score"], sum_before={"_below": "_neg"})
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    measured = ranked.groupBy(group).agg(
        F.when(
            pairs > 0, F.try_divide(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))), pairs)
        ).alias("auc"),
        F.sum(F.when(passed, F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(passed, F.col("_neg")).otherwise(0)).alias("_fp"),
        F.sum(F.when(~passed, F.col("_pos")).otherwise(0)).alias("_fn"),
        F.sum(F.col("_pos") + F.col("_neg")).alias("_rows"),
    )
    measured = measured.withColumns(rates(F.col("_tp"), F.col("_fp"), F.col("_fn")))
    if unit:
        sizes = df.groupBy(group).agg(F.count_distinct(unit).alias("n_patients"))
        measured = measured.join(sizes, group)
    else:
        measured = measured.withColumnRenamed("_rows", "n_patients")
    return _with_all_groups(measured.drop("_tp", "_fp", "_fn", "_rows"), group, groups)


def subgroup_regression(
    df: DataFrame, group: str = "grp", y: str = "y", pred: str = "pred", unit: str | None = None,
    groups: list[str] | None = None,
) -> DataFrame:
    size = F.count_distinct(unit) if unit else F.count(F.lit(1))
    return _with_all_groups(regression_measures(df, y, pred, [group], [size.alias("n_patients")]), group, groups)


def sort_groups_by_size(measures: DataFrame, group: str = "grp", k: int = 20) -> DataFrame:
    return measures.orderBy(F.desc_nulls_last("n_patients"), group).limit(k)
