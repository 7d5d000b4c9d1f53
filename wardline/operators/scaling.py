"""Imputation, scaling and target encoding, learned on one table and applied to any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.admissions import SEED
from wardline.operators.summaries import medians
from wardline.plans.skew import join_balanced, join_lookup
from wardline.session import stage

# Rows at which a category's own mean weighs one half, and the slope of that weight.
LEAST_ROWS = 20.0
SMOOTHING = 10.0


def learn_medians(train: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """One number per column: exact medians of the training rows, nulls skipped."""
    return {r["variable"]: r["median"] for r in medians(train, columns).collect()}


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 column ``<name>_missing`` per column, for models that cannot take nulls."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def learn_scale(train: DataFrame, columns: list[str], sample: bool = False) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation per column in one pass; a zero or unknown deviation becomes 1."""
    deviation = F.stddev_samp if sample else F.stddev_pop
    row = train.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[deviation(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_scale(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def standardize(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores of ``df`` by the mean and population deviation of ``train``."""
    return apply_scale(df, learn_scale(train, columns))


def center_scale_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and sample deviation 1 per column."""
    return apply_scale(df, learn_scale(df, columns, sample=True))


def _weighted(n: Column, s: Column, overall: Column, least: float, smoothing: float) -> Column:
    """The mean of ``n`` values of sum ``s``, drawn to the overall mean: a sigmoid of the count weighs the two."""
    own = 1 / (1 + F.exp(-(n - F.lit(least)) / F.lit(smoothing)))
    return F.when(n > 0, overall * (1 - own) + F.try_divide(s, n) * own).otherwise(overall)


def target_means(
    train: DataFrame, column: str, target: str, least: float = LEAST_ROWS, smoothing: float = SMOOTHING
) -> tuple[DataFrame, float | None]:
    """Weighted target mean per category (``<column>_encoded``), and the overall mean used for unseen categories.

    A category of ``least`` rows weighs its own mean and the overall mean alike; ``smoothing`` is the slope. Rows
    without a target do not count.
    """
    overall = train.agg(F.avg(target)).first()[0]
    sums = train.groupBy(column).agg(F.count(target).alias("_n"), F.sum(target).alias("_s"))
    encoded = _weighted(F.col("_n"), F.col("_s"), F.lit(overall).cast("double"), least, smoothing)
    return sums.select(column, encoded.alias(f"{column}_encoded")), overall


def target_encode(
    train: DataFrame, df: DataFrame, column: str, target: str, least: float = LEAST_ROWS, smoothing: float = SMOOTHING
) -> DataFrame:
    """Adds ``<column>_encoded`` by all of ``train``, for rows outside it; null is a category of its own."""
    means, overall = target_means(train, column, target, least, smoothing)
    joined = join_lookup(df, means, [column], "left", null_safe=True)
    return joined.withColumn(f"{column}_encoded", F.coalesce(F.col(f"{column}_encoded"), F.lit(overall)))


def fold_of(key: str, folds: int, seed: int = SEED) -> Column:
    """A subject's fold from 0, by hash."""
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % folds).cast("int")


def target_encode_cross_fitted(
    train: DataFrame, column: str, target: str, key: str = "subject_id", folds: int = 5, least: float = LEAST_ROWS,
    smoothing: float = SMOOTHING, seed: int = SEED,
) -> DataFrame:
    """Adds ``<column>_encoded`` to training rows, each from the other folds' subjects only, so no row sees its own target.

    One aggregate by category and fold gives everything: what other folds hold is the category's total less the fold's.
    The overall mean is the other folds' as well.
    """
    rows = train.withColumn("_fold", fold_of(key, folds, seed))
    parts = rows.groupBy(column, "_fold").agg(F.count(target).alias("_n"), F.sum(target).alias("_s"))
    parts = stage(parts, "fold-sums")  # a row for each category and fold
    none = F.lit(0)
    by_fold = parts.groupBy("_fold").agg(F.sum("_n").alias("_fn"), F.sum(F.coalesce("_s", none)).alias("_fs"))
    n, s = parts.agg(F.sum("_n"), F.sum("_s")).first()
    totals = parts.groupBy(column).agg(F.sum("_n").alias("_cn"), F.sum(F.coalesce("_s", none)).alias("_cs"))
    cells = join_balanced(parts, totals, [column], null_safe=True, heavy=None).join(F.broadcast(by_fold), "_fold")
    others = F.try_divide(F.lit(s) - F.col("_fs"), F.lit(n) - F.col("_fn"))
    value = _weighted(F.col("_cn") - F.col("_n"), F.col("_cs") - F.coalesce("_s", none), others, least, smoothing)
    side = cells.select(column, "_fold", value.alias(f"{column}_encoded"))
    return join_lookup(rows, side, [column, "_fold"], "left", null_safe=True).drop("_fold")
