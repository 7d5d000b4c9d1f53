"""Frequencies, descriptive statistics and the tables behind the distribution plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.columns import columns_to_rows
from wardline.plans.quantiles import exact_quantiles
from wardline.plans.skew import join_balanced, join_lookup

# Bin count, fence factor and output range that results depend on.
BINS = 30
FENCE = 1.5
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def frequency(df: DataFrame, column: str, skip_null: bool = False, name: str = "n") -> DataFrame:
    rows = df.where(F.col(column).isNotNull()) if skip_null else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def code_length_frequency(diagnoses: DataFrame, version: str = "9") -> DataFrame:
    lengths = diagnoses.where(F.col("icd_version") == version).select(
        F.length("icd_code").cast("long").alias("code_length")
    )
    return frequency(lengths, "code_length")


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return frequency(df, column).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def lump_other(df: DataFrame, column: str, k: int, other: str = "Other") -> DataFrame:
    """Counts per (top-k value or ``Other``, original value): the stacked-bar table.

    Works on the frequency table, so the rows are read once for the counts and once for the top.
    """
    counts = frequency(df, column)
    top = top_categories(df, column, k).select(F.col(column).alias("_top"), F.lit(True).alias("_is_top"))
    tagged = counts.join(F.broadcast(top), counts[column].eqNullSafe(top["_top"]), "left")
    return tagged.select(
        F.when(F.col("_is_top"), F.col(column).cast("string")).otherwise(F.lit(other)).alias("main_cat"),
        F.col(column).cast("string").alias("sub_cat"),
        "n",
    )


def patient_summary(df: DataFrame, per_patient: bool = False) -> DataFrame:
    """Largest age and admission number per patient; repeated once per admission unless ``per_patient``."""
    summary = df.groupBy("subject_id").agg(
        F.max("age").alias("max_age"), F.max("admission_no").alias("tot_admissions")
    )
    if per_patient:
        return summary
    return join_balanced(df.select("hadm_id", "subject_id"), summary, ["subject_id"], "left", null_safe=True)


def label_distribution(df: DataFrame, label: str = "hospital_expire_flag") -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_positive")
    )


def class_balance(df: DataFrame, label: str = "hospital_expire_flag") -> DataFrame:
    counts = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    return counts.withColumn("pos_weight", F.col("neg") / F.greatest(F.col("pos"), F.lit(1)))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per column, nulls skipped; a column without values has a null median."""
    found = exact_quantiles(df, [], columns, {"median": 0.5})
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    return names.join(F.broadcast(found), "variable", "left")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample sd, min, quartiles, max: one row per column."""
    stats = {
        "count": F.count,
        "mean": F.avg,
        "sd": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[F.struct(*[f(c).alias(s) for s, f in stats.items()]).alias(c) for c in columns]
    )
    basic = columns_to_rows(row, [], columns).select("variable", "s.*")
    return basic.join(F.broadcast(exact_quantiles(df, [], columns, QUARTILES)), "variable", "left")


def histogram(df: DataFrame, column: str, bins: int = BINS, boundary: float = 0.0) -> DataFrame:
    """Counts per bin of the positive values, zero for empty bins between the first and the last.

    Bin width is the range divided by ``bins - 1`` and edges are multiples of it from ``boundary``,
    closed on the right, so that data anchored at the boundary fill at most ``bins`` bins.
    """
    values = df.where(F.col(column) > 0).select(F.col(column).cast("double").alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return values.limit(0).select(F.lit(0).cast("long").alias("bin"), F.col("v").alias("upper"), F.lit(0).alias("n"))
    width = (high - low) / (bins - 1) if high > low else 0.1
    place = F.greatest(F.ceil((F.col("v") - F.lit(boundary)) / F.lit(width)), F.lit(1)).cast("long")
    first, last = (max(math.ceil((v - boundary) / width), 1) for v in (low, high))
    every = df.sparkSession.range(first, last + 1).withColumnRenamed("id", "bin")  # about ``bins`` rows
    counts = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(boundary) + F.col("bin") * F.lit(width)).alias("upper")
    )


def boxplot_stats(df: DataFrame, columns: list[str], by: str = "hospital_expire_flag") -> DataFrame:
    """Quartiles and whiskers: the furthest values within 1.5 interquartile ranges of the box."""
    boxes = exact_quantiles(df, [by], columns, QUARTILES)
    reach = F.lit(FENCE) * (F.col("q75") - F.col("q25"))
    fenced = boxes.withColumns({"_low": F.col("q25") - reach, "_high": F.col("q75") + reach})
    long = df.select(by, *columns).unpivot([by], columns, "variable", "value").where("value IS NOT NULL")
    inside = F.when(F.col("value").between(F.col("_low"), F.col("_high")), F.col("value"))
    return (
        join_lookup(long, fenced, [by, "variable"], "inner", null_safe=True)
        .groupBy(by, "variable", *QUARTILES)
        .agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))
    )


def correlation_scatter(
    df: DataFrame, columns: list[str], target: str = "LoS", label: str = "hospital_expire_flag"
) -> DataFrame:
    """One row per admission and measure: target against measure, with the outcome; nulls left out."""
    return (
        df.select("hadm_id", label, target, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["hadm_id", label, target], columns, "measure", "value")
        .where("value IS NOT NULL")
    )


def measure_correlations(df: DataFrame, columns: list[str], target: str = "LoS") -> DataFrame:
    """Pearson correlation of each measure with the target over the rows that have both, in one pass."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in columns])
    return row.unpivot([], columns, "measure", "correlation")


def softmax_scale(
    df: DataFrame, column: str, temperature: float = 1.0, low: float = 2.0, high: float = 10.0
) -> DataFrame:
    """Adds the softmax of a column and that share rescaled to ``low..high``; nulls stay null.

    Softmax is increasing, so its extremes follow from the extremes of the column: two small
    aggregates instead of three.
    """
    x = F.col(column) / F.lit(temperature)
    smallest, largest = df.agg(F.min(x), F.max(x)).first()
    if largest is None:
        nothing = F.lit(None).cast("double")
        return df.withColumns({f"{column}_softmax": nothing, f"{column}_scaled": nothing})
    raised = F.exp(x - F.lit(largest))
    total = df.agg(F.sum(raised)).first()[0]
    share = raised / F.lit(total)
    ends = (math.exp(smallest - largest) / total, 1.0 / total)
    span = ends[1] - ends[0]
    scaled = F.lit(low) + (share - F.lit(ends[0])) / F.lit(span) * F.lit(high - low) if span else F.lit((low + high) / 2)
    return df.withColumns({f"{column}_softmax": share, f"{column}_scaled": F.when(share.isNotNull(), scaled)})
