"""Welch tests, false-discovery adjustment and differential codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scores import log2_fold_change
from wardline.functions.student import student_p
from wardline.operators.codes import count_long
from wardline.operators.columns import columns_to_rows
from wardline.operators.projection import linkage_order
from wardline.plans.ordered import ordered_window
from wardline.session import stage

# Bins of the count heat map.
HEATMAP_BINS = 7
HEATMAP_TOP = 6.0


def welch_columns(n0: Column, m0: Column, v0: Column, n1: Column, m1: Column, v1: Column) -> dict[str, Column]:
    """t and degrees of freedom of the unequal-variance test; null when they are not defined."""
    e0, e1 = F.try_divide(v0, n0), F.try_divide(v1, n1)
    error = e0 + e1
    spread = F.try_divide(e0 * e0, n0 - 1) + F.try_divide(e1 * e1, n1 - 1)
    return {
        "t": F.when(error > 0, (m0 - m1) / F.sqrt(error)),
        "df": F.when(error > 0, F.try_divide(error * error, spread)),
    }


def welch_tests(df: DataFrame, columns: list[str], label: str = "hospital_expire_flag") -> DataFrame:
    """One test per measure between label 0 and label 1, all measures in one pass."""
    stats = []
    for c in columns:
        parts = []
        for g in (0, 1):
            value = F.when(F.col(label) == g, F.col(c).cast("double"))
            parts += [
                F.count(value).alias(f"n{g}"), F.avg(value).alias(f"m{g}"), F.var_samp(value).alias(f"v{g}")
            ]
        stats.append(F.struct(*parts).alias(c))
    long = columns_to_rows(df.agg(*stats), [], columns).select("variable", "s.*")
    tested = long.withColumns(welch_columns(*[F.col(x) for x in ("n0", "m0", "v0", "n1", "m1", "v1")]))
    return tested.withColumn("p_value", student_p("t", "df")).select("variable", "t", "df", "p_value")


def adjust_fdr(df: DataFrame, p: str = "p_value", tie: str = "ccs", name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg: running minimum, from the largest p down, of ``p * n / rank``, at most 1.

    Ranks run over the non-null p only; a null stays null.
    """
    keyed = df.withColumns({"_down": -F.col(p), "_known": F.col(p).isNotNull().cast("long")})
    ranked = ordered_window(keyed, [], ["_down", tie], row_number="_from_top", group_sum={"_n": "_known"})
    rank = F.col("_n") - F.col("_from_top") + 1
    scaled = ranked.withColumn("_scaled", F.when(F.col(p).isNotNull(), -(F.col(p) * F.col("_n") / rank)))
    lowest = ordered_window(scaled, [], ["_down", tie], max_before={"_best": "_scaled"})
    value = F.least(F.lit(1.0), -F.greatest(F.col("_best"), F.col("_scaled")))
    return lowest.withColumn(name, F.when(F.col(p).isNotNull(), value)).drop(
        "_down", "_known", "_from_top", "_n", "_scaled", "_best"
    )


def _code_moments(
    diagnoses: DataFrame, admissions: DataFrame, exclude: tuple[str, ...], label: str
) -> tuple[DataFrame, tuple[int, int]]:
    """Sum and sum of squares of the counts per code and label, and the admissions per label.

    One pass over the diagnoses: the grouping sets give the count per admission and code together with
    one row per diagnosed admission. The result has one row per code and is staged, so that neither
    reading the totals nor the ranking for the adjustment runs the counting again.
    """
    sets = [["hadm_id", "ccs_code"], ["hadm_id"]]
    counts = diagnoses.groupingSets(sets, "hadm_id", "ccs_code").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("ccs_code").alias("_is_total")
    )
    outcomes = admissions.select("hadm_id", label).where(F.col(label).isNotNull())
    sums = []
    for g in (0, 1):
        mine = F.col(label) == g
        value = F.when(mine, F.col("n")).otherwise(0)
        sums += [F.sum(value).alias(f"s{g}"), F.sum(value.cast("double") * value).alias(f"q{g}"), F.count_if(mine).alias(f"c{g}")]
    joined = counts.join(outcomes, "hadm_id")
    moments = stage(joined.groupBy(F.col("ccs_code").alias("ccs"), "_is_total").agg(*sums), "code-moments")
    totals = moments.where("_is_total = 1").select("c0", "c1").first() or (0, 0)
    codes = moments.where((F.col("_is_total") == 0) & F.col("ccs").isNotNull() & ~F.col("ccs").isin(*exclude))
    return codes.select("ccs", "s0", "q0", "s1", "q1"), tuple(totals)


def _mean(g: int, n: tuple[int, int]) -> Column:
    return F.try_divide(F.col(f"s{g}"), F.lit(n[g]))


def _variance(g: int, n: tuple[int, int]) -> Column:
    """Sample variance with the absent pairs counted as zeros."""
    total = F.col(f"s{g}").cast("double")  # the square of a long total overflows
    square = total * total / F.lit(float(max(n[g], 1)))
    return F.try_divide(F.col(f"q{g}") - square, F.lit(n[g] - 1))


def group_means(
    diagnoses: DataFrame, admissions: DataFrame, exclude: tuple[str, ...] = (), label: str = "hospital_expire_flag"
) -> DataFrame:
    """Mean count per code for label 0 (control) and label 1 (treated)."""
    moments, n = _code_moments(diagnoses, admissions, exclude, label)
    return moments.select("ccs", _mean(0, n).alias("mean_control"), _mean(1, n).alias("mean_treat"))


def differential_codes(
    diagnoses: DataFrame, admissions: DataFrame, exclude: tuple[str, ...] = ("Unknown_CCS",),
    label: str = "hospital_expire_flag",
) -> DataFrame:
    """Per code: group means, log2 fold change, Welch p and adjusted p.

    Counting runs once; what follows works on one row per code.
    """
    moments, n = _code_moments(diagnoses, admissions, exclude, label)
    means = moments.withColumns({"mean_control": _mean(0, n), "mean_treat": _mean(1, n)})
    tested = means.withColumns(
        welch_columns(
            F.lit(n[0]), F.col("mean_control"), _variance(0, n), F.lit(n[1]), F.col("mean_treat"), _variance(1, n)
        )
    ).withColumns(
        {
            "log2FC": log2_fold_change(F.col("mean_treat"), F.col("mean_control")),
            "p_value": student_p("t", "df"),
        }
    )
    columns = ["ccs", "mean_control", "mean_treat", "log2FC", "t", "df", "p_value"]
    return adjust_fdr(tested.select(*columns))


def top_by_adjusted_p(results: DataFrame, k: int = 6) -> DataFrame:
    return results.orderBy(F.asc_nulls_last("padj"), "ccs").limit(k)


def first_by_outcome(
    df: DataFrame, size: int = 1000, label: str = "hospital_expire_flag", ascending: bool = True
) -> DataFrame:
    """The first ``size`` rows in outcome order (survivors first by default), ties by admission."""
    order = F.asc_nulls_last(label) if ascending else F.desc_nulls_last(label)
    return df.orderBy(order, "hadm_id").limit(size)


def heatmap_matrix(
    diagnoses: DataFrame, admissions: DataFrame, size: int = 1000, exclude: tuple[str, ...] = ("Unknown_CCS",),
    label: str = "hospital_expire_flag",
) -> DataFrame:
    """Long count matrix ``(hadm_id, ccs_code, n, bin)``: the chosen admissions by all codes, absent pairs as zero.

    Its size is ``size`` times the number of codes, however many rows there are.
    """
    diagnosed = admissions.select("hadm_id", label).join(diagnoses.select("hadm_id"), "hadm_id", "left_semi")
    chosen = first_by_outcome(diagnosed, size, label).select("hadm_id")
    known = diagnoses.where(~F.col("ccs_code").isin(*exclude))
    every = known.agg(F.collect_set("ccs_code").alias("codes")).select("codes").scalar()
    counts = count_long(known.join(F.broadcast(chosen), "hadm_id", "left_semi"))
    cells = chosen.withColumn("ccs_code", F.explode(every)).join(counts, ["hadm_id", "ccs_code"], "left")
    counts = cells.withColumn("n", F.coalesce("n", F.lit(0)))
    top = F.lit(HEATMAP_TOP)
    place = F.when(F.col("n") >= top, HEATMAP_BINS).otherwise(
        F.width_bucket(F.col("n").cast("double"), F.lit(0.0), top, F.lit(HEATMAP_BINS))
    )
    return counts.withColumn("bin", place.cast("long"))


def heatmap_row_order(cells: DataFrame) -> DataFrame:
    """``(ccs_code, position)``: codes in the leaf order of complete linkage on their rows of the heat map.

    Distances come from the products of the counts of codes that occur together, over the chosen admissions only;
    the product table has at most a row for each pair of codes that meet, the linkage one for each code.
    """
    counts = cells.where(F.col("n") > 0).select("hadm_id", "ccs_code", F.col("n").cast("double").alias("n"))
    names = [r[0] for r in cells.select("ccs_code").distinct().orderBy("ccs_code").collect()]
    other = counts.select("hadm_id", F.col("ccs_code").alias("with"), F.col("n").alias("m"))
    products = counts.join(other, "hadm_id").where("ccs_code <= with").groupBy("ccs_code", "with").agg(F.sum(F.col("n") * F.col("m")).alias("g"))
    at = {name: i for i, name in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for a, b, g in products.collect():
        gram[at[a], at[b]] = gram[at[b], at[a]] = g
    gaps = np.sqrt(np.maximum(np.diag(gram)[:, None] + np.diag(gram)[None] - 2 * gram, 0))
    order = linkage_order(gaps)
    rows = [(names[i], place) for place, i in enumerate(order)]
    return cells.sparkSession.createDataFrame(rows, "ccs_code string, position long")
