"""Aggregates, distributions and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.prepared import grouped, stays
from wardline.catalog.registry import query, rounded
from wardline.catalog.views import with_views
from wardline.functions import scores
from wardline.operators import admissions as adm
from wardline.operators import codes, summaries
from wardline.operators import tests_of_difference as diff
from wardline.plans.quantiles import exact_quantiles
from wardline.session import stage
from wardline.sources import tables


@query(
    "agg_max_per_subject",
    with_views("admissions_v")
    + "SELECT subject_id, max(hospital_expire_flag) AS hospital_expire_flag FROM admissions_v GROUP BY subject_id",
)
def agg_max_per_subject(spark, d):
    return adm.subject_labels(tables.admissions(spark, d))


@query(
    "agg_frequency",
    with_views("admissions_v")
    + "SELECT 'all' AS rule, race, count(*) AS n FROM admissions_v GROUP BY race UNION ALL"
    " SELECT 'known' AS rule, race, count(*) AS n FROM admissions_v WHERE race IS NOT NULL GROUP BY race",
)
def agg_frequency(spark, d):
    rows = tables.admissions(spark, d).select("race")
    both = [
        summaries.frequency(rows, "race", skip).select(F.lit(rule).alias("rule"), "race", "n")
        for rule, skip in (("all", False), ("known", True))
    ]
    return both[0].unionByName(both[1])


@query(
    "agg_code_length_frequency",
    with_views("diagnoses_v")
    + "SELECT CAST(length(icd_code) AS BIGINT) AS code_length, count(*) AS n FROM diagnoses_v"
    " WHERE icd_version = '9' GROUP BY 1",
)
def agg_code_length_frequency(spark, d):
    return summaries.code_length_frequency(tables.diagnoses(spark, d))


@query(
    "agg_patient_summary",
    with_views("stays_v")
    + "SELECT hadm_id, subject_id, CAST(max(age) OVER (PARTITION BY subject_id) AS BIGINT) AS max_age,"
    " max(admission_no) OVER (PARTITION BY subject_id) AS tot_admissions FROM stays_v",
)
def agg_patient_summary(spark, d):
    rows = stays(spark, d).select("hadm_id", "subject_id", F.col("age").cast("long").alias("age"), "admission_no")
    return summaries.patient_summary(rows)


@query(
    "agg_patient_summary_once",
    with_views("stays_v")
    + "SELECT subject_id, CAST(max(age) AS BIGINT) AS max_age, max(admission_no) AS tot_admissions"
    " FROM stays_v GROUP BY subject_id",
)
def agg_patient_summary_once(spark, d):
    rows = stays(spark, d).select("hadm_id", "subject_id", F.col("age").cast("long").alias("age"), "admission_no")
    return summaries.patient_summary(rows, per_patient=True)


@query(
    "agg_label_distribution",
    with_views("admissions_v")
    + "SELECT CAST(hospital_expire_flag AS VARCHAR) AS x, count(*) AS n,"
    " count(*) FILTER (hospital_expire_flag = 1) AS n_positive FROM admissions_v GROUP BY 1",
)
def agg_label_distribution(spark, d):
    return summaries.label_distribution(tables.admissions(spark, d))


@query(
    "agg_class_balance",
    with_views("admissions_v")
    + "SELECT neg, pos, round(neg / greatest(pos, 1), 6) AS pos_weight FROM (SELECT"
    " count(*) FILTER (hospital_expire_flag = 0) AS neg, count(*) FILTER (hospital_expire_flag = 1) AS pos"
    " FROM admissions_v)",
)
def agg_class_balance(spark, d):
    return rounded(summaries.class_balance(tables.admissions(spark, d)), "pos_weight")


_MEASURES = ["LoS", "ER_LoS", "days_since_discharge", "age", "cost"]


def _long_sql(measures, extra="") -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS variable, CAST(\"{m}\" AS DOUBLE) AS v{extra} FROM stays_v" for m in measures
    )


@query(
    "agg_median",
    with_views("stays_v")
    + f"SELECT variable, round(median(v), 6) AS median FROM ({_long_sql(_MEASURES)}) GROUP BY variable",
)
def agg_median(spark, d):
    return rounded(summaries.medians(stays(spark, d).select(*_MEASURES), _MEASURES), "median")


@query(
    "agg_describe",
    with_views("stays_v")
    + "SELECT variable, count(v) AS \"count\", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,"
    " round(min(v), 6) AS \"min\", round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median,"
    " round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS \"max\""
    f" FROM ({_long_sql(_MEASURES)}) GROUP BY variable",
)
def agg_describe(spark, d):
    out = summaries.describe(stays(spark, d).select(*_MEASURES), _MEASURES)
    return rounded(out, "mean", "sd", "min", "q25", "median", "q75", "max")


_SHARES = {"p1": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(
    "agg_percentiles_by_group",
    with_views("stays_v")
    + "SELECT race, variable, "
    + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in _SHARES.items())
    + f" FROM ({_long_sql(_MEASURES, ', race')}) WHERE v IS NOT NULL GROUP BY race, variable",
)
def agg_percentiles_by_group(spark, d):
    found = exact_quantiles(stays(spark, d), ["race"], _MEASURES, _SHARES)
    return rounded(found, *_SHARES)


@query(
    "agg_histogram",
    with_views("stays_v")
    + ", placed AS (SELECT w, CAST(greatest(ceil(v / w), 1) AS BIGINT) AS bin FROM (SELECT v,"
    ' (max(v) OVER () - min(v) OVER ()) / 29 AS w FROM (SELECT "LoS" AS v FROM stays_v WHERE "LoS" > 0)))'
    " SELECT b.bin, count(p.bin) AS n, round(b.bin * (SELECT any_value(w) FROM placed), 6) AS upper FROM"
    " (SELECT unnest(range((SELECT min(bin) FROM placed), (SELECT max(bin) FROM placed) + 1)) AS bin) b"
    " LEFT JOIN placed p ON p.bin = b.bin GROUP BY b.bin",
)
def agg_histogram(spark, d):
    rows = adm.stay_features(adm.join_dimension(tables.admissions(spark, d), tables.patients(spark, d)))
    return rounded(summaries.histogram(rows, "LoS"), "upper")


_BOXED = ["LoS", "ER_LoS", "age", "cost"]
_BOX_SQL = (
    "SELECT hospital_expire_flag, variable, quantile_cont(v, 0.25) AS q25, median(v) AS median,"
    f" quantile_cont(v, 0.75) AS q75 FROM ({_long_sql(_BOXED, ', hospital_expire_flag')})"
    " WHERE v IS NOT NULL GROUP BY hospital_expire_flag, variable"
)


@query(
    "agg_boxplot_stats",
    with_views("stays_v")
    + "SELECT b.hospital_expire_flag, b.variable, round(any_value(q25), 6) AS q25,"
    " round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75,"
    " round(min(v) FILTER (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS whisker_low,"
    " round(max(v) FILTER (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS whisker_high"
    f" FROM ({_BOX_SQL}) b JOIN ({_long_sql(_BOXED, ', hospital_expire_flag')}) x"
    " ON b.hospital_expire_flag = x.hospital_expire_flag AND b.variable = x.variable"
    " GROUP BY b.hospital_expire_flag, b.variable",
)
def agg_boxplot_stats(spark, d):
    rows = stays(spark, d).select(
        "hospital_expire_flag", *[F.col(c).cast("double").alias(c) for c in _BOXED]
    )
    return rounded(summaries.boxplot_stats(rows, _BOXED), "q25", "median", "q75", "whisker_low", "whisker_high")


# Two-sided p of Student's t by quadrature: with t = sqrt(df) * tan(a) the tail is the integral of
# cos(a)^(df - 1), and a window of a few decay lengths holds all of it. Simpson's rule, 600 panels.
def p_value_sql(source: str, columns: str) -> str:
    """``source`` has ``t`` and ``df``; ``columns`` are passed through."""
    panel = (
        "(CASE WHEN i = 0 OR i = 600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp((df - 1)"
        " * ln(greatest(cos(a0 + width * i / 600), CAST(1e-300 AS DOUBLE)))) * width / 1800"
    )
    return (
        f"SELECT {columns}, t, df, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * tail AS p_value"
        f" FROM (SELECT *, (SELECT sum({panel}) FROM range(0, 601) AS s(i)) AS tail"
        " FROM (SELECT *, least(pi() / 2 - a0, 12 / sqrt(df)) AS width FROM"
        f" (SELECT *, atan(abs(t) / sqrt(df)) AS a0 FROM ({source}))))"
    )


_WELCH_GROUPS = (
    "SELECT variable, avg(v) FILTER (f = 0) AS m0, var_samp(v) FILTER (f = 0) AS v0, count(v) FILTER (f = 0) AS n0,"
    " avg(v) FILTER (f = 1) AS m1, var_samp(v) FILTER (f = 1) AS v1, count(v) FILTER (f = 1) AS n1"
    f" FROM ({_long_sql(_MEASURES, ', hospital_expire_flag AS f')}) GROUP BY variable"
)
_WELCH_SQL = (
    "SELECT *, (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t, pow(v0 / n0 + v1 / n1, 2)"
    " / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) AS df"
)


@query(
    "agg_welch_ttest",
    with_views("stays_v")
    + "SELECT variable, round(t, 6) AS t, round(df, 4) AS df, round(log10(p_value), 4) AS log10_p,"
    " round(p_value / pow(10.0, floor(log10(p_value)) - 1)) * pow(10.0, floor(log10(p_value)) - 1) AS p_2 FROM ("
    + p_value_sql(f"{_WELCH_SQL} FROM ({_WELCH_GROUPS})", "variable")
    + ")",
)
def agg_welch_ttest(spark, d):
    """The p value to two significant digits, as the reference prints it, and its logarithm, which tells small ones apart."""
    tested = diff.welch_tests(stays(spark, d).select("hospital_expire_flag", *_MEASURES), _MEASURES)
    shown = tested.select("variable", "t", "df", F.log10("p_value").alias("log10_p"), scores.significant(F.col("p_value")).alias("p_2"))
    return rounded(rounded(shown, "t"), "df", "log10_p", digits=4)


# counts per code and outcome over all diagnosed admissions, absent pairs as zeros
_CODE_COUNTS = (
    "SELECT c.ccs_code AS ccs, a.hadm_id, a.hospital_expire_flag AS f, coalesce(g.n, 0) AS n FROM"
    " (SELECT DISTINCT ccs_code FROM grouped_v WHERE ccs_code <> 'Unknown_CCS') c"
    " CROSS JOIN (SELECT hadm_id, hospital_expire_flag FROM admissions_v WHERE hadm_id IN"
    " (SELECT hadm_id FROM grouped_v)) a LEFT JOIN (SELECT hadm_id, ccs_code, count(*) AS n FROM grouped_v"
    " GROUP BY hadm_id, ccs_code) g ON g.hadm_id = a.hadm_id AND g.ccs_code = c.ccs_code"
)
_CODE_STATS = (
    "SELECT ccs, avg(n) FILTER (f = 0) AS m0, var_samp(n) FILTER (f = 0) AS v0, count(n) FILTER (f = 0) AS n0,"
    " avg(n) FILTER (f = 1) AS m1, var_samp(n) FILTER (f = 1) AS v1, count(n) FILTER (f = 1) AS n1"
    f" FROM ({_CODE_COUNTS}) GROUP BY ccs"
)
_CODE_P = p_value_sql(f"{_WELCH_SQL} FROM ({_CODE_STATS})", "ccs, m0, m1, log2(m1 + 1) - log2(m0 + 1) AS log2fc")
_BH = (
    "SELECT *, least(1, min(p_value * n / r) OVER (ORDER BY p_value DESC, ccs ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW)) AS padj FROM (SELECT *, count(p_value) OVER () AS n,"
    f" count(p_value) OVER () - row_number() OVER (ORDER BY p_value DESC, ccs) + 1 AS r FROM ({_CODE_P}))"
)


@query(
    "agg_group_means",
    with_views("grouped_v", "admissions_v")
    + f"SELECT ccs, round(m0, 6) AS mean_control, round(m1, 6) AS mean_treat FROM ({_CODE_STATS})",
)
def agg_group_means(spark, d):
    means = diff.group_means(grouped(spark, d), tables.admissions(spark, d), ("Unknown_CCS",))
    return rounded(means, "mean_control", "mean_treat")


def _differential(spark, d):
    return diff.differential_codes(grouped(spark, d), tables.admissions(spark, d))


_RESULT = (
    'ccs, round(m0, 6) AS mean_control, round(m1, 6) AS mean_treat, round(log2fc, 6) AS "log2FC",'
    " round(t, 6) AS t, round(df, 4) AS df, round(log10(p_value), 4) AS log10_p, round(log10(padj), 4) AS log10_padj"
)


def _rounded_result(df):
    """p as logarithms: rounded decimals would make all small ones zero."""
    logs = df.withColumns({"log10_p": F.log10("p_value"), "log10_padj": F.log10("padj")}).drop("p_value", "padj")
    return rounded(rounded(logs, "mean_control", "mean_treat", "log2FC", "t"), "df", "log10_p", "log10_padj", digits=4)


@query("differential_codes", with_views("grouped_v", "admissions_v") + f"SELECT {_RESULT} FROM ({_BH})")
def differential_codes(spark, d):
    return _rounded_result(_differential(spark, d))


@query(
    "topk_by_adjusted_p",
    with_views("grouped_v", "admissions_v")
    + "SELECT ccs, round(padj, 6) AS padj FROM ("
    + f"SELECT * FROM ({_BH}) ORDER BY round(padj, 9) NULLS LAST, ccs LIMIT 6)",
)
def topk_by_adjusted_p(spark, d):
    results = _differential(spark, d).withColumn("padj", F.round("padj", 9))
    return rounded(diff.top_by_adjusted_p(results).select("ccs", "padj"), "padj")


@query(
    "volcano_class",
    with_views("grouped_v", "admissions_v")
    + "SELECT ccs, "
    + ", ".join(
        f"CASE WHEN abs({fold}) > {f} AND padj < {p} THEN 'FC_P' WHEN padj < {p} THEN 'P' WHEN abs({fold}) > {f} THEN 'FC' ELSE 'NS' END AS {name}"
        for name, fold, f, p in (("volcano", "log2fc", 0.4, "CAST(1e-31 AS DOUBLE)"), ("volcano_low", "log2fc", 0.005, 0.9), ("volcano_steep", "log2fc * 100", 0.4, 0.9))
    )
    + f" FROM ({_BH})",
)
def volcano_class(spark, d):
    """By the reference's cut-offs, and by lower ones that these tables reach."""
    fold, p = F.col("log2FC"), F.col("padj")
    return _differential(spark, d).select(
        "ccs", scores.volcano_class(fold, p).alias("volcano"), scores.volcano_class(fold, p, 0.005, 0.9).alias("volcano_low"),
        scores.volcano_class(fold * 100, p, p_cut=0.9).alias("volcano_steep"),
    )


@query(
    "win_bh_adjust",
    with_views("grouped_v", "admissions_v")
    + f"SELECT ccs, round(log10(p_value), 4) AS log10_p, round(log10(padj), 4) AS log10_padj FROM ({_BH})",
)
def win_bh_adjust(spark, d):
    return rounded(_differential(spark, d).select("ccs", F.log10("p_value").alias("log10_p"), F.log10("padj").alias("log10_padj")), "log10_p", "log10_padj", digits=4)


@query(
    "log2_fold_change",
    with_views("grouped_v", "admissions_v")
    + f'SELECT ccs, round(log2(m1 + 1) - log2(m0 + 1), 6) AS "log2FC" FROM ({_CODE_STATS})',
)
def log2_fold_change(spark, d):
    means = diff.group_means(grouped(spark, d), tables.admissions(spark, d), ("Unknown_CCS",))
    return rounded(means.select("ccs", scores.log2_fold_change(F.col("mean_treat"), F.col("mean_control")).alias("log2FC")), "log2FC")


_FOI = ["days_since_discharge", "ER_LoS", "age", "admission_no"]


@query(
    "correlation_scatter_data",
    with_views("stays_v")
    + " UNION ALL ".join(
        f"SELECT hadm_id, hospital_expire_flag, round(\"LoS\", 6) AS \"LoS\", '{c}' AS measure,"
        f' round(CAST("{c}" AS DOUBLE), 6) AS value FROM stays_v WHERE "{c}" IS NOT NULL'
        for c in _FOI
    ),
)
def correlation_scatter_data(spark, d):
    return rounded(summaries.correlation_scatter(stays(spark, d), _FOI), "LoS", "value")


@query(
    "correlation_by_measure",
    with_views("stays_v")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS measure, round(corr(CAST(\"{c}\" AS DOUBLE), \"LoS\"), 6) AS correlation FROM stays_v"
        for c in _FOI
    ),
)
def correlation_by_measure(spark, d):
    return rounded(summaries.measure_correlations(stays(spark, d), _FOI), "correlation")


@query(
    "heatmap_matrix",
    with_views("grouped_v", "admissions_v")
    + "SELECT a.hadm_id, c.ccs_code, coalesce(g.n, 0) AS n, CAST(CASE WHEN g.n >= 6 THEN 7"
    " ELSE floor(coalesce(g.n, 0) / (6.0 / 7)) + 1 END AS BIGINT) AS bin"
    " FROM (SELECT hadm_id FROM admissions_v WHERE hadm_id IN (SELECT hadm_id FROM grouped_v)"
    " ORDER BY hospital_expire_flag, hadm_id LIMIT 1000) a"
    " CROSS JOIN (SELECT DISTINCT ccs_code FROM grouped_v WHERE ccs_code <> 'Unknown_CCS') c"
    " LEFT JOIN (SELECT hadm_id, ccs_code, count(*) AS n FROM grouped_v GROUP BY hadm_id, ccs_code) g"
    " ON g.hadm_id = a.hadm_id AND g.ccs_code = c.ccs_code",
)
def heatmap_matrix(spark, d):
    return diff.heatmap_matrix(grouped(spark, d), tables.admissions(spark, d), 1000)


@query("heatmap_row_order")
def heatmap_row_order(spark, d):
    """The heat map's codes in the order in which the reference draws its rows."""
    cells = stage(diff.heatmap_matrix(grouped(spark, d), tables.admissions(spark, d), 1000), "heatmap")
    return diff.heatmap_row_order(cells)


@query(
    "count_matrix_long",
    with_views("grouped_v") + "SELECT hadm_id, ccs_code, count(*) AS n FROM grouped_v GROUP BY hadm_id, ccs_code",
)
def count_matrix_long(spark, d):
    return codes.count_long(grouped(spark, d))
