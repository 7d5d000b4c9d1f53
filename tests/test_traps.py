"""Small frames for the behaviours that are easy to get wrong."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import clean, scores
from wardline.functions.student import two_sided_p
from wardline.operators import admissions as adm
from wardline.operators import codes, columns, metrics, scaling, sequences, summaries
from wardline.operators import tests_of_difference as diff


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_mapping_fans_out_and_drops_unmapped(spark):
    d = spark.createDataFrame(
        [(1, 1, 1, "N1", "9"), (1, 1, 2, "N2", "9"), (1, 1, 3, "N.1", "9"), (1, 1, 4, "A.1", "10"), (1, 1, 5, "x", "8")],
        "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version string",
    )
    m = spark.createDataFrame(
        [("N1", "A1", "0", "0"), ("N1", "A2", "0", "0"), ("N2", "A3", "1", "0"), ("N2", "A4", "0", "1")],
        "icd9cm string, icd10cm string, no_map string, combination string",
    )
    for f in (codes.harmonise_codes, codes.union_codes):
        got = sorted((r["seq_num"], r["icd_code"], r["icd_version"]) for r in f(d, m).collect())
        assert got == [(1, "A1", "10"), (1, "A2", "10"), (4, "A.1", "10")]


def test_quotes_and_dots_are_ignored_in_grouping(spark):
    d = spark.createDataFrame([(1, 1, 1, "'A.1 '"), (1, 1, 2, "zz")], "subject_id long, hadm_id long, seq_num int, icd_code string")
    g = spark.createDataFrame([("'A1'", "'C1'", "one")], "icd_code string, ccs_code string, ccs_description string")
    got = {r["seq_num"]: r["ccs_code"] for r in codes.group_codes(d, g).collect()}
    assert got == {1: "'C1'", 2: None}


@pytest.mark.parametrize(
    "text,want",
    [
        ("WHITE - OTHER EUROPEAN", "Unknown/Other"), ("Another", "Another"), (" ", "Unknown/Other"),
        (None, "Unknown/Other"), ("UNABLE TO OBTAIN", "Unknown/Other"), ("\tunknown\n", "Unknown/Other"),
        ("Brother", "Brother"), ("other", "Unknown/Other"),
    ],
)
def test_unknown_words(spark, text, want):
    assert one(spark, text, clean.normalize_unknown) == want


@pytest.mark.parametrize(
    "text,want",
    [("CAUCASIAN", "Asian"), ("black/white", "White"), ("Hispanic Black", "Black"), ("PORTUGUESE", "PORTUGUESE"), (None, None)],
)
def test_first_pattern_wins(spark, text, want):
    assert one(spark, text, clean.bucket_by_regex) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("1999", "1999-01-01 00:00:00"), (" 1999-03-04 ", "1999-03-04 00:00:00"), ("1999-03-04 05:06:07", "1999-03-04 05:06:07"),
        ("1999/3/4", "1999-03-04 00:00:00"), ("19990304", "1999-03-04 00:00:00"), ("1999-02-30", None), ("bad", None),
        ("", None), (None, None), ("1999/03/04 05:06:07", "1999-03-04 05:06:07"),
    ],
)
def test_times(spark, text, want):
    got = one(spark, text, clean.parse_time)
    assert (got and str(got)) == want


def test_gender_codes(spark):
    df = spark.createDataFrame([("M",), ("F",), ("U",), (None,)], "g string")
    assert values(df.select(clean.encode_gender(F.col("g")).alias("x")), "x") == [0, 1, None, None]
    other = clean.encode_gender(F.col("g"), clean.GENDER_CODES_SEQUENCE)
    assert values(df.select(other.alias("x")), "x") == [1, 0, None, None]


def test_days_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' a, timestamp_ntz'2024-03-11 02:30:00' b")
        assert row.select(clean.days_between(F.col("a"), F.col("b"))).first()[0] == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_clamps(spark):
    assert one(spark, -1.5, clean.clamp_to_zero, "double") == 0.0
    assert one(spark, None, clean.clamp_to_zero, "double") is None
    assert one(spark, -1.5, clean.drop_negative, "double") is None
    assert one(spark, 0.0, clean.drop_negative, "double") == 0.0


def test_null_subjects_follow_the_split(spark):
    rows = spark.createDataFrame([(1, 10), (None, 11), (2, 12), (3, 13)], "subject_id long, hadm_id long")
    train = spark.createDataFrame([(1,), (None,)], "subject_id long")
    assert sorted(values(adm.rows_of_subjects(rows, train), "hadm_id")) == [10, 11]
    assert sorted(values(adm.rows_without_subjects(rows, train), "hadm_id")) == [12, 13]


def test_split_is_exact_per_label_and_disjoint(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(105)], "subject_id long, hospital_expire_flag int")
    split = adm.stratified_split(labels)
    sizes = {
        r["hospital_expire_flag"]: (r["n"], r["k"])
        for r in split.groupBy("hospital_expire_flag")
        .agg(F.count("*").alias("n"), F.count_if("is_train").alias("k"))
        .collect()
    }
    assert sizes == {1: (11, 9), 0: (94, 75)}
    assert adm.overlap_count(split.where("is_train"), split.where("NOT is_train")).first()["overlap"] == 0
    again = adm.stratified_split(labels.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_orphans_on_either_side(spark):
    counts = spark.createDataFrame([(1, 2), (9, 1)], "hadm_id long, n int")
    features = spark.createDataFrame([(1, 5), (2, 6)], "hadm_id long, f int")
    assert sorted(map(tuple, codes.attach_features(counts, features).collect()), key=str) == [(1, 2, 5), (9, 1, None)]
    assert sorted(values(codes.attach_embeddings(features, counts), "hadm_id")) == [1, 9]


def test_real_minus_one_survives_masking(spark):
    df = spark.createDataFrame([(1, 1, 1, 2.0, -1.0), (1, 2, 2, 3.0, 4.0), (2, 3, 1, 7.0, 0.0)],
                               "subject_id long, hadm_id long, admission_no long, v double, y double")
    built = sequences.build_sequences(df, ["v"], "y")
    padded = sequences.pad_sequences(built, 1, 2)
    assert sorted(values(sequences.unroll(padded), "y")) == [-1.0, -1.0, 0.0, 4.0]
    assert sorted(values(sequences.mask_padding(padded), "y")) == [-1.0, 0.0, 4.0]
    with pytest.raises(Exception, match="longer than padding"):
        sequences.pad_sequences(built, 1, 1).collect()


def test_text_rendering(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.5, None)], "n int, x double, s string")
    text = clean.row_to_text(["n", "x", "s"], {"n", "x"})
    assert values(df.select(text.alias("t")), "t") == ["n=1.0 | x=nan | s=a", "n=2.0 | x=2.5 | s=nan"]


def test_rare_limit_is_strict_and_nulls_count(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)] + [(None,)] * 2, "c string")
    got = adm.bin_rare_categories(df, ["c"], 0.2).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {"a": 5, "b": 2, "Unknown/Other": 1, None: 2}


def test_argmax_first_on_ties_and_default(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 1), (0, 0, 0), (None, None, None), (None, 1, 0)], "race_a int, race_b int, race_c int")
    label = scores.argmax_label(["race_a", "race_b", "race_c"])
    assert values(df.select(label.alias("l")), "l") == ["race_a", "race_c", "race_UNKNOWN", "race_UNKNOWN", "race_b"]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`race_A b` int, trace int, `'C1'` int, x int")
    assert columns.drop_columns_regex(df, "race").columns == ["'C1'", "x"]
    assert columns.columns_with_prefix(df, "race_") == ["race_A b"]
    assert columns.sanitize_column_names(df).columns[0] == "race_A_b"
    assert columns.drop_columns(df, ["x", "nope"]).columns == ["race_A b", "trace", "'C1'"]
    with pytest.raises(ValueError):
        columns.drop_columns(df, ["nope"], strict=True)


def test_unpivot_flags(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None)], "id int, race_a int, race_b int")
    got = columns.unpivot_flags(df, ["race_a", "race_b"], "grp", ["id"]).collect()
    assert sorted(map(tuple, got)) == [(1, "race_a"), (2, "race_a"), (2, "race_b")]


def test_auc_undefined_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 1, 0.1)], "grp string, y int, score double")
    got = {r["grp"]: r["auc"] for r in metrics.roc_auc(df, groups=["grp"]).collect()}
    assert got == {"a": 0.5, "b": None}
    table = metrics.subgroup_classification(df, groups=["a", "b", "empty"])
    rows = {r["grp"]: r for r in table.collect()}
    assert rows["empty"]["f1"] is None and rows["b"]["precision"] == 1.0 and rows["b"]["recall"] == 0.5


def test_auc_equals_builtin_evaluator(spark, folder):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from wardline.sources import tables

    df = tables.scored(spark, folder)
    builtin = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(
        df.withColumn("y", F.col("y").cast("double"))
    )
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(builtin, abs=1e-12)


def test_rates_are_zero_when_undefined(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    assert tuple(metrics.precision_recall_f1(df).first()) == (0.0, 0.0, 0.0)
    assert metrics.confusion_matrix(df).agg(F.sum("n")).first()[0] == 2


def test_constant_target_has_no_r2(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "grp string, y double, pred double")
    got = {r["grp"]: r["r2"] for r in metrics.subgroup_regression(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.5)


def test_fine_threshold_grid():
    assert len(metrics.FINE_MICRO) == 22 and metrics.FINE_MICRO[0] / 1e6 == 0.02195
    assert [s / 100 for s in metrics.SWEEP_PERCENT] == [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]


def test_best_threshold_is_the_first_of_the_best(spark):
    df = spark.createDataFrame([(1, 0.021960), (0, 0.021951), (0, 0.01)], "y int, score double")
    best = metrics.best_f1(df).first()
    assert best["threshold"] == pytest.approx(0.021952) and best["f1"] == 1.0 and best["specificity"] == 1.0


def test_student_p():
    t = np.array([0.0, 1.0, -1.0, 3.0, 40.0, np.nan])
    p = two_sided_p(t, np.array([5.0, 1.0, 1.0, 1e6, 30.0, 3.0]))
    assert p[0] == 1.0 and p[1] == pytest.approx(1 - 2 / math.pi * math.atan(1)) and p[1] == p[2]
    assert p[3] == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-3)
    assert 0 < p[4] < 1e-25 and math.isnan(p[5])
    # two degrees of freedom have a closed form: 1 - t / sqrt(2 + t^2)
    assert two_sided_p(np.array([2.5]), np.array([2.0]))[0] == pytest.approx(1 - 2.5 / math.sqrt(2 + 6.25))


def test_significant_digits(spark):
    assert one(spark, 0.012345, scores.significant, "double") == pytest.approx(0.012)
    assert one(spark, 9.96e-33, scores.significant, "double") == pytest.approx(1.0e-32)
    assert one(spark, 0.0, scores.significant, "double") == 0.0


def test_adjusted_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5), ("e", None)], "ccs string, p_value double")
    got = {r["ccs"]: r["padj"] for r in diff.adjust_fdr(df).collect()}
    assert [round(got[c], 9) for c in "abcd"] == [0.04, 0.04, 0.04, 0.5] and got["e"] is None


def test_differential_counts_absent_pairs_as_zero(spark):
    d = spark.createDataFrame(
        [(1, "'A'"), (1, "'A'"), (2, "'B'"), (3, "'A'"), (4, "'B'"), (5, "'A'"), (9, "'A'"), (4, "Unknown_CCS")],
        "hadm_id long, ccs_code string",
    )
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)], "hadm_id long, hospital_expire_flag int")
    rows = {r["ccs"]: r for r in diff.differential_codes(d, a).collect()}
    assert set(rows) == {"'A'", "'B'"}
    assert rows["'A'"]["mean_control"] == 1.0 and rows["'A'"]["mean_treat"] == pytest.approx(2 / 3)
    assert rows["'A'"]["t"] == pytest.approx((1 - 2 / 3) / math.sqrt(2 / 2 + (1 / 3) / 3))


def test_lumping_keeps_the_original(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "v string")
    assert sorted(map(tuple, summaries.lump_other(df, "v", 1).collect())) == [("Other", "b", 2), ("Other", "c", 1), ("a", "a", 3)]


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(-3, 101)] + [(None,)], "v double")
    rows = summaries.histogram(df, "v").collect()
    assert sum(r["n"] for r in rows) == 100 and len(rows) <= 31


def test_softmax_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    rows = summaries.softmax_scale(df, "v").collect()
    assert [r["v_softmax"] for r in rows] == [0.5, 0.5, None]
    assert summaries.softmax_scale(df.where("v IS NULL"), "v").first()["v_scaled"] is None


def test_scaling_moments_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    out = scaling.standardize(df, df, ["a", "b"]).agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert out[0] == pytest.approx(0, abs=1e-12) and out[1] == pytest.approx(1) and out[2] == 0.0


def test_imputation_uses_training_medians(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    test = spark.createDataFrame([(None,), (9.0,)], "a double")
    assert values(scaling.impute(test, scaling.learn_medians(train, ["a"])), "a") == [2.0, 9.0]


def test_code_vectors_do_not_depend_on_other_codes(spark):
    few = spark.createDataFrame([("x",)], "ccs_code string")
    many = spark.createDataFrame([("x",), ("y",)], "ccs_code string")
    a = codes.init_code_vectors(few).first()["vector"]
    b = {r["ccs_code"]: r["vector"] for r in codes.init_code_vectors(many).collect()}
    assert a == b["x"] and len(a) == 30 and all(-0.1 <= v < 0.1 for v in a) and len(set(a)) == 30


def test_csv_keeps_quotes_blanks_and_zeros(spark):
    from wardline.session import new_path
    from wardline.sources import csv

    df = spark.createDataFrame(
        [("007", "'A.1'", 'say "hi", ok', ""), (None, "x", " y ", "NA?")], "`'ICD-10-CM CODE'` string, `'` string, c string, d string"
    )
    path = new_path(spark, "quotes")
    csv.sink_csv(df, path)
    back = csv.scan_csv_strings(spark, path)
    assert back.columns == df.columns
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    typed = csv.scan_csv(spark, path, df.schema)
    assert sorted(map(tuple, typed.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
