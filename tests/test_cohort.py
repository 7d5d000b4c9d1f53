"""The end-to-end tables: no leakage, nothing lost, orphans kept, files readable."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardline.operators.admissions import overlap_count
from wardline.operators.columns import columns_with_prefix
from wardline.operators import codes
from wardline.plans import cohort
from wardline.plans.cohort import NOT_FEATURES, Cohort, build_cohort, subgroup_performance
from wardline.session import new_path
from wardline.sources import csv, tables


@pytest.fixture(scope="module")
def made(spark):
    d = "/root/testdata/sf0.001"
    return build_cohort(
        tables.admissions(spark, d).drop("raw_time"), tables.patients(spark, d).drop("nation"), tables.diagnoses(spark, d),
        tables.code_map(spark, d), tables.code_groups(spark, d),
    )


@pytest.fixture(scope="module")
def dense(spark):
    d = "/root/testdata/sf0.001"
    return build_cohort(
        tables.admissions(spark, d).drop("raw_time"), tables.patients(spark, d).drop("nation"), tables.diagnoses(spark, d),
        tables.code_map(spark, d), tables.code_groups(spark, d), code_columns=["'C3'", "'C4'"],
    )


def test_subjects_are_on_one_side(made):
    assert overlap_count(made.train, made.test).first()["overlap"] == 0
    assert overlap_count(made.train_wide, made.test_wide).first()["overlap"] == 0


def test_both_matrices_hold_the_same_admissions(made):
    narrow = made.train.select("hadm_id").unionByName(made.test.select("hadm_id"))
    wide = made.train_wide.select("hadm_id").unionByName(made.test_wide.select("hadm_id"))
    assert narrow.count() == narrow.distinct().count() == wide.count()
    assert narrow.exceptAll(wide).count() == 0


def test_orphan_diagnoses_stay_together(made):
    sides = [df.where("subject_id IS NULL").count() for df in (made.train, made.test)]
    assert max(sides) > 0 and min(sides) == 0
    assert made.merged.where("hadm_id < 0").count() > 0
    assert made.train.unionByName(made.test).where("hadm_id < 0").count() == 0


def test_columns(made):
    assert not set(NOT_FEATURES) & set(made.train.columns)
    assert [c for c in made.train.columns if c.startswith("ccs_emb_")] == [f"ccs_emb_{i}" for i in range(1, 31)]
    assert {"indices", "counts"} <= set(made.train_wide.columns) and not columns_with_prefix(made.train_wide, "'C")
    assert {"race_White", "race_Unknown/Other", "language_0", "language_1"} <= set(made.train.columns)
    flags = [f"`{c}`" for c in columns_with_prefix(made.train, "race_")]
    sums = made.train.where("subject_id IS NOT NULL").select(sum(F.col(c) for c in flags).alias("s")).distinct()
    assert [r["s"] for r in sums.collect()] == [1]


def test_no_count_is_lost_either_way(made, dense):
    sparse = made.train_wide.select("hadm_id", "indices", "counts").unionByName(made.test_wide.select("hadm_id", "indices", "counts"))
    position = {r["ccs_code"]: r["ccs_index"] for r in made.dictionary.collect()}
    cells = {r["hadm_id"]: dict(zip(r["indices"], r["counts"])) for r in sparse.collect()}
    columns = ["hadm_id", "`'C3'`", "`'C4'`", "other"]
    for c3, c4, other, hadm in ((r[1], r[2], r[3], r[0]) for r in dense.train_wide.select(*columns).unionByName(dense.test_wide.select(*columns)).collect()):
        found = cells[hadm]
        assert c3 == found.get(position["'C3'"], 0) and c4 == found.get(position["'C4'"], 0) and c3 + c4 + other == sum(found.values())


def test_written_tables_read_back(spark, made, dense):
    folder = new_path(spark, "cohort")
    dense.write(folder, as_csv=True)
    back = csv.scan_csv(spark, f"{folder}/test_wide.csv", dense.test_wide.schema)
    assert back.exceptAll(dense.test_wide).count() == 0 and back.count() == dense.test_wide.count()
    made.write(f"{folder}-sparse", as_csv=True)
    assert spark.read.csv(f"{folder}-sparse/test_wide.csv", header=True).count() == made.test_wide.count()
    made.write(f"{folder}-parquet")
    assert spark.read.parquet(f"{folder}-parquet/merged.parquet").count() == made.merged.count()


def test_rows_meet_the_split_before_the_vectors(spark, monkeypatch):
    """Rows with code vectors are written once, as the matrix; orphans follow the null subject, as rows without a subject do."""
    written, real = {}, cohort.stage

    def noted(df, name, partition_by=None):
        written[name] = df.columns
        return real(df, name, partition_by)

    monkeypatch.setattr(cohort, "stage", noted)
    rows = [(h, None if h % 10 == 0 else h % 7, h % 3 == 0) for h in range(40)]
    admissions = spark.createDataFrame([(h, s, int(dead), "WHITE") for h, s, dead in rows], "hadm_id long, subject_id long, hospital_expire_flag int, race string").withColumns(
        {c: F.lit("2000-01-01 00:00:00") for c in ("admittime", "dischtime", "edregtime", "edouttime", "deathtime")} | {"language": F.lit("English")}
    )
    admissions = admissions.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("admittime", "dischtime", "edregtime", "edouttime")})
    patients = spark.createDataFrame([(s, "M", 50, "1990", "") for s in range(7)], "subject_id long, gender string, anchor_age int, anchor_year string, dod string")
    diagnoses = spark.createDataFrame([(None, h, 1, "A1", "10") for h in [*range(50), None]], "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version string")
    code_map = spark.createDataFrame([("N1", "A1", "0", "0")], "icd9cm string, icd10cm string, no_map string, combination string")
    groups = spark.createDataFrame([("A1", "C1", "one")], "icd_code string, ccs_code string, ccs_description string")
    made = build_cohort(admissions, patients, diagnoses, code_map, groups, share=0.5)
    assert [n for n, columns in written.items() if "ccs_emb_1" in columns] == ["matrix"]
    sides = [{(r[0], r[1]) for r in df.select("hadm_id", "subject_id").collect()} for df in (made.train, made.test)]
    assert sides[0] | sides[1] == {(h, s) for h, s, _ in rows} | {(h, None) for h in [*range(40, 50), None]}
    assert not {s for _, s in sides[0]} & {s for _, s in sides[1]}
    wide = [{(r[0], r[1]) for r in df.select("hadm_id", "subject_id").collect()} for df in (made.train_wide, made.test_wide)]
    assert wide == sides


def test_listed_codes_are_counted_in_one_shuffle(spark, capsys):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (2, None), (None, "b")], "hadm_id long, ccs_code string")
    counts = codes.count_pivot(rows, ["a", "b"])
    counts.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert {tuple(r) for r in counts.collect()} == {(1, 2, 0, 1), (2, 0, 0, 1), (None, 0, 1, 0)}


def test_medians_are_learned_where_a_null_is(spark, monkeypatch):
    """Columns without a null need no median, those without a training value are no features, a null of the test rows counts."""
    asked, used = [], []
    learn, fit = cohort.scaling.learn_medians, cohort.models.fit_outcome_trees
    monkeypatch.setattr(cohort.scaling, "learn_medians", lambda df, columns: asked.extend(columns) or learn(df, columns))
    monkeypatch.setattr(cohort.models, "fit_outcome_trees", lambda df, features, *a, **k: used.extend(features) or fit(df, features, *a, **k))
    schema = "hadm_id long, subject_id long, hospital_expire_flag int, race_a int, race_b int, full double, holed double, late double, empty double"
    rows = [(i, i, i % 2, i % 3 // 2, 1 - i % 3 // 2, float(i), None if i % 4 else i / 2, float(i % 5), None) for i in range(40)]
    train = spark.createDataFrame(rows, schema)
    test = spark.createDataFrame([(*r[:7], None, 1.0) for r in rows], schema)
    found = subgroup_performance(Cohort(train, train, test, train, test, train), maxIter=2, maxDepth=2)
    assert found.count() == 2
    assert asked == ["holed", "late"]
    assert used == ["race_a", "race_b", "full", "holed", "late"]
