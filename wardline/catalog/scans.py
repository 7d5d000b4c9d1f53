"""Sources, sinks, column and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.prepared import RACE_LEVELS, race_bucket, stays
from wardline.catalog.registry import longs, query, rounded
from wardline.catalog.views import with_views
from wardline.functions.clean import bucket_by_regex
from wardline.operators import admissions as adm
from wardline.operators import columns as cols
from wardline.operators import models, preparation
from wardline.session import new_path, stage
from wardline.sources import csv, tables

_CSV_COLUMNS = ["hadm_id", "subject_id", "race", "admission_type", "language", "hospital_expire_flag", "cost"]


@query(
    "scan_csv_inferred",
    with_views("admissions_v")
    + "SELECT hadm_id, subject_id, race, admission_type, language,"
    " CAST(hospital_expire_flag AS BIGINT) AS hospital_expire_flag, cost FROM admissions_v",
)
def scan_csv_inferred(spark, d):
    path = new_path(spark, "inferred")
    csv.sink_csv(tables.admissions(spark, d).select(*_CSV_COLUMNS), path)
    return longs(csv.scan_csv(spark, path), "hadm_id", "subject_id", "hospital_expire_flag")


@query(
    "scan_csv_string",
    with_views("diagnoses_v")
    + "SELECT CAST(subject_id AS VARCHAR) AS subject_id, CAST(hadm_id AS VARCHAR) AS hadm_id,"
    " CAST(seq_num AS VARCHAR) AS seq_num, icd_code, icd_version FROM diagnoses_v",
)
def scan_csv_string(spark, d):
    path = new_path(spark, "strings")
    csv.sink_csv(tables.diagnoses(spark, d), path)
    return csv.scan_csv_strings(spark, path)


@query(
    "scan_drop_rowname",
    with_views("patients_v")
    + "SELECT subject_id, gender, anchor_age, anchor_year, insurance FROM patients_v",
)
def scan_drop_rowname(spark, d):
    path = new_path(spark, "rownames")
    rows = tables.patients(spark, d).selectExpr(
        "subject_id + 1 AS X", "subject_id", "gender", "anchor_age", "anchor_year", "insurance"
    )
    csv.sink_csv(rows, path)
    return csv.drop_rowname(csv.scan_csv(spark, path, rows.schema))


@query(
    "sink_csv",
    with_views("admissions_v")
    + "SELECT hadm_id, subject_id, admittime, dischtime, edregtime, race, cost FROM admissions_v",
)
def sink_csv(spark, d):
    path = new_path(spark, "sink")
    rows = tables.admissions(spark, d).select(
        "hadm_id", "subject_id", "admittime", "dischtime", "edregtime", "race", "cost"
    )
    csv.sink_csv(rows, path)
    return csv.scan_csv(spark, path, rows.schema)


@query("sink_model_artifacts")
def sink_model_artifacts(spark, d):
    """A pipeline with medians, encoder, scale and trees, saved, read back, and applied to raw rows with nulls."""
    numbers = ["age", "admission_no", "cost", "ER_LoS", "days_since_discharge"]
    rows = stage(stays(spark, d).select("hadm_id", "LoS", "race", *numbers), "raw")
    path = new_path(spark, "model")
    models.save_model(preparation.fit_prepared(rows, numbers, ["race"], "LoS", False, optional=numbers[3:]), path)
    return preparation.score_raw(models.load_model(path), rows).select("hadm_id", "LoS", "pred")


@query(
    "project_columns",
    with_views("diagnoses_v") + "SELECT subject_id, hadm_id, seq_num, icd_code FROM diagnoses_v",
)
def project_columns(spark, d):
    return cols.project_columns(tables.diagnoses(spark, d), ["subject_id", "hadm_id", "seq_num", "icd_code"])


@query(
    "rename_columns",
    with_views("ccs_v") + "SELECT icd_code AS code, ccs_code AS group_code, ccs_description AS group_name FROM ccs_v",
)
def rename_columns(spark, d):
    quoted = {"icd_code": "'ICD-10-CM CODE'", "ccs_code": "'CCSR CATEGORY 1'"}
    raw = cols.rename_columns(tables.code_groups(spark, d), quoted)
    names = {
        "'ICD-10-CM CODE'": "code",
        "'CCSR CATEGORY 1'": "group_code",
        "ccs_description": "group_name",
    }
    return cols.rename_columns(raw, names)


@query("add_literal_column", with_views("gem_v") + "SELECT *, '10' AS icd_version FROM gem_v")
def add_literal_column(spark, d):
    return cols.add_literal_column(tables.code_map(spark, d), "icd_version", "10")


@query(
    "drop_columns",
    with_views("admissions_v")
    + "SELECT hadm_id, subject_id, hospital_expire_flag, race, admission_type, language, cost FROM admissions_v",
)
def drop_columns(spark, d):
    strict = cols.drop_columns(
        tables.admissions(spark, d), ["admittime", "dischtime", "edregtime", "edouttime"], strict=True
    )
    return cols.drop_columns(strict, ["deathtime", "raw_time", "discharge_location", "dod"])


@query(
    "drop_columns_regex",
    with_views("admissions_v") + "SELECT hadm_id, cost FROM admissions_v",
)
def drop_columns_regex(spark, d):
    wide = race_bucket(tables.admissions(spark, d).select("hadm_id", "race", "cost"))
    return cols.drop_columns_regex(adm.one_hot_encode(wide, {"race": RACE_LEVELS}), "race")


_RACE_SQL = """
SELECT hadm_id, CASE WHEN r IN ('White', 'Black', 'Asian', 'Hispanic') THEN r ELSE 'Unknown/Other' END AS race
FROM (SELECT hadm_id, CASE
        WHEN race IS NULL OR trim(race) = ''
          OR regexp_matches(lower(trim(race)), '\\b(unknown|unable to obtain|other)\\b') THEN 'Unknown/Other'
        WHEN race ILIKE '%white%' THEN 'White' WHEN race ILIKE '%black%' THEN 'Black'
        WHEN race ILIKE '%asian%' THEN 'Asian' WHEN race ILIKE '%hispanic%' THEN 'Hispanic' ELSE race END AS r
      FROM admissions_v)"""

_ONE_HOT_SQL = ", ".join(
    f"CASE WHEN race = '{v}' THEN 1 ELSE 0 END AS \"race_{v}\"" for v in RACE_LEVELS
)


@query(
    "select_columns_prefix",
    with_views("admissions_v") + f"SELECT hadm_id, {_ONE_HOT_SQL} FROM ({_RACE_SQL})",
)
def select_columns_prefix(spark, d):
    wide = race_bucket(tables.admissions(spark, d).select("hadm_id", "race", "cost"))
    return cols.select_columns_prefix(adm.one_hot_encode(wide, {"race": RACE_LEVELS}), "race_", ["hadm_id"])


@query(
    "sanitize_column_names",
    with_views("admissions_v")
    + "SELECT hadm_id, CASE WHEN admission_type = '4-NOT SPECIFIED' THEN 1 ELSE 0 END"
    ' AS "admission_type_4-NOT_SPECIFIED",'
    " CASE WHEN admission_type = '5-LOW' THEN 1 ELSE 0 END AS \"admission_type_5-LOW\" FROM admissions_v",
)
def sanitize_column_names(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "admission_type")
    return cols.sanitize_column_names(
        adm.one_hot_encode(rows, {"admission_type": ["4-NOT SPECIFIED", "5-LOW"]})
    )


@query(
    "split_features_label",
    with_views("stays_v")
    + "SELECT subject_id, hadm_id, admission_no, hospital_expire_flag, round(age, 6) AS age, round(cost, 6) AS cost,"
    ' round("ER_LoS", 6) AS "ER_LoS" FROM (SELECT * REPLACE (CAST(age AS DOUBLE) AS age) FROM stays_v)',
)
def split_features_label(spark, d):
    rows = stays(spark, d).select(
        "subject_id", "hadm_id", "admission_no", "hospital_expire_flag", "LoS", "age", "cost", "ER_LoS"
    )
    roles = cols.column_roles(
        rows, ["subject_id", "hadm_id"], "hospital_expire_flag", "admission_no", exclude=["LoS"]
    )
    chosen = [*roles["ids"], *roles["order"], *roles["label"], *roles["features"]]
    doubles = rows.withColumns({c: F.col(c).cast("double") for c in roles["features"]})
    return rounded(cols.project_columns(doubles, chosen), *roles["features"])


@query(
    "filter_equality_split",
    with_views("diagnoses_v")
    + "SELECT 'nine' AS part, hadm_id, seq_num, icd_code FROM diagnoses_v WHERE icd_version = '9'"
    " UNION ALL SELECT 'ten' AS part, hadm_id, seq_num, icd_code FROM diagnoses_v WHERE icd_version = '10'",
)
def filter_equality_split(spark, d):
    parts = cols.filter_equality_split(tables.diagnoses(spark, d), "icd_version", ["9", "10"])
    named = [
        parts[v].select(F.lit(n).alias("part"), "hadm_id", "seq_num", "icd_code") for v, n in (("9", "nine"), ("10", "ten"))
    ]
    return named[0].unionByName(named[1])


@query(
    "filter_conjunction",
    with_views("gem_v") + "SELECT icd9cm, icd10cm FROM gem_v WHERE no_map = '0' AND combination = '0'",
)
def filter_conjunction(spark, d):
    kept = cols.filter_conjunction(tables.code_map(spark, d), {"no_map": "0", "combination": "0"})
    return kept.select("icd9cm", "icd10cm")


@query(
    "filter_positive_nonnull",
    with_views("stays_v") + 'SELECT hadm_id, round("ER_LoS", 6) AS "ER_LoS" FROM stays_v WHERE "ER_LoS" > 0',
)
def filter_positive_nonnull(spark, d):
    rows = adm.stay_features(adm.join_dimension(tables.admissions(spark, d), tables.patients(spark, d)))
    return rounded(cols.filter_positive_nonnull(rows, "ER_LoS").select("hadm_id", "ER_LoS"), "ER_LoS")


@query(
    "filter_group_flag",
    with_views("admissions_v")
    + "SELECT hadm_id FROM admissions_v WHERE race ILIKE '%asian%'"
    " AND race NOT ILIKE '%white%' AND race NOT ILIKE '%black%'",
)
def filter_group_flag(spark, d):
    bucketed = tables.admissions(spark, d).select("hadm_id", bucket_by_regex(F.col("race")).alias("race"))
    wide = adm.one_hot_encode(bucketed, {"race": ["White", "Black", "Asian"]})
    return cols.filter_group_flag(wide, "race_Asian").select("hadm_id")


_AUDITED = ["hadm_id", "race", "edregtime", "edouttime", "language"]


@query(
    "audit_nulls",
    with_views("admissions_v")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) = 1 AS has_null FROM admissions_v"
        for c in _AUDITED
    ),
)
def audit_nulls(spark, d):
    return cols.audit_nulls(tables.admissions(spark, d).select(*_AUDITED))
