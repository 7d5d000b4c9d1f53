"""The end-to-end tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.joins import EMBEDDING_SQL, PIVOT_SQL
from wardline.catalog.prepared import CODE_LEVELS
from wardline.catalog.registry import query, rounded
from wardline.catalog.scalars import unknown_sql
from wardline.catalog.views import with_views
from wardline.plans.cohort import build_cohort, merge_and_clean, subgroup_performance, subgroup_table
from wardline.sources import tables

_DAYS = ["LoS", "ER_LoS", "days_since_discharge", "days_until_death"]
_CATEGORIES = ["race", "admission_type", "insurance", "language"]
_RACES = ["Another", "Asian", "Black", "Hispanic", "PORTUGUESE", "Unknown/Other", "White"]

_CLEAN = f"""
SELECT s.hadm_id, s.subject_id, s.hospital_expire_flag, s.cost,
       CASE p.gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 END AS gender,
       CASE WHEN u.race ILIKE '%white%' THEN 'White' WHEN u.race ILIKE '%black%' THEN 'Black'
            WHEN u.race ILIKE '%asian%' THEN 'Asian' WHEN u.race ILIKE '%hispanic%' THEN 'Hispanic'
            ELSE u.race END AS race,
       u.admission_type, {unknown_sql('p.insurance')} AS insurance,
       CASE WHEN u.language = 'English' THEN '1' ELSE '0' END AS language,
       CAST(s.age AS BIGINT) AS age, round(s."LoS", 6) AS "LoS", round(s."ER_LoS", 6) AS "ER_LoS", s.admission_no,
       round(s.days_since_discharge, 6) AS days_since_discharge,
       round(date_diff('microsecond', s.admittime, coalesce(try_strptime(p.dod, '%Y-%m-%d'),
             try_strptime(s.deathtime, '%Y-%m-%d %H:%M:%S'))) / 86400000000.0, 6) AS days_until_death
FROM stays_v s LEFT JOIN patients_v p ON s.subject_id = p.subject_id
JOIN (SELECT hadm_id, {unknown_sql('race')} AS race, {unknown_sql('admission_type')} AS admission_type,
             {unknown_sql('language')} AS language FROM admissions_v) u ON s.hadm_id = u.hadm_id"""


def _binned(c: str) -> str:
    return (
        f"CASE WHEN count(*) OVER (PARTITION BY {c}) < 0.01 * count(*) OVER () THEN 'Unknown/Other' ELSE {c} END AS {c}"
    )


_MERGED = (
    "SELECT hadm_id, subject_id, hospital_expire_flag, cost, gender, "
    + ", ".join(_binned(c) for c in _CATEGORIES)
    + ', age, "LoS", "ER_LoS", admission_no, days_since_discharge, days_until_death'
    + f" FROM ({_CLEAN})"
)


def _inputs(spark, d):
    admitted = tables.admissions(spark, d).drop("raw_time")
    return admitted, tables.patients(spark, d).drop("nation")


def _cohort(spark, d):
    return build_cohort(
        *_inputs(spark, d), tables.diagnoses(spark, d), tables.code_map(spark, d), tables.code_groups(spark, d),
        code_columns=CODE_LEVELS,
    )


@query("cohort_merged", with_views("stays_v") + _MERGED)
def cohort_merged(spark, d):
    merged = merge_and_clean(*_inputs(spark, d))
    chosen = merged.select(
        "hadm_id", "subject_id", "hospital_expire_flag", "cost", "gender", *_CATEGORIES,
        F.col("age").cast("long").alias("age"), "admission_no", *_DAYS,
    )
    return rounded(chosen, *_DAYS)


# subjects of the diagnosed admissions; a diagnosis without an admission belongs to the null subject
_SPLIT = f"""
SELECT subject_id, rank_no <= CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT) AS is_train
FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY md5('67-' || coalesce(CAST(subject_id AS VARCHAR), '')),
             subject_id NULLS LAST) AS rank_no, count(*) OVER (PARTITION BY flag) AS n
      FROM (SELECT a.subject_id, max(a.hospital_expire_flag) AS flag
            FROM (SELECT DISTINCT hadm_id FROM grouped_v) g LEFT JOIN admissions_v a ON g.hadm_id = a.hadm_id
            GROUP BY a.subject_id))"""

_FLAGS = ", ".join(f"CASE m.race WHEN '{r}' THEN 1 ELSE CASE WHEN m.race IS NOT NULL THEN 0 END END AS \"race_{r}\"" for r in _RACES)


@query(
    "cohort_wide",
    with_views("grouped_v", "stays_v")
    + f"SELECT s.is_train, p.*, m.subject_id, m.hospital_expire_flag, m.\"LoS\", {_FLAGS} FROM ({PIVOT_SQL}) p"
    f" LEFT JOIN ({_MERGED}) m ON p.hadm_id = m.hadm_id"
    f" JOIN ({_SPLIT}) s ON s.subject_id IS NOT DISTINCT FROM m.subject_id",
)
def cohort_wide(spark, d):
    made = _cohort(spark, d)
    kept = ["hadm_id", *CODE_LEVELS, "other", "subject_id", "hospital_expire_flag", "LoS", *[f"race_{r}" for r in _RACES]]
    parts = [
        df.select(F.lit(flag).alias("is_train"), *[f"`{c}`" for c in kept])
        for df, flag in ((made.train_wide, True), (made.test_wide, False))
    ]
    return rounded(parts[0].unionByName(parts[1]), "LoS")


@query(
    "cohort_embedded",
    with_views("grouped_v", "stays_v")
    + "SELECT s.is_train, e.hadm_id, e.ccs_emb_1, e.ccs_emb_30, m.subject_id, m.admission_no, m.gender"
    f" FROM ({EMBEDDING_SQL}) e LEFT JOIN ({_MERGED}) m ON e.hadm_id = m.hadm_id"
    f" JOIN ({_SPLIT}) s ON s.subject_id IS NOT DISTINCT FROM m.subject_id",
)
def cohort_embedded(spark, d):
    made = _cohort(spark, d)
    kept = ["hadm_id", "ccs_emb_1", "ccs_emb_30", "subject_id", "admission_no", "gender"]
    parts = [
        df.select(F.lit(flag).alias("is_train"), *kept) for df, flag in ((made.train, True), (made.test, False))
    ]
    return rounded(parts[0].unionByName(parts[1]), "ccs_emb_1", "ccs_emb_30")


@query("cohort_subgroups")
def cohort_subgroups(spark, d):
    """From raw tables to a model and its performance by race."""
    return subgroup_performance(_cohort(spark, d))


_SCORED = (
    "SELECT 'race_' || m.race AS grp, m.subject_id, m.hospital_expire_flag AS y, m.age / CAST(110 AS DOUBLE) AS score"
    f" FROM (SELECT DISTINCT hadm_id FROM grouped_v) g JOIN ({_MERGED}) m ON g.hadm_id = m.hadm_id"
    f" JOIN ({_SPLIT}) s ON s.subject_id IS NOT DISTINCT FROM m.subject_id"
    " WHERE NOT s.is_train AND m.race IS NOT NULL AND m.hospital_expire_flag IS NOT NULL AND m.age IS NOT NULL"
)


@query(
    "cohort_subgroups_by_age",
    with_views("grouped_v", "stays_v").rstrip()
    + f", f AS ({_SCORED}), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS k FROM f)"
    " SELECT grp AS race, round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc,"
    " round(coalesce(count(*) FILTER (y = 1 AND score >= 0.5) / nullif(count(*) FILTER (score >= 0.5), 0), 0), 6) AS precision,"
    " round(coalesce(count(*) FILTER (y = 1 AND score >= 0.5) / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS recall,"
    " round(coalesce(2 * count(*) FILTER (y = 1 AND score >= 0.5) / nullif(count(*) FILTER (score >= 0.5) + count(*) FILTER (y = 1), 0), 0), 6) AS f1,"
    " count(DISTINCT subject_id) AS n_patients FROM r GROUP BY grp",
)
def cohort_subgroups_by_age(spark, d):
    """The subgroup table of the test matrix for a score that needs no model."""
    scored = _cohort(spark, d).test.where("age IS NOT NULL").withColumn("score", F.col("age") / F.lit(110.0))
    return rounded(subgroup_table(scored), "auc", "precision", "recall", "f1")
