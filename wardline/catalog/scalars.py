"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.prepared import grouped, stays
from wardline.catalog.registry import query, rounded
from wardline.catalog.views import with_views
from wardline.functions import clean, scores
from wardline.operators import admissions as adm
from wardline.operators import codes, summaries
from wardline.sources import tables


@query(
    "null_if_empty",
    with_views("admissions_v", "patients_v")
    + "SELECT a.hadm_id, nullif(a.deathtime, '') AS deathtime, nullif(p.dod, '') AS dod FROM admissions_v a"
    " LEFT JOIN patients_v p ON a.subject_id = p.subject_id",
)
def null_if_empty(spark, d):
    joined = adm.join_dimension(
        tables.admissions(spark, d).select("hadm_id", "subject_id", "deathtime"),
        tables.patients(spark, d).select("subject_id", "dod"),
    )
    return joined.select(
        "hadm_id", *[clean.null_if_empty(F.col(c)).alias(c) for c in ("deathtime", "dod")]
    )


def unknown_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR trim({c}) = '' OR regexp_matches(lower(trim({c})),"
        f" '\\b(unknown|unable to obtain|other)\\b') THEN 'Unknown/Other' ELSE {c} END"
    )


@query(
    "normalize_unknown",
    with_views("admissions_v")
    + f"SELECT hadm_id, {unknown_sql('race')} AS race, {unknown_sql('admission_type')} AS admission_type,"
    f" {unknown_sql('language')} AS language FROM admissions_v",
)
def normalize_unknown(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "race", "admission_type", "language")
    return adm.normalize_categories(rows, ["race", "admission_type", "language"])


@query(
    "default_code_label",
    with_views("grouped_v") + "SELECT hadm_id, seq_num, icd_code, ccs_code FROM grouped_v",
)
def default_code_label(spark, d):
    return grouped(spark, d).select("hadm_id", "seq_num", "icd_code", "ccs_code")


@query(
    "encode_gender",
    with_views("patients_v")
    + "SELECT subject_id, CASE gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 END AS gender,"
    " CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS gender_sequence FROM patients_v",
)
def encode_gender(spark, d):
    return tables.patients(spark, d).select(
        "subject_id",
        clean.encode_gender(F.col("gender")).alias("gender"),
        clean.encode_gender(F.col("gender"), clean.GENDER_CODES_SEQUENCE).alias("gender_sequence"),
    )


@query(
    "encode_language",
    with_views("admissions_v")
    + "SELECT hadm_id, CASE WHEN language = 'English' THEN 1 ELSE 0 END AS language FROM admissions_v",
)
def encode_language(spark, d):
    return tables.admissions(spark, d).select("hadm_id", clean.encode_language(F.col("language")).alias("language"))


@query(
    "parse_multiformat_time",
    with_views("admissions_v")
    + "SELECT hadm_id, coalesce(try_strptime(trim(raw_time), '%Y-%m-%d %H:%M:%S'),"
    " try_strptime(trim(raw_time), '%Y-%m-%d'), try_strptime(trim(raw_time), '%Y')) AS parsed FROM admissions_v",
)
def parse_multiformat_time(spark, d):
    return tables.admissions(spark, d).select("hadm_id", clean.parse_time(F.col("raw_time")).alias("parsed"))


@query(
    "bucket_by_regex",
    with_views("admissions_v")
    + "SELECT hadm_id, CASE WHEN race ILIKE '%white%' THEN 'White' WHEN race ILIKE '%black%' THEN 'Black'"
    " WHEN race ILIKE '%asian%' THEN 'Asian' WHEN race ILIKE '%hispanic%' THEN 'Hispanic' ELSE race END AS race"
    " FROM admissions_v",
)
def bucket_by_regex(spark, d):
    return tables.admissions(spark, d).select("hadm_id", clean.bucket_by_regex(F.col("race")).alias("race"))


def _rare_sql(column: str, table: str) -> str:
    return (
        f"CASE WHEN {column} IN (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"
        f" HAVING count(*) < 0.04 * (SELECT count(*) FROM {table})) THEN 'Unknown/Other'"
        f" ELSE CAST({column} AS VARCHAR) END AS {column}"
    )


@query(
    "bin_rare_categories",
    with_views("patients_v")
    + f"SELECT subject_id, {_rare_sql('nation', 'patients_v')}, {_rare_sql('insurance', 'patients_v')} FROM patients_v",
)
def bin_rare_categories(spark, d):
    rows = tables.patients(spark, d).select("subject_id", "nation", "insurance")
    return adm.bin_rare_categories(rows, ["nation", "insurance"], threshold=0.04)


_TOP = "SELECT {0} FROM (SELECT {0}, count(*) AS n FROM {1} GROUP BY {0} ORDER BY n DESC, {0} ASC NULLS LAST LIMIT {2})"


@query(
    "lump_other",
    with_views("patients_v")
    + "SELECT CASE WHEN insurance IN ("
    + _TOP.format("insurance", "patients_v", 2)
    + ") THEN insurance ELSE 'Other' END AS main_cat, insurance AS sub_cat, count(*) AS n FROM patients_v"
    " GROUP BY ALL",
)
def lump_other(spark, d):
    return summaries.lump_other(tables.patients(spark, d).select("insurance"), "insurance", 2)


@query("age_at_admission", with_views("stays_v") + "SELECT hadm_id, CAST(age AS BIGINT) AS age FROM stays_v")
def age_at_admission(spark, d):
    joined = adm.join_dimension(
        tables.admissions(spark, d).select("hadm_id", "subject_id", "admittime"),
        tables.patients(spark, d).select("subject_id", "anchor_year", "anchor_age"),
    )
    age = clean.age_at(F.col("admittime"), clean.parse_time(F.col("anchor_year")), F.col("anchor_age"))
    return joined.select("hadm_id", age.cast("long").alias("age"))


@query(
    "length_of_stay_days",
    with_views("admissions_v")
    + "SELECT hadm_id, round(date_diff('microsecond', admittime, dischtime) / 86400000000.0, 6) AS los_days"
    " FROM admissions_v",
)
def length_of_stay_days(spark, d):
    los = clean.days_between(F.col("admittime"), F.col("dischtime"))
    return rounded(tables.admissions(spark, d).select("hadm_id", los.alias("los_days")), "los_days")


@query(
    "er_stay",
    with_views("admissions_v")
    + "SELECT hadm_id, round(date_diff('microsecond', edregtime, edouttime) / 86400000000.0, 6) AS er_days"
    " FROM admissions_v",
)
def er_stay(spark, d):
    stay = clean.days_between(F.col("edregtime"), F.col("edouttime"))
    return rounded(tables.admissions(spark, d).select("hadm_id", stay.alias("er_days")), "er_days")


@query(
    "clamp_negative",
    with_views("stays_v")
    + 'SELECT hadm_id, round("LoS", 6) AS "LoS", round("ER_LoS", 6) AS "ER_LoS" FROM stays_v',
)
def clamp_negative(spark, d):
    los = clean.clamp_to_zero(clean.days_between(F.col("admittime"), F.col("dischtime")))
    stay = clean.drop_negative(clean.days_between(F.col("edregtime"), F.col("edouttime")))
    rows = tables.admissions(spark, d).select("hadm_id", los.alias("LoS"), stay.alias("ER_LoS"))
    return rounded(rows, "LoS", "ER_LoS")


@query(
    "days_until_death",
    with_views("admissions_v", "patients_v")
    + "SELECT a.hadm_id, round(date_diff('microsecond', a.admittime, coalesce(try_strptime(p.dod, '%Y-%m-%d'),"
    " try_strptime(a.deathtime, '%Y-%m-%d %H:%M:%S'))) / 86400000000.0, 6) AS days_until_death"
    " FROM admissions_v a LEFT JOIN patients_v p ON a.subject_id = p.subject_id",
)
def days_until_death(spark, d):
    joined = adm.join_dimension(
        tables.admissions(spark, d).select("hadm_id", "subject_id", "admittime", "deathtime"),
        tables.patients(spark, d).select("subject_id", "dod"),
    )
    times = [clean.parse_time(clean.null_if_empty(F.col(c))) for c in ("dod", "deathtime")]
    days = clean.days_until_death(F.col("admittime"), *times)
    return rounded(joined.select("hadm_id", days.alias("days_until_death")), "days_until_death")


@query(
    "normalize_code",
    with_views("diagnoses_v")
    + "SELECT hadm_id, seq_num, trim(replace(replace(icd_code, '.', ''), '''', '')) AS icd_code_clean FROM diagnoses_v",
)
def normalize_code(spark, d):
    return tables.diagnoses(spark, d).select(
        "hadm_id", "seq_num", clean.normalize_code(F.col("icd_code")).alias("icd_code_clean")
    )


@query(
    "cast_to_string",
    with_views("admissions_v")
    + "SELECT hadm_id, CAST(subject_id AS VARCHAR) AS subject_id,"
    " CAST(hospital_expire_flag AS VARCHAR) AS hospital_expire_flag FROM admissions_v",
)
def cast_to_string(spark, d):
    return tables.admissions(spark, d).select(
        "hadm_id", F.col("subject_id").cast("string"), F.col("hospital_expire_flag").cast("string")
    )


@query(
    "strip_label_prefix",
    with_views("admissions_v")
    + "SELECT hadm_id, replace('race_' || race, 'race_', '') AS race FROM admissions_v",
)
def strip_label_prefix(spark, d):
    labelled = F.concat(F.lit("race_"), F.col("race"))
    return tables.admissions(spark, d).select("hadm_id", clean.strip_label_prefix(labelled).alias("race"))


_TEXT = ["hadm_id", "race", "admission_type", "hospital_expire_flag", "cost"]
_TEXT_SQL = " || ' | ' || ".join(
    f"'{c}=' || coalesce(CAST({'CAST(' + c + ' AS DOUBLE)' if c in ('hospital_expire_flag', 'cost') else c}"
    " AS VARCHAR), 'nan')"
    for c in _TEXT
)


@query("row_to_text", with_views("admissions_v") + f"SELECT hadm_id, {_TEXT_SQL} AS text FROM admissions_v")
def row_to_text(spark, d):
    text = clean.row_to_text(_TEXT, {"hospital_expire_flag", "cost"})
    return tables.admissions(spark, d).select("hadm_id", text.alias("text"))


@query(
    "softmax_scale",
    with_views("stays_v")
    + "SELECT hadm_id, round(s, 9) AS age_softmax, round(2 + (s - lo) / (hi - lo) * 8, 6) AS age_scaled FROM ("
    "SELECT hadm_id, s, min(s) OVER () AS lo, max(s) OVER () AS hi FROM ("
    "SELECT hadm_id, e / sum(e) OVER () AS s FROM (SELECT hadm_id,"
    " exp(age / 0.5 - max(age / 0.5) OVER ()) AS e FROM (SELECT hadm_id, CAST(age AS DOUBLE) AS age FROM stays_v))))",
)
def softmax_scale(spark, d):
    rows = adm.stay_features(adm.join_dimension(tables.admissions(spark, d), tables.patients(spark, d)))
    scaled = summaries.softmax_scale(rows.select("hadm_id", "age"), "age", temperature=0.5).drop("age")
    return rounded(rounded(scaled, "age_softmax", digits=9), "age_scaled")


_LOGIT_SQL = "SELECT doc_id, ln(score / (1 - score)) AS x, score FROM scored_v"


@query(
    "logit_to_probability",
    with_views("scored_v")
    + "SELECT doc_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(exp(x) / (exp(x) + 1), 6) AS softmax,"
    f" CASE WHEN x > 0 THEN 1 ELSE 0 END AS label FROM ({_LOGIT_SQL})",
)
def logit_to_probability(spark, d):
    x = F.log(F.col("score") / (1 - F.col("score")))
    rows = tables.scored(spark, d).select("doc_id", x.alias("x"), F.lit(0.0).alias("zero"))
    made = rows.select(
        "doc_id",
        scores.sigmoid(F.col("x")).alias("sigmoid"),
        scores.softmax_pair(F.col("zero"), F.col("x")).alias("softmax"),
        scores.argmax_pair(F.col("zero"), F.col("x")).alias("label"),
    )
    return rounded(made, "sigmoid", "softmax")


@query(
    "threshold_label",
    with_views("scored_v")
    + "SELECT doc_id, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM scored_v",
)
def threshold_label(spark, d):
    return tables.scored(spark, d).select("doc_id", scores.threshold_label(F.col("score"), 0.5).alias("pred"))


@query(
    "win_admission_no",
    with_views("stays_v") + "SELECT hadm_id, subject_id, admission_no FROM stays_v",
)
def win_admission_no(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "subject_id", "admittime", "dischtime")
    return adm.admission_history(rows).select("hadm_id", "subject_id", "admission_no")


@query(
    "win_days_since_discharge",
    with_views("stays_v")
    + "SELECT hadm_id, subject_id, round(days_since_discharge, 6) AS days_since_discharge FROM stays_v",
)
def win_days_since_discharge(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "subject_id", "admittime", "dischtime")
    history = adm.admission_history(rows).select("hadm_id", "subject_id", "days_since_discharge")
    return rounded(history, "days_since_discharge")


@query(
    "stay_history",
    with_views("stays_v")
    + 'SELECT hadm_id, subject_id, admission_no, CAST(age AS BIGINT) AS age, round("LoS", 6) AS "LoS",'
    ' round("ER_LoS", 6) AS "ER_LoS", round(days_since_discharge, 6) AS days_since_discharge FROM stays_v',
)
def stay_history(spark, d):
    rows = stays(spark, d).select(
        "hadm_id", "subject_id", "admission_no", F.col("age").cast("long").alias("age"), "LoS", "ER_LoS",
        "days_since_discharge",
    )
    return rounded(rows, "LoS", "ER_LoS", "days_since_discharge")


@query(
    "agg_distinct_levels",
    with_views("grouped_v") + "SELECT DISTINCT ccs_code FROM grouped_v",
)
def agg_distinct_levels(spark, d):
    return codes.code_levels(grouped(spark, d)).orderBy("ccs_code")
