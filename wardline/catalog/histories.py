"""Sequences, lagged features, imputation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.prepared import stays
from wardline.catalog.registry import query, rounded
from wardline.catalog.views import with_views
from wardline.operators import admissions as adm
from wardline.operators import scaling, sequences
from wardline.sources import tables

_FEATURES = ["age", "cost"]
_STEPS = ["subject_id", "hadm_id", "admission_no", "hospital_expire_flag", "race"]


def _sequences(spark, d):
    rows = stays(spark, d).select(*_STEPS, *_FEATURES)
    return sequences.build_sequences(rows, _FEATURES, "hospital_expire_flag", group="race")


@query(
    "build_sequences",
    with_views("stays_v")
    + "SELECT subject_id, CAST((admission_no - 1) // 1000 AS INT) AS segment, max(whole) AS length,"
    " string_agg(CAST(hadm_id AS VARCHAR), ',' ORDER BY admission_no) AS hadm_ids,"
    " string_agg(CAST(hospital_expire_flag AS VARCHAR), ',' ORDER BY admission_no) AS labels,"
    " string_agg(CAST(CAST(age AS INT) AS VARCHAR), ',' ORDER BY admission_no) AS ages,"
    " max(first_race) AS group_label FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS whole,"
    " max(CASE WHEN admission_no = 1 THEN race END) OVER (PARTITION BY subject_id) AS first_race FROM stays_v) s"
    " GROUP BY subject_id, (admission_no - 1) // 1000",
)
def build_sequences(spark, d):
    def joined(part):
        return F.array_join(F.transform("steps", part), ",")

    return _sequences(spark, d).select(
        "subject_id",
        "segment",
        "length",
        joined(lambda s: s["hadm_id"].cast("string")).alias("hadm_ids"),
        joined(lambda s: s["y"].cast("int").cast("string")).alias("labels"),
        joined(lambda s: s["x"][0].cast("int").cast("string")).alias("ages"),
        "group_label",
    )


def _padded(spark, d):
    built = _sequences(spark, d)
    return sequences.pad_sequences(built, len(_FEATURES), sequences.longest_segment(built))


@query(
    "pad_sequences",
    with_views("stays_v")
    + "SELECT s.subject_id, CAST(p.pos AS INT) AS pos, coalesce(CAST(t.age AS INT), 0) AS age,"
    " coalesce(t.hospital_expire_flag, -1) AS y, t.hadm_id IS NOT NULL AS is_real"
    " FROM (SELECT DISTINCT subject_id FROM stays_v) s,"
    " (SELECT i AS pos FROM range(0, (SELECT max(admission_no) FROM stays_v)) r(i)) p"
    " LEFT JOIN stays_v t ON t.subject_id = s.subject_id AND t.admission_no = p.pos + 1",
)
def pad_sequences(spark, d):
    cells = sequences.unroll(_padded(spark, d).drop("group_label", "length", "segment"))
    return cells.select(
        "subject_id", "pos", F.col("x")[0].cast("int").alias("age"), F.col("y").cast("int").alias("y"), "is_real"
    )


@query(
    "mask_padding",
    with_views("stays_v")
    + "SELECT subject_id, CAST(admission_no - 1 AS INT) AS pos, CAST(age AS INT) AS age,"
    " hospital_expire_flag AS y FROM stays_v",
)
def mask_padding(spark, d):
    real = sequences.mask_padding(_padded(spark, d).drop("group_label", "length", "segment"))
    return real.select("subject_id", "pos", F.col("x")[0].cast("int").alias("age"), F.col("y").cast("int").alias("y"))


@query(
    "win_first_row_per_group",
    with_views("stays_v") + "SELECT subject_id, race FROM stays_v WHERE admission_no = 1",
)
def win_first_row_per_group(spark, d):
    return sequences.first_label_per_group(
        stays(spark, d).select("subject_id", "admission_no", "hadm_id", "race"), "race"
    )


_LAGGED = ["LoS", "cost"]
_EARLIER = "(PARTITION BY subject_id ORDER BY admission_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "lag_features",
    with_views("stays_v")
    + "SELECT subject_id, hadm_id, admission_no, "
    + ", ".join(
        f'round(lag("{c}") OVER (PARTITION BY subject_id ORDER BY admission_no), 6) AS "{c}_prev",'
        f' round(avg("{c}") OVER {_EARLIER}, 6) AS "{c}_prev_mean",'
        f' round(coalesce(sum("{c}") OVER {_EARLIER}, 0), 6) AS "{c}_prev_sum",'
        f' round(max("{c}") OVER {_EARLIER}, 6) AS "{c}_prev_max"'
        for c in _LAGGED
    )
    + " FROM stays_v",
)
def lag_features(spark, d):
    rows = stays(spark, d).select("subject_id", "hadm_id", "admission_no", *_LAGGED)
    out = sequences.lag_features(rows, _LAGGED).drop(*_LAGGED)
    return rounded(out, *[c for c in out.columns if "_prev" in c])


_DECAYED = ["cost", "hospital_expire_flag"]


@query(
    "decayed_history",
    with_views("stays_v")
    + "SELECT t.hadm_id, t.admission_no, "
    + ", ".join(f"round(coalesce(sum(s.{c} * pow(CAST(0.618033988749895 AS DOUBLE), t.admission_no - 1 - s.admission_no)), 0), 6) AS {c}_decayed" for c in _DECAYED)
    + " FROM stays_v t LEFT JOIN stays_v s ON s.subject_id = t.subject_id AND s.admission_no < t.admission_no GROUP BY t.hadm_id, t.admission_no",
)
def decayed_history(spark, d):
    rows = stays(spark, d).select("subject_id", "hadm_id", "admission_no", *_DECAYED)
    out = sequences.decayed_history(rows, _DECAYED, factor=0.618033988749895, run=4)
    return rounded(out.select("hadm_id", "admission_no", *[f"{c}_decayed" for c in _DECAYED]), *[f"{c}_decayed" for c in _DECAYED])


@query(
    "pad_batches",
    with_views("stays_v")
    + ", s AS (SELECT subject_id, count(*) AS n FROM stays_v GROUP BY subject_id),"
    " b AS (SELECT *, (row_number() OVER (ORDER BY n, subject_id) - 1) // 64 AS batch FROM s)"
    " SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_rows, CAST(max(n) AS INT) AS batch_length, CAST(sum(n) AS BIGINT) AS real_cells,"
    " CAST(count(*) * max(n) AS BIGINT) AS cells, CAST(sum(subject_id * n) AS BIGINT) AS mark FROM b GROUP BY batch",
)
def pad_batches(spark, d):
    """Cells of each batch of sequences, padding included."""
    batches = sequences.padded_batches(_sequences(spark, d), len(_FEATURES))
    real = F.size(F.filter("mask", lambda m: m))
    return batches.groupBy("batch").agg(
        F.count("*").alias("n_rows"), F.max("batch_length").alias("batch_length"), F.sum(real).alias("real_cells"),
        F.sum(F.size("x")).alias("cells"), F.sum(F.col("subject_id") * real).alias("mark"),
    )


_IMPUTED = ["ER_LoS", "days_since_discharge"]


def _split_rows(spark, d):
    """Stays with ``is_train`` of their subject."""
    rows = stays(spark, d).select("hadm_id", "subject_id", "hospital_expire_flag", "race", *_IMPUTED)
    labels = adm.subject_labels(tables.admissions(spark, d).select("subject_id", "hospital_expire_flag"))
    split = adm.stratified_split(labels)
    train = adm.rows_of_subjects(rows, split.where("is_train"))
    return train, rows


_TRAIN_SQL = """
SELECT s.* FROM stays_v s WHERE s.subject_id IN (SELECT subject_id FROM (
  SELECT *, row_number() OVER (PARTITION BY hospital_expire_flag
                               ORDER BY md5('67-' || CAST(subject_id AS VARCHAR)), subject_id) AS rank_no,
         count(*) OVER (PARTITION BY hospital_expire_flag) AS n
  FROM (SELECT subject_id, max(hospital_expire_flag) AS hospital_expire_flag FROM admissions_v GROUP BY subject_id))
  WHERE rank_no <= CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT))
"""


@query(
    "impute_median",
    with_views("stays_v")
    + 'SELECT hadm_id, round(coalesce(s."ER_LoS", m.e), 6) AS "ER_LoS",'
    " round(coalesce(s.days_since_discharge, m.s), 6) AS days_since_discharge FROM stays_v s,"
    f' (SELECT median("ER_LoS") AS e, median(days_since_discharge) AS s FROM ({_TRAIN_SQL})) m',
)
def impute_median(spark, d):
    train, rows = _split_rows(spark, d)
    filled = scaling.impute(rows, scaling.learn_medians(train, _IMPUTED))
    return rounded(filled.select("hadm_id", *_IMPUTED), *_IMPUTED)


@query(
    "standardize",
    with_views("stays_v")
    + 'SELECT hadm_id, round((s."ER_LoS" - m.em) / m.es, 6) AS "ER_LoS",'
    " round((s.days_since_discharge - m.sm) / m.ss, 6) AS days_since_discharge FROM stays_v s,"
    ' (SELECT avg("ER_LoS") AS em, stddev_pop("ER_LoS") AS es, avg(days_since_discharge) AS sm,'
    f" stddev_pop(days_since_discharge) AS ss FROM ({_TRAIN_SQL})) m",
)
def standardize(spark, d):
    train, rows = _split_rows(spark, d)
    return rounded(scaling.standardize(train, rows, _IMPUTED).select("hadm_id", *_IMPUTED), *_IMPUTED)


@query(
    "center_scale_matrix",
    with_views("stays_v")
    + "SELECT hadm_id, round((age - avg(age) OVER ()) / stddev_samp(age) OVER (), 6) AS age,"
    " round((cost - avg(cost) OVER ()) / stddev_samp(cost) OVER (), 6) AS cost FROM stays_v",
)
def center_scale_matrix(spark, d):
    rows = adm.stay_features(adm.join_dimension(tables.admissions(spark, d), tables.patients(spark, d)))
    return rounded(scaling.center_scale_matrix(rows.select("hadm_id", "age", "cost"), ["age", "cost"]), "age", "cost")


def _weighed(n: str, s: str, overall: str) -> str:
    own = f"(1 / (1 + exp(-({n} - 20) / 10.0)))"
    return f"CASE WHEN {n} > 0 THEN {overall} * (1 - {own}) + ({s}) / ({n}) * {own} ELSE {overall} END"


@query(
    "target_encode",
    with_views("stays_v")
    + f"SELECT s.hadm_id, s.race, round(coalesce(e.v, o.v), 6) AS race_encoded FROM stays_v s LEFT JOIN (SELECT race, "
    + _weighed("count(*)", "sum(hospital_expire_flag)", f"(SELECT avg(hospital_expire_flag) FROM ({_TRAIN_SQL}))")
    + f" AS v FROM ({_TRAIN_SQL}) GROUP BY race) e ON s.race IS NOT DISTINCT FROM e.race,"
    f" (SELECT avg(hospital_expire_flag) AS v FROM ({_TRAIN_SQL})) o",
)
def target_encode(spark, d):
    train, rows = _split_rows(spark, d)
    return rounded(scaling.target_encode(train, rows.select("hadm_id", "race"), "race", "hospital_expire_flag"), "race_encoded")


_FOLDED_SQL = f"SELECT *, CAST('0x' || substr(md5('67-' || coalesce(CAST(subject_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 5 AS fold FROM ({_TRAIN_SQL})"


@query(
    "target_encode_cross_fitted",
    with_views("stays_v")
    + f"SELECT t.hadm_id, t.race, round(c.v, 6) AS race_encoded FROM ({_FOLDED_SQL}) t JOIN (SELECT f.race, f.fold, "
    + _weighed("count(t.hospital_expire_flag)", "coalesce(sum(t.hospital_expire_flag), 0)", f"(SELECT avg(o.hospital_expire_flag) FROM ({_FOLDED_SQL}) o WHERE o.fold <> f.fold)")
    + f" AS v FROM (SELECT DISTINCT race, fold FROM ({_FOLDED_SQL})) f LEFT JOIN ({_FOLDED_SQL}) t ON t.race IS NOT DISTINCT FROM f.race AND t.fold <> f.fold"
    " GROUP BY f.race, f.fold) c ON c.race IS NOT DISTINCT FROM t.race AND c.fold = t.fold",
)
def target_encode_cross_fitted(spark, d):
    """Training rows, each encoded from other folds' subjects."""
    train, _ = _split_rows(spark, d)
    encoded = scaling.target_encode_cross_fitted(train, "race", "hospital_expire_flag")
    return rounded(encoded.select("hadm_id", "race", "race_encoded"), "race_encoded")
