"""Join, set and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.prepared import CODE_LEVELS, grouped, stays
from wardline.catalog.registry import query, rounded
from wardline.catalog.views import with_views
from wardline.functions.clean import bucket_by_regex
from wardline.functions.scores import argmax_label, threshold_label
from wardline.operators import admissions as adm
from wardline.operators import codes, sequences, summaries, tests_of_difference as diff
from wardline.operators.codes import unnest_vector
from wardline.operators.columns import project_columns
from wardline.operators.metrics import sort_groups_by_size as sort_by_size
from wardline.operators.metrics import subgroup_classification
from wardline.session import stage
from wardline.sources import tables

_DIMENSION_SQL = (
    "SELECT a.hadm_id, a.subject_id, a.admission_type, p.gender, p.anchor_age, p.anchor_year, p.insurance"
    " FROM admissions_v a LEFT JOIN patients_v p ON a.subject_id = p.subject_id"
)


@query("join_left_dimension", with_views("admissions_v", "patients_v") + _DIMENSION_SQL)
def join_left_dimension(spark, d):
    patients = tables.patients(spark, d).select("subject_id", "gender", "anchor_age", "anchor_year", "insurance")
    return adm.join_dimension(tables.admissions(spark, d).select("hadm_id", "subject_id", "admission_type"), patients)


@query(
    "join_left_fanout_map",
    with_views("diagnoses_v", "gem_v")
    + "SELECT d.hadm_id, d.seq_num, d.icd_code, g.icd10cm FROM diagnoses_v d LEFT JOIN gem_v g"
    " ON d.icd_code = g.icd9cm WHERE d.icd_version = '9' AND g.no_map = '0' AND g.combination = '0'",
)
def join_left_fanout_map(spark, d):
    mapped = codes.map_codes(tables.diagnoses(spark, d), tables.code_map(spark, d))
    return mapped.select("hadm_id", "seq_num", "icd_code", "icd10cm")


@query(
    "join_left_normalized_key",
    with_views("diagnoses_v", "ccs_v")
    + "SELECT d.subject_id, d.hadm_id, d.seq_num, d.icd_code, c.ccs_code, c.ccs_description FROM diagnoses_v d"
    " LEFT JOIN ccs_v c ON trim(replace(replace(d.icd_code, '.', ''), '''', ''))"
    " = trim(replace(replace(c.icd_code, '.', ''), '''', '')) WHERE d.icd_version = '10'",
)
def join_left_normalized_key(spark, d):
    native = tables.diagnoses(spark, d).where("icd_version = '10'")
    return codes.group_codes(native, tables.code_groups(spark, d))


_PIVOT_COLUMNS = ", ".join(
    "CAST(count(*) FILTER (ccs_code = '{0}') AS BIGINT) AS \"{1}\"".format(c.replace("'", "''"), c)
    for c in CODE_LEVELS
)
_LISTED = ", ".join("'" + c.replace("'", "''") + "'" for c in CODE_LEVELS)
_OTHER = "count(*) FILTER (ccs_code IS NULL OR ccs_code NOT IN ({0})) AS other"
PIVOT_SQL = f"SELECT hadm_id, {_PIVOT_COLUMNS}, {_OTHER.format(_LISTED)} FROM grouped_v GROUP BY hadm_id"


@query(
    "join_left_from_pivot",
    with_views("grouped_v", "admissions_v")
    + f"SELECT p.*, a.subject_id, a.hospital_expire_flag, a.cost FROM ({PIVOT_SQL}) p"
    " LEFT JOIN admissions_v a ON p.hadm_id = a.hadm_id",
)
def join_left_from_pivot(spark, d):
    features = tables.admissions(spark, d).select("hadm_id", "subject_id", "hospital_expire_flag", "cost")
    return codes.attach_features(codes.count_pivot(grouped(spark, d), CODE_LEVELS), features)


VECTOR_SQL = (
    "SELECT ccs_code, i AS dim,"
    " CAST(CAST('0x' || substr(md5(ccs_code || '#' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE)"
    " / CAST(4294967296.0 AS DOUBLE) * CAST(0.2 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS value"
    " FROM (SELECT DISTINCT ccs_code FROM grouped_v), range(1, 31) AS r(i)"
)
_EMB_COLUMNS = ", ".join(
    f'round(max(CASE WHEN dim = {i} THEN m END), 6) AS "ccs_emb_{i}"' for i in range(1, 31)
)
EMBEDDING_SQL = (
    f"SELECT hadm_id, {_EMB_COLUMNS} FROM (SELECT hadm_id, dim, avg(value) AS m FROM grouped_v g"
    f" JOIN ({VECTOR_SQL}) v ON g.ccs_code = v.ccs_code GROUP BY hadm_id, dim) GROUP BY hadm_id"
)


def _embeddings(spark, d):
    rows = grouped(spark, d).select("hadm_id", "ccs_code")
    return codes.mean_vectors(rows, codes.init_code_vectors(codes.group_levels(tables.code_groups(spark, d))))


@query(
    "join_right_embeddings",
    with_views("grouped_v", "admissions_v")
    + f"SELECT e.*, a.subject_id, a.hospital_expire_flag FROM admissions_v a RIGHT JOIN ({EMBEDDING_SQL}) e"
    " ON a.hadm_id = e.hadm_id",
)
def join_right_embeddings(spark, d):
    wide = unnest_vector(_embeddings(spark, d))
    features = tables.admissions(spark, d).select("hadm_id", "subject_id", "hospital_expire_flag")
    return rounded(codes.attach_embeddings(features, wide), *[c for c in wide.columns if c != "hadm_id"])


@query(
    "join_code_vector_lookup",
    with_views("grouped_v")
    + "SELECT g.hadm_id, g.seq_num, g.ccs_code, round(v.value, 6) AS last_value, round(w.value, 6) AS first_value"
    f" FROM grouped_v g JOIN ({VECTOR_SQL}) v ON g.ccs_code = v.ccs_code AND v.dim = 30"
    f" JOIN ({VECTOR_SQL}) w ON g.ccs_code = w.ccs_code AND w.dim = 1",
)
def join_code_vector_lookup(spark, d):
    rows = grouped(spark, d).select("hadm_id", "seq_num", "ccs_code")
    vectors = codes.init_code_vectors(codes.group_levels(tables.code_groups(spark, d)))
    found = codes.lookup_vectors(rows, vectors)
    picked = found.select(
        "hadm_id", "seq_num", "ccs_code", F.col("vector")[29].alias("last_value"), F.col("vector")[0].alias("first_value")
    )
    return rounded(picked, "last_value", "first_value")


SPLIT_SQL = """
SELECT subject_id, hospital_expire_flag,
       rank_no <= CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT) AS is_train
FROM (SELECT *, row_number() OVER (PARTITION BY hospital_expire_flag
                                   ORDER BY md5('67-' || CAST(subject_id AS VARCHAR)), subject_id) AS rank_no,
             count(*) OVER (PARTITION BY hospital_expire_flag) AS n
      FROM (SELECT subject_id, max(hospital_expire_flag) AS hospital_expire_flag FROM admissions_v GROUP BY subject_id))
"""


def _split(spark, d):
    labels = adm.subject_labels(tables.admissions(spark, d).select("subject_id", "hospital_expire_flag"))
    return adm.stratified_split(labels)


@query(
    "join_semi_split",
    with_views("admissions_v")
    + f"SELECT hadm_id, subject_id FROM admissions_v WHERE subject_id IN (SELECT subject_id FROM ({SPLIT_SQL})"
    " WHERE is_train)",
)
def join_semi_split(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "subject_id")
    return adm.rows_of_subjects(rows, _split(spark, d).where("is_train"))


@query(
    "join_anti_split",
    with_views("admissions_v")
    + "SELECT hadm_id, subject_id FROM admissions_v a WHERE NOT EXISTS (SELECT 1 FROM"
    f" ({SPLIT_SQL}) s WHERE s.is_train AND s.subject_id IS NOT DISTINCT FROM a.subject_id)",
)
def join_anti_split(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "subject_id")
    return adm.rows_without_subjects(rows, _split(spark, d).where("is_train"))


@query(
    "join_attach_predictions",
    with_views("scored_v")
    + "SELECT s.doc_id, s.y AS true_label, round(s.score, 6) AS predicted_proba,"
    " CASE WHEN s.score >= 0.5 THEN 1 ELSE 0 END AS predicted_binary, l.toxic"
    " FROM scored_v s JOIN labels l ON s.doc_id = l.doc_id",
)
def join_attach_predictions(spark, d):
    scores = tables.scored(spark, d).select(
        "doc_id", F.col("y").alias("true_label"), F.col("score").alias("predicted_proba"),
        threshold_label(F.col("score"), 0.5).alias("predicted_binary"),
    )
    raw = tables.table(spark, d, "labels").select("doc_id", "toxic")
    return rounded(scores.join(raw, "doc_id"), "predicted_proba")


@query(
    "sort_subject_sequence",
    with_views("stays_v") + "SELECT subject_id, admission_no, hadm_id FROM stays_v ORDER BY ALL NULLS FIRST",
)
def sort_subject_sequence(spark, d):
    rows = stays(spark, d).select("subject_id", "admission_no", "hadm_id")
    return sequences.sort_subject_sequence(rows)


_FREQ = "SELECT {0}, count(*) AS n FROM admissions_v GROUP BY {0} ORDER BY n DESC, {0} ASC NULLS LAST LIMIT {1}"


@query(
    "topk_categories",
    with_views("admissions_v")
    + "SELECT * FROM (SELECT 'admission_type' AS feature, admission_type AS category, n FROM ("
    + _FREQ.format("admission_type", 2)
    + ")) UNION ALL SELECT * FROM (SELECT 'race' AS feature, race AS category, n FROM ("
    + _FREQ.format("race", 1)
    + "))",
)
def topk_categories(spark, d):
    rows = tables.admissions(spark, d)
    parts = [
        summaries.top_categories(rows, c, k).select(F.lit(c).alias("feature"), F.col(c).alias("category"), "n")
        for c, k in (("admission_type", 2), ("race", 1))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "limit_heatmap_rows",
    with_views("grouped_v", "admissions_v")
    + f"SELECT p.hadm_id, a.hospital_expire_flag, p.\"'C0'\", p.\"'C1'\", p.\"'C19'\" FROM ({PIVOT_SQL}) p"
    " JOIN admissions_v a ON p.hadm_id = a.hadm_id ORDER BY a.hospital_expire_flag, p.hadm_id LIMIT 1000",
)
def limit_heatmap_rows(spark, d):
    counts = codes.count_pivot(grouped(spark, d), CODE_LEVELS).select("hadm_id", "`'C0'`", "`'C1'`", "`'C19'`")
    wide = counts.join(tables.admissions(spark, d).select("hadm_id", "hospital_expire_flag"), "hadm_id")
    return diff.first_by_outcome(wide, 1000)


@query(
    "limit_preview",
    with_views("patients_v") + "SELECT subject_id, gender, insurance FROM patients_v ORDER BY subject_id LIMIT 6",
)
def limit_preview(spark, d):
    return tables.patients(spark, d).select("subject_id", "gender", "insurance").orderBy("subject_id").limit(6)


@query(
    "sort_groups_by_size",
    with_views("scored_v")
    + "SELECT grp, count(*) AS n_patients FROM scored_v GROUP BY grp ORDER BY n_patients DESC, grp LIMIT 20",
)
def sort_groups_by_size(spark, d):
    return sort_by_size(subgroup_classification(tables.scored(spark, d))).select("grp", "n_patients")


@query(
    "union_all_by_name",
    with_views("harmonised_v") + "SELECT subject_id, hadm_id, seq_num, icd_code, icd_version FROM harmonised_v",
)
def union_all_by_name(spark, d):
    return codes.union_codes(tables.diagnoses(spark, d), tables.code_map(spark, d))


@query(
    "intersect_overlap_count",
    with_views("admissions_v")
    + f"SELECT count(*) AS overlap FROM (SELECT subject_id FROM ({SPLIT_SQL}) WHERE is_train"
    f" INTERSECT SELECT subject_id FROM ({SPLIT_SQL}) WHERE NOT is_train)",
)
def intersect_overlap_count(spark, d):
    split = _split(spark, d)
    return adm.overlap_count(split.where("is_train"), split.where("NOT is_train"))


@query("stratified_group_split", with_views("admissions_v") + SPLIT_SQL)
def stratified_group_split(spark, d):
    return _split(spark, d)


@query("agg_count_pivot", with_views("grouped_v") + PIVOT_SQL)
def agg_count_pivot(spark, d):
    return codes.count_pivot(grouped(spark, d), CODE_LEVELS)


_FEW = CODE_LEVELS[:5]


@query(
    "count_pivot_listed",
    with_views("grouped_v")
    + "SELECT hadm_id, "
    + ", ".join("count(*) FILTER (ccs_code = '{0}') AS \"{1}\"".format(c.replace("'", "''"), c) for c in _FEW)
    + ", " + _OTHER.format(", ".join("'" + c.replace("'", "''") + "'" for c in _FEW)) + " FROM grouped_v GROUP BY hadm_id",
)
def count_pivot_listed(spark, d):
    """A few codes as columns; what they leave over is counted, not lost."""
    return codes.count_pivot(grouped(spark, d), _FEW)


_DICTIONARY_SQL = (
    "SELECT ccs_code, row_number() OVER (ORDER BY ccs_code) - 1 AS ccs_index FROM"
    " (SELECT DISTINCT ccs_code FROM grouped_v WHERE ccs_code IS NOT NULL)"
)


@query("code_dictionary", with_views("grouped_v") + _DICTIONARY_SQL)
def code_dictionary(spark, d):
    return codes.code_dictionary(grouped(spark, d))


@query(
    "count_vectors",
    with_views("grouped_v")
    + "SELECT hadm_id, string_agg(CAST(ccs_index AS VARCHAR) || ':' || CAST(n AS VARCHAR), ' ' ORDER BY ccs_index) AS cells,"
    " CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (ccs_index = 3), 0) AS BIGINT) AS n_3 FROM"
    f" (SELECT hadm_id, i.ccs_index, count(*) AS n FROM grouped_v g JOIN ({_DICTIONARY_SQL}) i ON g.ccs_code = i.ccs_code"
    " GROUP BY hadm_id, i.ccs_index) GROUP BY hadm_id",
)
def count_vectors(spark, d):
    """Sparse rows of the count matrix, written as text."""
    rows = stage(grouped(spark, d).select("hadm_id", "ccs_code"), "grouped")
    vectors = codes.count_vectors(rows, codes.code_dictionary(rows))
    cells = F.array_join(F.transform(F.arrays_zip("indices", "counts"), lambda c: F.concat_ws(":", c["indices"].cast("string"), c["counts"].cast("string"))), " ")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n) + F.col("n_null") + F.col("n_unknown")
    return vectors.select("hadm_id", cells.alias("cells"), total.alias("total"), codes.count_at(3).alias("n_3"))


@query(
    "agg_mean_vector",
    with_views("grouped_v")
    + "SELECT hadm_id, CAST(dim AS INT) AS dim, round(avg(value), 6) AS mean FROM grouped_v g"
    f" JOIN ({VECTOR_SQL}) v ON g.ccs_code = v.ccs_code GROUP BY hadm_id, dim",
)
def agg_mean_vector(spark, d):
    long = _embeddings(spark, d).select("hadm_id", F.posexplode_outer("embedding").alias("dim", "mean"))
    return rounded(long.withColumn("dim", F.col("dim") + 1), "mean")


@query("unnest_vector", with_views("grouped_v") + EMBEDDING_SQL)
def unnest_vector_query(spark, d):
    wide = unnest_vector(_embeddings(spark, d))
    return rounded(wide, *[c for c in wide.columns if c != "hadm_id"])


@query(
    "init_code_vectors",
    with_views("grouped_v")
    + f"SELECT ccs_code, CAST(dim AS INT) AS dim, round(value, 6) AS value FROM ({VECTOR_SQL})",
)
def init_code_vectors(spark, d):
    vectors = codes.init_code_vectors(codes.code_levels(grouped(spark, d)))
    long = vectors.select("ccs_code", F.posexplode_outer("vector").alias("dim", "value"))
    return rounded(long.withColumn("dim", F.col("dim") + 1), "value")


@query(
    "win_dense_code_index",
    with_views("grouped_v")
    + "SELECT g.hadm_id, g.seq_num, g.ccs_code, i.ccs_index FROM grouped_v g JOIN (SELECT ccs_code,"
    " row_number() OVER (ORDER BY ccs_code) - 1 AS ccs_index FROM (SELECT DISTINCT ccs_code FROM grouped_v)) i"
    " ON g.ccs_code = i.ccs_code",
)
def win_dense_code_index(spark, d):
    return codes.dense_code_index(grouped(spark, d).select("hadm_id", "seq_num", "ccs_code"))


@query(
    "one_hot_encode",
    with_views("admissions_v")
    + "SELECT hadm_id, "
    + ", ".join(
        f"CASE WHEN admission_type = '{v}' THEN 1 ELSE 0 END AS \"admission_type_{v}\""
        for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + " FROM admissions_v",
)
def one_hot_encode(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", "admission_type")
    levels = codes.level_list(rows, "admission_type")
    return adm.one_hot_encode(rows, {"admission_type": levels})


@query(
    "argmax_label",
    with_views("admissions_v")
    + "SELECT hadm_id, CASE race WHEN 'White' THEN 'race_White' WHEN 'Black' THEN 'race_Black'"
    " WHEN 'Asian' THEN 'race_Asian' ELSE 'race_UNKNOWN' END AS race_label FROM (SELECT hadm_id, CASE"
    " WHEN race ILIKE '%white%' THEN 'White' WHEN race ILIKE '%black%' THEN 'Black'"
    " WHEN race ILIKE '%asian%' THEN 'Asian' ELSE race END AS race FROM admissions_v)",
)
def argmax_label_query(spark, d):
    rows = tables.admissions(spark, d).select("hadm_id", bucket_by_regex(F.col("race")).alias("race"))
    wide = adm.one_hot_encode(rows, {"race": ["White", "Black", "Asian"]})
    flags = ["race_White", "race_Black", "race_Asian"]
    return project_columns(wide.withColumn("race_label", argmax_label(flags)), ["hadm_id", "race_label"])
