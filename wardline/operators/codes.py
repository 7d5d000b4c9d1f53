"""Diagnosis codes: mapping to one code system, grouping, counting and vectors."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardline.functions.clean import UNKNOWN_CODE, default_code_label, normalize_code
from wardline.operators.columns import filter_conjunction, quoted
from wardline.plans.ordered import number_rows
from wardline.plans.skew import join_lookup
from wardline.session import new_path, stage

# Size and range of the initial code vectors, and the flags of a usable mapping.
VECTOR_SIZE = 30
VECTOR_RANGE = 0.1
USABLE_MAPPING = {"no_map": "0", "combination": "0"}

HARMONISED = ["subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"]

OTHER_CODES = "other"


def map_codes(diagnoses: DataFrame, code_map: DataFrame) -> DataFrame:
    """Version-9 rows with every usable version-10 code (one-to-many); rows without one disappear."""
    side = code_map.withColumnRenamed("icd9cm", "icd_code")
    joined = join_lookup(diagnoses.where("icd_version = '9'"), side, ["icd_code"], "left")
    return filter_conjunction(joined, USABLE_MAPPING)


def union_codes(diagnoses: DataFrame, code_map: DataFrame) -> DataFrame:
    """Native version-10 rows followed by the mapped version-9 rows; duplicates are kept."""
    native = diagnoses.where("icd_version = '10'").select(*HARMONISED)
    mapped = map_codes(diagnoses, code_map).select(
        "subject_id", "hadm_id", "seq_num", F.col("icd10cm").alias("icd_code"), F.lit("10").alias("icd_version")
    )
    return native.unionByName(mapped)


def harmonise_codes(diagnoses: DataFrame, code_map: DataFrame) -> DataFrame:
    """The rows of :func:`union_codes` from one pass over the diagnoses.

    Only version-9 rows have a join key, so version-10 rows pass the left join untouched.
    """
    usable = filter_conjunction(code_map, USABLE_MAPPING).select(F.col("icd9cm").alias("_code9"), "icd10cm")
    keyed = diagnoses.withColumn("_code9", F.when(F.col("icd_version") == "9", F.col("icd_code")))
    native = F.col("icd_version") == "10"
    return (
        join_lookup(keyed, usable, ["_code9"], "left")
        .where(native | F.col("icd10cm").isNotNull())
        .select(
            "subject_id",
            "hadm_id",
            "seq_num",
            F.when(native, F.col("icd_code")).otherwise(F.col("icd10cm")).alias("icd_code"),
            F.lit("10").alias("icd_version"),
        )
    )


def group_codes(diagnoses: DataFrame, groups: DataFrame) -> DataFrame:
    """Left join on the cleaned code; rows without a group keep a null group."""
    side = groups.select(
        normalize_code(F.col("icd_code")).alias("icd_code_clean"), "ccs_code", "ccs_description"
    )
    cleaned = diagnoses.withColumn("icd_code_clean", normalize_code(F.col("icd_code")))
    return join_lookup(cleaned, side, ["icd_code_clean"], "left").select(
        "subject_id", "hadm_id", "seq_num", "icd_code", "ccs_code", "ccs_description"
    )


def grouped_diagnoses(diagnoses: DataFrame, code_map: DataFrame, groups: DataFrame) -> DataFrame:
    """Both steps, with the missing group named."""
    grouped = group_codes(harmonise_codes(diagnoses, code_map), groups)
    return grouped.withColumn("ccs_code", default_code_label(F.col("ccs_code")))


def code_levels(df: DataFrame, column: str = "ccs_code") -> DataFrame:
    return df.select(column).distinct()


def group_levels(groups: DataFrame) -> DataFrame:
    """Every code the grouping can give, with the label of ungrouped rows; small and independent of the rows."""
    unknown = groups.sparkSession.range(1).select(F.lit(UNKNOWN_CODE).alias("ccs_code"))
    return groups.select("ccs_code").unionByName(unknown).distinct()


def level_list(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct values as column names, for columns of categories. Codes of any number go to ``count_vectors``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels, too many to be columns; see count_vectors")
    return sorted(found)


def code_dictionary(df: DataFrame, column: str = "ccs_code", name: str = "ccs_index") -> DataFrame:
    """``(code, position)`` of every code that occurs, positions from 0 in the codes' order; nulls have none."""
    return number_rows(df.select(column).where(F.col(column).isNotNull()).distinct(), [], [column], name)


def dense_code_index(df: DataFrame, column: str = "ccs_code", name: str = "ccs_index") -> DataFrame:
    """Zero-based position of each row's code among the sorted codes. The rows are written once and read twice."""
    rows = stage(df, "rows")
    return join_lookup(rows, code_dictionary(rows, column, name), [column], "left")


def count_pivot(
    df: DataFrame, levels: list[str], key: str = "hadm_id", column: str = "ccs_code", other: str | None = OTHER_CODES
) -> DataFrame:
    """One row per key and one count column per listed code, missing as 0; all further codes, and null, count as ``other``.

    For a list of codes that fits a table's columns; ``count_vectors`` takes any number of codes. Without ``other``
    a code outside the list is an error when the rows are read: nothing is lost silently.
    """
    if other is not None and other in levels:
        raise ValueError(f"{other} is a code; name the column of further codes otherwise")
    known = F.col(column).isin(levels) if levels else F.lit(False)
    if other is None:
        refused = F.raise_error(F.concat(F.lit("code outside the list: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
        place = F.when(known, F.col(column)).otherwise(refused)
    else:
        place = F.when(known, F.col(column)).otherwise(F.lit(other))
    columns = [*levels, *([other] if other is not None else [])]
    coded = df.select(key, place.alias("_code"))
    return coded.groupBy(key).agg(*[F.count_if(F.col("_code") == c).alias(c) for c in columns])


def count_vectors(df: DataFrame, dictionary: DataFrame, key: str = "hadm_id", column: str = "ccs_code", name: str = "ccs_index") -> DataFrame:
    """One sparse row per key: ``indices`` of its codes in the dictionary, ascending, and their ``counts``.

    There is no limit on the number of codes, and none is left out: a null code is the key's ``n_null``, a code that the
    dictionary lacks its ``n_unknown``, as for rows that came after the dictionary was made.
    """
    counts = count_long(df, key, column, "_n")
    indexed = join_lookup(counts, dictionary.select(column, F.col(name).alias("_index")), [column], "left")
    cell = F.when(F.col("_index").isNotNull(), F.struct(F.col("_index").cast("int").alias("i"), F.col("_n").alias("n")))
    rows = indexed.groupBy(key).agg(
        F.array_sort(F.collect_list(cell)).alias("_cells"),  # at most one cell for each code
        F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("_n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("_index").isNull() & F.col(column).isNotNull(), F.col("_n"))), F.lit(0)).alias("n_unknown"),
    )
    return rows.select(key, F.col("_cells.i").alias("indices"), F.col("_cells.n").alias("counts"), "n_null", "n_unknown")


def count_at(index: Column | int) -> Column:
    """The count of one dictionary position in the rows of ``count_vectors``, 0 where it does not occur."""
    place = F.array_position("indices", index if isinstance(index, Column) else F.lit(index))
    return F.coalesce(F.get("counts", (place - 1).cast("int")), F.lit(0))


def as_sparse_features(vectors: DataFrame, size: int, name: str = "features") -> DataFrame:
    """The same rows with a Spark ML sparse vector of ``size`` positions instead of the two arrays.

    The vector's stored form is built by column expressions and read back under its type, so no row passes through Python.
    """
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("indices").alias("indices"),
        F.transform("counts", lambda n: n.cast("double")).alias("values"),
    )
    kept = [c for c in vectors.columns if c not in ("indices", "counts")]
    path = new_path(vectors.sparkSession, "sparse")
    rows = vectors.select(*[quoted(c) for c in kept], stored.alias(name))
    rows.write.parquet(path)
    schema = StructType([*[rows.schema[c] for c in kept], StructField(name, VectorUDT())])
    return vectors.sparkSession.read.schema(schema).parquet(path)


def count_long(df: DataFrame, key: str = "hadm_id", column: str = "ccs_code", name: str = "n") -> DataFrame:
    """The same counts in long form: only pairs that occur."""
    return df.groupBy(key, column).agg(F.count(F.lit(1)).alias(name))


def _hash_uniform(code: Column, dim: int) -> Column:
    """Uniform number in [-range, range) that depends on the code and the dimension only."""
    head = F.conv(F.substring(F.md5(F.concat(code, F.lit(f"#{dim}"))), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0) * F.lit(2 * VECTOR_RANGE) - F.lit(VECTOR_RANGE)


def init_code_vectors(levels: DataFrame, column: str = "ccs_code", size: int = VECTOR_SIZE) -> DataFrame:
    """``(code, vector)``: reproducible on any cluster without a random stream."""
    vector = F.array(*[_hash_uniform(F.col(column), i) for i in range(1, size + 1)])
    return levels.select(column, vector.alias("vector"))


def lookup_vectors(df: DataFrame, vectors: DataFrame, column: str = "ccs_code") -> DataFrame:
    return join_lookup(df, vectors, [column], "inner")


def mean_vectors(
    df: DataFrame, vectors: DataFrame, key: str = "hadm_id", column: str = "ccs_code", size: int = VECTOR_SIZE
) -> DataFrame:
    """Element-wise mean of the code vectors per key; a code counts as often as it occurs.

    One sum per position in a single hash aggregate, combined map-side: the vectors are not shuffled
    and rows are not multiplied by the vector size.
    """
    rows = lookup_vectors(df.select(key, column), vectors, column)
    sums = [F.sum(F.get("vector", F.lit(i))).alias(f"_s{i}") for i in range(size)]
    summed = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *sums)
    return summed.select(key, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(size)]).alias("embedding"))


def unnest_vector(
    df: DataFrame, column: str = "embedding", prefix: str = "ccs_emb_", size: int = VECTOR_SIZE
) -> DataFrame:
    others = [quoted(c) for c in df.columns if c != column]
    return df.select(*others, *[F.col(column)[i].alias(f"{prefix}{i + 1}") for i in range(size)])


def attach_features(counts: DataFrame, features: DataFrame, key: str = "hadm_id") -> DataFrame:
    """The diagnosis side drives: admissions without a diagnosis are not in the result."""
    return counts.join(features, key, "left")


def attach_embeddings(features: DataFrame, embeddings: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Right join: one row per embedding, with or without an admission."""
    return features.join(embeddings, key, "right")
