"""Admissions: joining subjects, cleaning, stay features, history windows and the subject split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import clean
from wardline.operators.columns import quoted
from wardline.plans.ordered import number_rows, ordered_window
from wardline.plans.skew import FIND, HeavyKeys, join_lookup

# The cleaned categories, the share of rows below which a category is rare,
# the share of subjects used for training, and the seed of every hash-based choice.
CATEGORIES = ("race", "admission_type", "admission_location", "insurance", "language", "marital_status")
RARE_SHARE = 0.01
TRAIN_SHARE = 0.8
SEED = 67

HISTORY_ORDER = ["admittime", "hadm_id"]


def join_dimension(
    admissions: DataFrame, patients: DataFrame, heavy: HeavyKeys | None | str = FIND
) -> DataFrame:
    """Admissions with their subject's columns; admissions of unknown subjects stay."""
    return join_lookup(admissions, patients, ["subject_id"], "left", heavy=heavy)


def normalize_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean.normalize_unknown(F.col(c).cast("string")) for c in columns})


@dataclass(frozen=True)
class Levels:
    """Common values of a column, sorted, and whether rarer values exist."""

    common: list[str]
    has_rare: bool

    def names(self) -> list[str]:
        """Values of the column once its rare values are merged."""
        return sorted({*self.common, *([clean.UNKNOWN] if self.has_rare else [])})


def common_levels(df: DataFrame, columns: list[str], threshold: float = RARE_SHARE) -> dict[str, Levels]:
    """Values of each column that hold at least ``threshold`` of all rows, found in one pass.

    A column cannot have more than ``1 / threshold`` such values, so the lists stay small whatever
    the data size. Null counts towards the rows but is never a value.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "_at", "_value")
    counts = long.groupBy("_at", "_value").agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.where(F.col("_at") == columns[0]).agg(F.sum("_n").alias("_rows"))
    is_common = F.col("_n") >= F.lit(threshold) * F.col("_rows")
    found = (
        counts.where(F.col("_value").isNotNull())
        .withColumn("_rows", rows.scalar())
        .groupBy("_at")
        .agg(F.collect_list(F.when(is_common, F.col("_value"))).alias("common"), F.bool_or(~is_common).alias("rare"))
        .collect()
    )
    levels = {r["_at"]: Levels(sorted(r["common"]), r["rare"]) for r in found}
    return {c: levels.get(c, Levels([], False)) for c in columns}


def bin_rare_categories(
    df: DataFrame, columns: list[str], threshold: float = RARE_SHARE, levels: dict[str, Levels] | None = None
) -> DataFrame:
    """Values seen in fewer than ``threshold`` of the rows become the unknown label; nulls stay null."""
    levels = levels or common_levels(df, columns, threshold)

    def binned(c: str):
        value = F.col(c).cast("string")
        return F.when(value.isNull() | value.isin(levels[c].common), value).otherwise(F.lit(clean.UNKNOWN))

    return df.withColumns({c: binned(c) for c in columns})


def stay_features(df: DataFrame) -> DataFrame:
    """Age, length of stay and emergency stay in days, with negative durations repaired."""
    stay = clean.days_between(F.col("admittime"), F.col("dischtime"))
    emergency = clean.days_between(F.col("edregtime"), F.col("edouttime"))
    return df.withColumns(
        {
            "age": clean.age_at(F.col("admittime"), clean.parse_time(F.col("anchor_year")), F.col("anchor_age")),
            "LoS": clean.clamp_to_zero(stay),
            "ER_LoS": clean.drop_negative(emergency),
        }
    )


def admission_history(df: DataFrame, heavy: HeavyKeys | None | str = FIND) -> DataFrame:
    """Admission number and days since the previous discharge; both share one sort."""
    numbered = ordered_window(
        df, ["subject_id"], HISTORY_ORDER, row_number="admission_no", lag={"_previous": "dischtime"}, heavy=heavy
    )
    gap = clean.days_between(F.col("_previous"), F.col("admittime"))
    return numbered.withColumn("days_since_discharge", gap).drop("_previous")


def one_hot_encode(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """A 0/1 column ``column_value`` per level, the sources dropped; null gives null in every column."""
    flags = {
        f"{c}_{v}": F.when(F.col(c) == v, 1).when(F.col(c).isNotNull(), 0) for c, vs in levels.items() for v in vs
    }
    kept = [quoted(c) for c in df.columns if c not in levels]
    return df.select(*kept, *[e.alias(name) for name, e in flags.items()])


def subject_labels(df: DataFrame, label: str = "hospital_expire_flag") -> DataFrame:
    """One row per subject with the largest label; the null subject counts as one."""
    return df.groupBy("subject_id").agg(F.max(label).alias(label))


def stratified_split(
    subjects: DataFrame, key: str = "subject_id", label: str = "hospital_expire_flag",
    share: float = TRAIN_SHARE, seed: int = SEED,
) -> DataFrame:
    """Adds ``is_train``: within each label exactly the rounded share of subjects, in hash order.

    A label holds most subjects; they are numbered by one range shuffle over label and hash.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = subjects.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}-"), text)))
    ranked = number_rows(hashed, [label], ["_order", key], "_rank", "_size")
    quota = F.bround(F.col("_size") * F.lit(share))
    return ranked.withColumn("is_train", F.col("_rank") < quota).drop("_order", "_rank", "_size")


def attach_split(
    df: DataFrame, split: DataFrame, key: str = "subject_id", heavy: HeavyKeys | None | str = FIND
) -> DataFrame:
    """Adds the subject's ``is_train`` to every row; a subject outside the split is not in training."""
    joined = join_lookup(df, split.select(key, "is_train"), [key], "left", null_safe=True, heavy=heavy)
    return joined.withColumn("is_train", F.coalesce(F.col("is_train"), F.lit(False)))


def rows_of_subjects(df: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose subject is listed; a null subject matches a listed null."""
    return join_lookup(df, subjects.select(key), [key], "left_semi", null_safe=True)


def rows_without_subjects(df: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose subject is not listed; a null in the list does not empty the result."""
    return join_lookup(df, subjects.select(key), [key], "left_anti", null_safe=True)


def overlap_count(left: DataFrame, right: DataFrame, key: str = "subject_id") -> DataFrame:
    """Number of distinct subjects present on both sides."""
    both = left.select(key).intersect(right.select(key))
    return both.agg(F.count(F.lit(1)).alias("overlap"))
