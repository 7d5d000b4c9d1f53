"""End-to-end plan: raw tables to the merged table, the two feature matrices and the subject split.

Large intermediate results that several outputs read are staged as Parquet in the shared folder, so
each is computed once and a lost executor costs a re-read instead of the whole lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType

from wardline.functions import clean
from wardline.operators import admissions as adm
from wardline.operators import codes, models, scaling
from wardline.operators.columns import drop_columns, quoted, unpivot_flags
from wardline.operators.metrics import DEFAULT_THRESHOLD, subgroup_classification
from wardline.plans.skew import HeavyKeys, find_heavy
from wardline.session import stage
from wardline.sources.csv import sink_csv

# Time columns, and the columns that are not features.
ADMISSION_TIMES = ("admittime", "dischtime", "deathtime", "edregtime", "edouttime")
PATIENT_TIMES = ("dod", "anchor_year")
NOT_FEATURES = (
    "admittime", "dischtime", "edregtime", "edouttime", "deathtime", "anchor_age", "anchor_year_group",
    "anchor_year", "admit_provider_id", "dod", "discharge_location",
)
LABEL = "hospital_expire_flag"


def _parse_times(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    texts = [c for c, kind in df.dtypes if c in names and kind == "string"]
    return df.withColumns({c: clean.parse_time(clean.null_if_empty(F.col(c))) for c in texts})


def _present(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


def merge_and_clean(admissions: DataFrame, patients: DataFrame, threshold: float = adm.RARE_SHARE) -> DataFrame:
    """One row per admission: cleaned categories, parsed times, stay and history features.

    Categories are cleaned in a fixed order: unknown words, race buckets, language flag, rare values.
    """
    return _merge(admissions, patients, threshold)[0]


def _merge(admissions: DataFrame, patients: DataFrame, threshold: float) -> tuple[DataFrame, dict[str, adm.Levels], HeavyKeys | None]:
    """The merged rows, the levels of their categories and their heavy subjects."""
    heavy = find_heavy(admissions, ["subject_id"])
    history = adm.admission_history(_parse_times(admissions, ADMISSION_TIMES), heavy)
    long = adm.join_dimension(history, _parse_times(patients, PATIENT_TIMES), heavy)
    long = adm.normalize_categories(long, _present(long, adm.CATEGORIES))
    long = long.withColumns(
        {
            "gender": clean.encode_gender(F.col("gender")),
            "race": clean.bucket_by_regex(F.col("race")),
            "language": clean.encode_language(F.col("language")),
        }
    )
    long = adm.stay_features(long).withColumn(
        "days_until_death", clean.days_until_death(F.col("admittime"), F.col("dod"), F.col("deathtime"))
    )
    long = stage(long, "long")
    categories = _present(long, adm.CATEGORIES)
    levels = adm.common_levels(long, categories, threshold)
    return adm.bin_rare_categories(long, categories, threshold, levels), levels, heavy


@dataclass(frozen=True)
class Cohort:
    merged: DataFrame
    train: DataFrame
    test: DataFrame
    train_wide: DataFrame
    test_wide: DataFrame
    dictionary: DataFrame

    def write(self, folder: str, as_csv: bool = False) -> None:
        """Each table below ``folder``; Parquet, or CSV for exchange (arrays as JSON text)."""
        for name in ("train", "test", "train_wide", "test_wide", "merged", "dictionary"):
            df = getattr(self, name)
            if as_csv:
                arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
                sink_csv(df.withColumns({c: F.to_json(c) for c in arrays}), f"{folder}/{name}.csv")
            else:
                df.write.parquet(f"{folder}/{name}.parquet")


def build_cohort(
    admissions: DataFrame, patients: DataFrame, diagnoses: DataFrame, code_map: DataFrame, groups: DataFrame,
    threshold: float = adm.RARE_SHARE, share: float = adm.TRAIN_SHARE, code_columns: list[str] | None = None,
) -> Cohort:
    """All tables. The wide matrix holds each admission's code counts as sparse arrays over ``dictionary``, whatever the
    number of codes; ``code_columns`` asks for a count column for each listed code and one for all others instead.
    """
    merged, levels, heavy = _merge(admissions, patients, threshold)
    grouped = stage(codes.grouped_diagnoses(diagnoses, code_map, groups).select("hadm_id", "ccs_code"), "grouped")
    wide = adm.one_hot_encode(merged, {c: v.names() for c, v in levels.items()})
    wide = drop_columns(wide, list(NOT_FEATURES))

    vectors = codes.init_code_vectors(codes.group_levels(groups))
    embeddings = codes.mean_vectors(grouped, vectors)
    dictionary = stage(codes.code_dictionary(grouped), "dictionary")
    counts = codes.count_pivot(grouped, code_columns) if code_columns else codes.count_vectors(grouped, dictionary)

    # the split needs ids and labels only; it meets the admissions before they get the matrices' many columns
    keys = codes.attach_embeddings(wide.select("hadm_id", "subject_id", LABEL), embeddings.select("hadm_id"))
    labels = stage(adm.subject_labels(keys, LABEL), "labels")
    split = stage(adm.stratified_split(labels, label=LABEL, share=share).select("subject_id", "is_train"), "split")
    wide = stage(adm.attach_split(wide, split, heavy=heavy), "features")
    nobody = split.where("subject_id IS NULL").first()  # the subject of diagnoses without an admission
    with_split = {"is_train": F.coalesce(F.col("is_train"), F.lit(bool(nobody and nobody["is_train"])))}
    embedded = codes.attach_embeddings(wide, codes.unnest_vector(embeddings))
    rows = stage(embedded.withColumns(with_split), "matrix", "is_train")
    wide_rows = stage(codes.attach_features(counts, wide).withColumns(with_split), "wide", "is_train")

    def part(df: DataFrame, is_train: bool) -> DataFrame:
        return df.where(F.col("is_train") == F.lit(is_train)).drop("is_train")

    return Cohort(merged, part(rows, True), part(rows, False), part(wide_rows, True), part(wide_rows, False), dictionary)


def _null_columns(df: DataFrame, columns: list[str]) -> tuple[set[str], set[str]]:
    """Columns with a null in some row, and those with a value in no row, from one pass."""
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(quoted(c))) for c in columns]).first()
    known = dict(zip(columns, counts[1:], strict=True))
    return {c for c, n in known.items() if n < counts[0]}, {c for c, n in known.items() if n == 0}


def subgroup_performance(
    cohort: Cohort, label: str = "hospital_expire_flag", group: str = "race", threshold: float = DEFAULT_THRESHOLD,
    leaks: tuple[str, ...] = ("LoS", "days_until_death"), **params,
) -> DataFrame:
    """Outcome trees fitted on the training matrix and judged on the test matrix, by the one-hot flags of ``group``.

    Rows without a label are left out by name, nulls take the training medians, columns without any training value are left out, and
    ``leaks`` are columns known only after the outcome.
    """
    train, test = (models.labelled(df, label) for df in (cohort.train, cohort.test))
    apart = {"hadm_id", "subject_id", label, *leaks}
    numbers = (NumericType, BooleanType)
    features = [f.name for f in train.schema if f.name not in apart and isinstance(f.dataType, numbers)]
    nulls, empty = _null_columns(train, features)
    features = [c for c in features if c not in empty]  # a column without a training value says nothing
    nulls |= _null_columns(test, features)[0]
    medians = scaling.learn_medians(train, [c for c in features if c in nulls]) if nulls & {*features} else {}
    values = {c: medians.get(c) for c in features}  # a column without nulls needs none
    weighted = stage(models.add_class_weight(scaling.impute(train, values), label), "train")
    model = models.fit_outcome_trees(weighted, features, label, **params)
    scored = models.score_batch(model, scaling.impute(test, values), threshold)
    return subgroup_table(scored, label, group, threshold)


def subgroup_table(scored: DataFrame, label: str = "hospital_expire_flag", group: str = "race", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Performance of ``score`` by the one-hot flags of ``group``, in rows of a matrix; rows without a label are left out."""
    flags = [c for c in scored.columns if c.startswith(f"{group}_")]
    known = models.labelled(scored, label)
    judged = stage(unpivot_flags(known, flags, group, ["subject_id", label, "score"]), "scored")
    return subgroup_classification(judged, group, label, "score", unit="subject_id", threshold=threshold)
