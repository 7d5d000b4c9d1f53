"""Role tables after the usual first steps, shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import clean
from wardline.operators import admissions as adm
from wardline.operators import codes
from wardline.plans.skew import find_heavy
from wardline.sources import tables

# The code groups of the bundled tables, so that wide tables have a stable schema.
CODE_LEVELS = sorted([f"'C{i}'" for i in range(20)]) + ["Unknown_CCS"]
RACE_LEVELS = ["Asian", "Black", "Hispanic", "Unknown/Other", "White"]


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return codes.grouped_diagnoses(
        tables.diagnoses(spark, d), tables.code_map(spark, d), tables.code_groups(spark, d)
    )


def stays(spark: SparkSession, d: str) -> DataFrame:
    """Admissions with their history, subject and stay features.

    The history needs admission columns only, so its shuffle runs before the subject columns are joined
    on; a shuffled join on the same key then finds the rows where it needs them.
    """
    rows = tables.admissions(spark, d)
    heavy = find_heavy(rows, ["subject_id"])
    history = adm.admission_history(rows, heavy)
    return adm.stay_features(adm.join_dimension(history, tables.patients(spark, d), heavy))


def race_bucket(df: DataFrame) -> DataFrame:
    """Race after both cleaning steps; what matches no pattern is unknown.

    One step after the other: nested, a step's expression would be evaluated for each of its uses in the next.
    """
    race = F.col("race")
    for step in (clean.normalize_unknown, clean.bucket_by_regex, lambda c: F.when(c.isin(RACE_LEVELS), c).otherwise(F.lit(clean.UNKNOWN))):
        df = df.withColumn("race", step(race))
    return df
