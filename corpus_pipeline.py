"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Toxic documents go, then those that fail the quality rules, then all but one of each near-duplicate group, then
those that hold a benchmark item; what is left is packed. Filtering stages return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontaminate, neardup, packing, repetition, toxicity
from wardline.llm.texts import others
from wardline.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The stages have no SQL form (trained model, rolling hashes, tokenizer); tests/llm compares them with brute force.
ORACLE_SQL = None


def _where(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], results: list[str], verdict: Column) -> DataFrame:
    """Rows of ``docs`` whose judged text passes; a column named like one of the ``results`` keeps its values."""
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    if len(others(docs, results)) == len(docs.columns):
        return judge(docs).where(verdict).select(*names)
    rows = docs.select(F.struct(*names).alias("_row"), F.col("text"))
    return judge(rows).where(verdict).select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labelled ones, does not call toxic."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.ToxicityOptions())
    return _where(docs, lambda rows: toxicity.score(rows, model), toxicity.RESULTS.names, F.col("predicted") == 0)


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _where(docs, repetition.quality_rules, repetition.RESULTS.names, F.col("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    return neardup.keep_one(docs, stage(neardup.near_duplicates(docs), "groups"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens."""
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_repetitive),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
