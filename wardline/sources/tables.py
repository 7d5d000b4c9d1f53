"""The bundled tables and the clinical roles they play.

Role views give the generic tables the shape (and the dirt, ties and orphans) of patients,
admissions, diagnoses, a code map, a code grouping, scored rows and predicted rows. Every row of the
tables is used: orphans are made by giving some rows a key that nothing else has, not by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.plans.skew import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS subject_id",
        "CASE c_custkey % 7 WHEN 0 THEN 'U' WHEN 1 THEN 'M' WHEN 3 THEN 'M' WHEN 5 THEN 'M' ELSE 'F' END AS gender",
        "CAST(20 + c_custkey % 60 AS INT) AS anchor_age",
        "CAST(1990 + c_custkey % 5 AS STRING) AS anchor_year",
        "CASE WHEN c_custkey % 13 = 0 THEN '2001-12-31' ELSE '' END AS dod",
        "c_mktsegment AS insurance",
        "c_nationkey AS nation",
    )


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    race = """CASE o_orderkey % 12
        WHEN 0 THEN 'WHITE' WHEN 1 THEN 'WHITE - OTHER EUROPEAN' WHEN 2 THEN 'BLACK/AFRICAN AMERICAN'
        WHEN 3 THEN 'ASIAN - CHINESE' WHEN 4 THEN 'HISPANIC/LATINO - DOMINICAN' WHEN 5 THEN 'CAUCASIAN'
        WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN 'UNABLE TO OBTAIN' WHEN 9 THEN 'PORTUGUESE'
        WHEN 10 THEN 'white' ELSE 'Another' END"""
    hours = "timestampadd(HOUR, CAST(({}) AS INT), o_orderdate)"
    return table(spark, folder, "orders").selectExpr(
        # negative: an admission without diagnoses, and diagnoses without their admission
        "CASE WHEN o_orderkey % 97 = 5 THEN -o_orderkey ELSE o_orderkey END AS hadm_id",
        "o_custkey AS subject_id",
        "o_orderdate AS admittime",
        "timestampadd(HOUR, CAST((o_orderkey % 24) AS INT),"
        " timestampadd(DAY, CAST((o_orderkey % 30 - 1) AS INT), o_orderdate)) AS dischtime",
        f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {hours.format('-(o_orderkey % 12)')} END AS edregtime",
        f"CASE WHEN o_orderkey % 3 = 0 THEN NULL"
        f" ELSE {hours.format('o_orderkey % 10 - 1 - o_orderkey % 12')} END AS edouttime",
        "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag",
        f"{race} AS race",
        "o_orderpriority AS admission_type",
        "CASE o_orderkey % 4 WHEN 0 THEN 'English' WHEN 1 THEN 'english' WHEN 2 THEN '' ELSE 'Spanish' END"
        " AS language",
        "CASE WHEN o_orderkey % 11 = 0 THEN '2001-11-30 08:30:00' ELSE '' END AS deathtime",
        "CASE o_orderkey % 4 WHEN 0 THEN '1999' WHEN 1 THEN ' 1999-03-04 '"
        " WHEN 2 THEN '1999-03-04 05:06:07' ELSE 'bad' END AS raw_time",
        "o_totalprice AS cost",
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    """Lines joined to the part list and to their order (both large, on the order key).

    The rows lie by order, as many in a task as :func:`spread` allows: what is counted for each admission later needs
    no shuffle, so those counts are bounded by the same number.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_partkey")
    heads = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_type")
    rows = lines.count()
    coded = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return (
        spread(coded, rows, "l_orderkey")
        .join(spread(heads, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "o_custkey AS subject_id",
            "l_orderkey AS hadm_id",
            "l_linenumber AS seq_num",
            "CASE WHEN l_linestatus = 'F' THEN concat('N', p_size)"
            " ELSE concat('\\'', substr(p_type, 1, 3), '.', p_size, '\\'') END AS icd_code",
            "CASE WHEN l_linestatus = 'F' THEN '9' ELSE '10' END AS icd_version",
        )
    )


def code_map(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "part")
        .selectExpr(
            # the X marks codes that no diagnosis has, so that some diagnoses stay unmapped
            "concat(CASE WHEN p_size <= 45 AND p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'N' ELSE 'X' END, p_size)"
            " AS icd9cm",
            "concat(substr(p_type, 1, 3), p_size) AS icd10cm",
            "'1' AS approximate",
            "CASE WHEN p_size % 10 = 0 THEN '1' ELSE '0' END AS no_map",
            "CASE WHEN p_size % 7 = 0 THEN '1' ELSE '0' END AS combination",
        )
        .distinct()
    )


def code_groups(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "part")
        .selectExpr(
            "concat('\\'', CASE WHEN p_size % 17 = 0 THEN 'X' ELSE '' END, substr(p_type, 1, 3), p_size, '\\'')"
            " AS icd_code",
            "concat('\\'C', p_size % 20, '\\'') AS ccs_code",
            "concat('group ', p_size % 20) AS ccs_description",
        )
        .distinct()
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    return (
        labels.select("doc_id", "quality")
        .join(documents.select("doc_id", "lang"), "doc_id")
        .selectExpr(
            "doc_id",
            "quality AS y",
            "CAST((doc_id * 7919) % 100 AS DOUBLE) / 200 + CASE WHEN quality = 1 THEN CAST(0.3 AS DOUBLE)"
            " ELSE CAST(0.2 AS DOUBLE) END AS score",
            "lang AS grp",
        )
    )


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice AS y",
        "l_quantity * p_retailprice AS pred",
        "l_returnflag AS grp",
    )
