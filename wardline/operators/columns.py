"""Choosing, naming and testing columns and rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """Column reference that is safe for dots and quotes in the name."""
    return "`" + name.replace("`", "``") + "`"


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def add_literal_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def drop_columns(df: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if strict and absent:
        raise ValueError(f"columns not found: {absent}")
    return df.drop(*[c for c in columns if c not in absent])


def drop_columns_regex(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every column whose name contains a match of ``pattern``."""
    return project_columns(df, [c for c in df.columns if not re.search(pattern, c)])


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def select_columns_prefix(df: DataFrame, prefix: str, keep: list[str] | None = None) -> DataFrame:
    return project_columns(df, [*(keep or []), *columns_with_prefix(df, prefix)])


def sanitize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def column_roles(
    df: DataFrame, ids: list[str], label: str, order: str | None = None, group_prefix: str = "race_",
    exclude: list[str] | None = None,
) -> dict[str, list[str]]:
    """Divide the columns into ids, order, label, groups and features; each column has one role."""
    groups = columns_with_prefix(df, group_prefix)
    taken = {*ids, label, *groups, *(exclude or []), *([order] if order else [])}
    return {
        "ids": ids,
        "order": [order] if order else [],
        "label": [label],
        "groups": groups,
        "features": [c for c in df.columns if c not in taken],
    }


def filter_conjunction(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Rows where every named column equals its value; null never does."""
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def filter_equality_split(df: DataFrame, column: str, values: list[str]) -> dict[str, DataFrame]:
    return {v: df.where(F.col(column) == v) for v in values}


def filter_positive_nonnull(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def filter_group_flag(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(quoted(column)) == 1)


def audit_nulls(df: DataFrame) -> DataFrame:
    """One row per column: does it hold any null. One pass over the table."""
    seen = df.agg(*[F.max(F.col(quoted(c)).isNull()).alias(c) for c in df.columns])
    return seen.unpivot([], df.columns, "column_name", "has_null")


def columns_to_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per column with its struct or array ``s``, for small results; plain values go through ``unpivot``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(quoted(c)).alias("s")) for c in columns])
    return df.select(*keys, F.explode_outer(pairs).alias("_pair")).select(*keys, "_pair.variable", "_pair.s")


def unpivot_flags(df: DataFrame, flags: list[str], name: str, keep: list[str]) -> DataFrame:
    """One row per set one-hot flag, labelled with the flag's column name."""
    labels = F.array(*[F.when(F.col(quoted(c)) == 1, F.lit(c)) for c in flags])
    return df.select(*keep, F.explode(F.filter(labels, lambda v: v.isNotNull())).alias(name))
