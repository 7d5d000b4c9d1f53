"""Joins that stay balanced when one key owns a large part of the rows.

A key is *heavy* when it has more than ``minRows`` rows, whatever the size of the table, so no task ever gets
more of one key. There can be at most ``rows / minRows`` heavy keys, a few ten thousand in 10^11 rows, which
is what makes broadcasting the list of heavy keys safe.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import stage

MIN_ROWS = "spark.wardline.skew.minRows"
BROADCAST_ROWS = "spark.wardline.broadcast.maxRows"
BROADCAST_BYTES = "spark.wardline.broadcast.maxBytes"
TASK_ROWS = "spark.wardline.task.rows"

FIND = "find"

_DEFAULTS = {MIN_ROWS: 2_000_000, BROADCAST_ROWS: 200_000, BROADCAST_BYTES: 64 << 20, TASK_ROWS: 500_000}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


@dataclass(frozen=True)
class HeavyKeys:
    """Heavy keys with their row count ``_w_n`` and share count ``_w_shares``; at most ``rows / limit`` rows."""

    keys: DataFrame
    limit: int


def find_heavy(df: DataFrame, keys: list[str]) -> HeavyKeys | None:
    """Count rows per key (combined map-side) and return the heavy keys, or None when there are none."""
    spark = df.sparkSession
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w_n"))
    largest = sizes.agg(F.max("_w_n")).first()[0]
    limit = setting(spark, MIN_ROWS)
    if (largest or 0) <= limit:
        return None
    heavy = sizes.where(F.col("_w_n") > limit).withColumn("_w_shares", F.ceil(F.col("_w_n") / limit).cast("int"))
    # a bounded table, written once so that every use agrees and none counts again
    return HeavyKeys(stage(heavy, "heavy"), limit)


def fits_broadcast(df: DataFrame) -> bool:
    """True when ``df`` keeps both broadcast limits, rows and bytes (of its JSON form); reads no further than that."""
    limit = setting(df.sparkSession, BROADCAST_ROWS)
    width = F.coalesce(F.octet_length(F.to_json(F.struct(*df.columns))), F.lit(0)) if df.columns else F.lit(0)
    rows, size = df.select(width.alias("w")).limit(limit + 1).agg(F.count(F.lit(1)), F.sum("w")).first()
    return rows <= limit and (size or 0) <= setting(df.sparkSession, BROADCAST_BYTES)


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` by hash of ``key`` in as many partitions as keep about ``spark.wardline.task.rows`` of ``rows`` rows in each.

    Adaptive execution joins shuffle partitions up to a number of compressed bytes, and a few narrow columns compress so
    well that one task then sorts and counts millions of rows. A number that is asked for is kept. Up to
    one partition's rows for each default task the plan is left as it is.
    """
    most = setting(df.sparkSession, TASK_ROWS)
    if rows <= most * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // most), key)


def equal_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool) -> Column:
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def attach(df: DataFrame, bounded: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe broadcast join with a side whose size is bounded by construction (heavy keys, slices)."""
    side = bounded.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    joined = df.join(F.broadcast(side), equal_keys(df, side, [(k, f"_b_{k}") for k in keys], True), how)
    return joined.drop(*[f"_b_{k}" for k in keys])


def join_balanced(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", null_safe: bool = False,
    heavy: HeavyKeys | None | str = FIND,
) -> DataFrame:
    """Left-driven equi-join (``inner``, ``left``, ``left_semi``, ``left_anti``) of two large tables.

    Heavy keys of the left side are spread over ``_w_shares`` salts and the matching right rows are
    repeated once per salt; all other keys join on salt 0. One shuffle per side either way.
    ``heavy`` passes on what :func:`find_heavy` said about the same left rows.
    """
    if heavy == FIND:
        heavy = find_heavy(left, on)
    side = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    pairs = [(k, f"_r_{k}") for k in on]
    if heavy is None:
        joined = left.join(side, equal_keys(left, side, pairs, null_safe), how)
        return joined.drop(*[b for _, b in pairs])
    spread = F.pmod(F.xxhash64(*left.columns), F.col("_w_shares").cast("long")).cast("int")
    salted = (
        attach(left, heavy.keys.select(*on, "_w_shares"), on)
        .withColumn("_w_salt", F.coalesce(spread, F.lit(0)))
        .drop("_w_shares")
    )
    repeated = (
        attach(right, heavy.keys.select(*on, "_w_shares"), on)
        .withColumn("_w_rsalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_w_shares"), F.lit(1)) - 1)))
        .drop("_w_shares")
        .withColumnsRenamed({k: f"_r_{k}" for k in on})
    )
    condition = equal_keys(salted, repeated, pairs, null_safe) & (salted["_w_salt"] == repeated["_w_rsalt"])
    return salted.join(repeated, condition, how).drop("_w_salt", "_w_rsalt", *[b for _, b in pairs])


def join_lookup(
    left: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", null_safe: bool = False,
    heavy: HeavyKeys | None | str = FIND,
) -> DataFrame:
    """Join with a lookup table: broadcast when its counted size allows it, balanced shuffle join beyond."""
    if not fits_broadcast(lookup):
        return join_balanced(left, lookup, on, how, null_safe, heavy)
    side = lookup.withColumnsRenamed({k: f"_r_{k}" for k in on})
    pairs = [(k, f"_r_{k}") for k in on]
    joined = left.join(F.broadcast(side), equal_keys(left, side, pairs, null_safe), how)
    return joined.drop(*[b for _, b in pairs])
