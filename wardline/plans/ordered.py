"""Ordered window functions over groups of any size, and positions without a window.

``Window.partitionBy(k).orderBy(t)`` sends a whole group to one task. That is right for ordinary
groups and fails for a group that owns a third of the table, or for a window over everything.

``number_rows`` numbers rows by one range shuffle: partitions hold consecutive rows, a row's place in its partition is
known from the sort, and the totals of the partitions before it are added. No window, no second shuffle.

``ordered_window`` uses the plain window for ordinary groups. Rows of heavy groups are range-partitioned by key and
order; each key's part of a partition is one window group (a *slice*), and the totals of the earlier slices
are added afterwards. Range-partitioned rows are written once, so a retried task sees the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.plans.skew import FIND, HeavyKeys, attach, find_heavy, join_lookup
from wardline.session import stage

_MOST_SLICES = 4_096  # the range partitioner samples rows for each of its partitions on the driver
_PLACE_BITS = 33  # monotonically_increasing_id: the partition above, the row's place in it below


def sort_key(order: list[str]) -> Column:
    """Comparable struct for ascending order with nulls last."""
    parts = []
    for i, name in enumerate(order):
        parts += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*parts)


def _nulls_last(order: list[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in order]


def _ranged(df: DataFrame, parts: int, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows in range partitions by key and order, sorted, with their partition ``_w_slice`` and place ``_w_place``; staged."""
    by = _nulls_last([*keys, *order])
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_w_at", F.monotonically_increasing_id())
    numbers = {"_w_slice": F.shiftright("_w_at", _PLACE_BITS).cast("int"), "_w_place": F.col("_w_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}
    return stage(placed, name).withColumns(numbers).drop("_w_at")


def number_rows(
    df: DataFrame, groups: list[str], order: list[str], name: str, size: str | None = None, parts: int | None = None
) -> DataFrame:
    """Adds the row's position in its group, from 0, and with ``size`` the group's number of rows.

    ``order`` is ascending with nulls last and should be unique within a group. Groups may be few and of any
    size, or many: what is joined back is one row for each group and partition it has rows in.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _ranged(df, min(parts, _MOST_SLICES), groups, order, "numbered")
    across = Window.partitionBy(*(groups or [F.lit(0)]))
    before = across.orderBy("_w_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, "_w_slice"]
    totals = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_w_place").alias("_first"))
    carried = totals.select(
        *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_c_shift"), F.sum("_n").over(across).alias("_c_size")
    )
    joined = join_lookup(placed, carried, keys, "left", null_safe=True, heavy=None)
    out = {name: F.col("_w_place") + F.col("_c_shift")} | ({size: F.col("_c_size")} if size else {})
    return joined.withColumns(out).drop("_w_slice", "_w_place", "_c_shift", "_c_size")


def ordered_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    row_number: str | None = None,
    lag: dict[str, str] | None = None,
    sum_before: dict[str, str] | None = None,
    sum_upto: dict[str, str] | None = None,
    max_before: dict[str, str] | None = None,
    group_sum: dict[str, str] | None = None,
    group_first: dict[str, str] | None = None,
    heavy: HeavyKeys | None | str = FIND,
) -> DataFrame:
    """Add ordered window columns; every mapping is ``{new column: source column}``.

    ``order`` is ascending with nulls last and should be unique within a group. ``sum_before`` and
    ``max_before`` look at earlier rows only, ``sum_upto`` includes the current row; empty sums are 0.
    ``group_sum`` and ``group_first`` (the first row's value) are the same on every row of a group.
    ``heavy`` passes on what :func:`find_heavy` said about the same rows, to save the counting.
    """
    wanted = {
        "row_number": row_number, "lag": lag or {}, "sum_before": sum_before or {}, "sum_upto": sum_upto or {},
        "max_before": max_before or {}, "group_sum": group_sum or {}, "group_first": group_first or {},
    }
    if heavy == FIND:
        heavy = find_heavy(df, keys)
    if heavy is None:
        return df.withColumns(_within(keys, order, **wanted))
    if not keys:
        return _sliced(df, keys, order, heavy, wanted)
    listed = heavy.keys.select(*keys)
    light = attach(df, listed, keys, "left_anti")
    hot = _sliced(attach(df, listed, keys, "left_semi"), keys, order, heavy, wanted)
    return light.withColumns(_within(keys, order, **wanted)).unionByName(hot)


def _within(groups: list[str], order: list[str], row_number, lag, sum_before, sum_upto, max_before, group_sum, group_first) -> dict[str, Column]:
    """The columns of plain windows over ``groups``."""
    by_group = Window.partitionBy(*(groups or [F.lit(0)]))
    ordered = by_group.orderBy(*_nulls_last(order))
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = F.row_number().over(ordered).cast("long")
    out |= {name: F.lag(src).over(ordered) for name, src in lag.items()}
    out |= {name: F.coalesce(F.sum(src).over(earlier), zero) for name, src in sum_before.items()}
    out |= {name: F.coalesce(F.sum(src).over(so_far), zero) for name, src in sum_upto.items()}
    out |= {name: F.max(src).over(earlier) for name, src in max_before.items()}
    out |= {name: F.coalesce(F.sum(src).over(by_group), zero) for name, src in group_sum.items()}
    return out | {name: F.first(src).over(so_far) for name, src in group_first.items()}


def _sliced(df: DataFrame, keys: list[str], order: list[str], heavy: HeavyKeys, wanted: dict) -> DataFrame:
    """The same columns for rows of heavy groups: windows over slices, and what the earlier slices of the group add."""
    parts = heavy.keys.agg(F.sum("_w_shares")).first()[0]
    df = _ranged(df, min(parts, _MOST_SLICES), keys, order, "slices").drop("_w_place")
    groups = [*keys, "_w_slice"]
    out = _within(groups, order, **wanted)
    lag, max_before, group_first = wanted["lag"], wanted["max_before"], wanted["group_first"]
    sum_before, sum_upto, group_sum = wanted["sum_before"], wanted["sum_upto"], wanted["group_sum"]
    zero, key = F.lit(0), sort_key(order)

    # one row per slice of a group: totals, then totals of the slices before it
    sums = sorted({*sum_before.values(), *sum_upto.values(), *group_sum.values()})
    per_slice = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_w_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        *[F.max(c).alias(f"_max_{c}") for c in sorted(set(max_before.values()))],
        *[F.max_by(F.struct(c), key).alias(f"_last_{c}") for c in sorted(set(lag.values()))],
        *[F.min_by(F.struct(c), key).alias(f"_first_{c}") for c in sorted(set(group_first.values()))],
    )
    across_all = Window.partitionBy(*(keys or [F.lit(0)]))
    across = across_all.orderBy("_w_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *groups,
        F.coalesce(F.sum("_w_rows").over(before), zero).alias("_c_rows"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), zero).alias(f"_c_sum_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(across_all).alias(f"_c_all_{c}") for c in sums],
        *[F.max(f"_max_{c}").over(before).alias(f"_c_max_{c}") for c in sorted(set(max_before.values()))],
        *[F.lag(f"_last_{c}").over(across).alias(f"_c_last_{c}") for c in sorted(set(lag.values()))],
        *[F.first(f"_first_{c}").over(across).alias(f"_c_first_{c}") for c in sorted(set(group_first.values()))],
    )
    # at most a row for each heavy key and partition boundary
    local = F.row_number().over(Window.partitionBy(*groups).orderBy(*_nulls_last(order)))
    result = attach(df.withColumns({**out, "_w_local": local}), carried, groups)

    def plus(name: str, carry: str) -> Column:
        return F.col(name) + F.coalesce(F.col(carry), zero)

    final: dict[str, Column] = {}
    if wanted["row_number"]:
        final[wanted["row_number"]] = plus(wanted["row_number"], "_c_rows")
    first = F.col("_w_local") == 1
    final |= {name: F.when(first, F.col(f"_c_last_{src}")[src]).otherwise(F.col(name)) for name, src in lag.items()}
    final |= {name: plus(name, f"_c_sum_{src}") for name, src in {**sum_before, **sum_upto}.items()}
    final |= {name: F.greatest(F.col(name), F.col(f"_c_max_{src}")) for name, src in max_before.items()}
    final |= {name: F.coalesce(F.col(f"_c_all_{src}"), zero) for name, src in group_sum.items()}
    final |= {name: F.col(f"_c_first_{src}")[src] for name, src in group_first.items()}
    return result.withColumns(final).drop("_w_slice", "_w_local", *[c for c in carried.columns if c.startswith("_c_")])
