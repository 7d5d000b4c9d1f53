"""Exact percentiles, for groups of any size, by bracketing.

Every wanted rank has a bracket, an interval of values that holds the rank's value. While a bracket holds many rows, a
mergeable sketch of them proposes a far narrower one; a pass that counts the rows below, at the ends and inside
tells whether the rank is there, or on which side it is, or whether an end is the value already. Once few rows are
inside, those alone are counted by value and ordered. Sketches and counts are combined before each shuffle, so of
all the values only the last brackets' are shuffled. One algorithm at every size: a small group's first bracket, its
smallest and largest value, holds few rows from the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.plans.skew import attach, join_balanced
from wardline.session import stage

BRACKET_ROWS = "spark.wardline.quantiles.bracketRows"
_DEFAULT_ROWS = 1_000_000
_SKETCH = 1_024
#: Twice the sketch's rank error of 99 % of all cases, on either side of a wanted rank; a miss costs a pass, no more.
_MARGIN = 2 * 2.296 / _SKETCH**0.9723
_BROADCAST_GROUPS = 10_000  # rows of at most a few hundred bytes
_GRID = 400  # a sketch is asked for its values at every 400th
_WIDE, _TEST, _SMALL, _FOUND = 0, 1, 2, 3


def _bracket(b: Column, state: int, lo: Column, hi: Column, below: Column | None = None, rows: Column | None = None, outer: tuple[Column, Column] | None = None) -> Column:
    """Wide and small: ``rows`` between the ends, ``below`` of them smaller. Test: the rank is between the outer ends,
    perhaps between these. Found: both ends are the value."""
    outer_lo, outer_hi = outer or (lo, hi)
    parts = {
        "rank": b["rank"], "state": F.lit(state), "lo": lo, "hi": hi, "below": F.lit(0).cast("long") if below is None else below,
        "rows": F.lit(0).cast("long") if rows is None else rows, "outer_lo": outer_lo, "outer_hi": outer_hi,
    }
    return F.struct(*[v.alias(name) for name, v in parts.items()])


def _by_size(b: Column, lo: Column, hi: Column, below: Column | None, rows: Column, limit: int) -> Column:
    few = _bracket(b, _SMALL, lo, hi, below, rows)
    return F.when(rows <= limit, few).otherwise(_bracket(b, _WIDE, lo, hi, below, rows))


def _start(long: DataFrame, groups: list[str], probabilities: dict[str, float], limit: int) -> DataFrame:
    """One row per group: ``_all`` rows, and brackets for both neighbours of every percentile's place."""
    real, nan = F.when(~F.isnan("_v"), F.col("_v")), F.lit(float("nan"))
    first = long.groupBy(*groups).agg(F.count(F.lit(1)).alias("_all"), F.count(real).alias("_n"), F.min(real).alias("_min"), F.max(real).alias("_max"))
    places = [(F.col("_all") - 1) * F.lit(p) for p in probabilities.values()]
    ranks = F.array(*[F.struct(end(place).cast("long").alias("rank")) for place in places for end in (F.floor, F.ceil)])
    within = lambda b: _by_size(b, F.col("_min"), F.col("_max"), None, F.col("_n"), limit)
    # NaN is larger than all other values, as Spark orders them
    brackets = F.transform(ranks, lambda b: F.when(b["rank"] >= F.col("_n"), _bracket(b, _FOUND, nan, nan)).otherwise(within(b)))
    return first.select(*groups, "_all", brackets.alias("_brackets"))


def _has(state: int) -> Column:
    return F.exists("_brackets", lambda b: b["state"] == state)


def _ranges(state: int) -> Column:
    """The different brackets of one state in a group."""
    own = F.filter("_brackets", lambda b: b["state"] == state)
    return F.array_distinct(F.transform(own, lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["below"].alias("below"))))


def _range_of(b: Column, state: int) -> Column:
    """Place of a bracket among the group's ranges, from 0."""
    own = F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["below"].alias("below"))
    return F.when(b["state"] == state, F.array_position(_ranges(state), own).cast("int") - 1)


def _meet(rows: DataFrame, side: DataFrame, groups: list[str]) -> DataFrame:
    """Rows with the columns of their group's row in ``side``, a staged table of one row of fixed width per group."""
    if side.count() <= _BROADCAST_GROUPS:
        return attach(rows, side, groups, "inner")
    return join_balanced(rows, side, groups, "inner", null_safe=True)


def _inside(long: DataFrame, groups: list[str], brackets: DataFrame, state: int) -> DataFrame:
    """Rows inside the ranges of one state, once for each, with the range's place ``_r``."""
    ranges = stage(brackets.where(_has(state)).select(*groups, _ranges(state).alias("_ranges")), "ranges")
    most = ranges.agg(F.max(F.size("_ranges"))).first()[0] or 1
    ends = {f"_{e}{i}": F.get("_ranges", F.lit(i))[e] for i in range(most) for e in ("lo", "hi")}
    joined = _meet(long.where(~F.isnan("_v")), ranges, groups).select(*groups, "_v", *[e.alias(n) for n, e in ends.items()])
    hits = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(most)]
    kept = joined.where(reduce(lambda x, y: x | y, hits)).select(*groups, "_v", *[h.alias(f"_h{i}") for i, h in enumerate(hits)])
    if most == 1:
        return kept.select(*groups, "_v", F.lit(0).alias("_r"))
    places = F.explode(F.array(*[F.when(F.col(f"_h{i}"), i) for i in range(most)]))
    return kept.select(*groups, "_v", places.alias("_r")).where("_r IS NOT NULL")


def _sketched(long: DataFrame, groups: list[str], brackets: DataFrame) -> DataFrame:
    """``brackets`` with proposals for the wide ones, from a sketch of the rows inside each."""
    grid = F.expr("array(" + ", ".join(f"{i / _GRID}D" for i in range(_GRID + 1)) + ")")
    sketches = _inside(long, groups, brackets, _WIDE).groupBy(*groups, "_r").agg(F.kll_sketch_agg_double("_v", F.lit(_SKETCH)).alias("_sketch"))
    asked = sketches.select(*groups, F.struct("_r", F.kll_sketch_get_quantile_double("_sketch", grid).alias("values")).alias("_s"))
    listed = asked.groupBy(*groups).agg(F.collect_list("_s").alias("_sketches"))
    joined = join_balanced(brackets, listed, groups, "left", null_safe=True, heavy=None)

    def proposed(b: Column) -> Column:
        own = F.get(F.filter("_sketches", lambda s: s["_r"] == _range_of(b, _WIDE)), F.lit(0))["values"]
        share = (b["rank"] - b["below"]) / b["rows"]
        first, last = (share - _MARGIN) * _GRID, (share + _MARGIN) * _GRID
        lo = F.when(first <= 0, b["lo"]).otherwise(F.get(own, F.floor(first).cast("int")))
        hi = F.when(last >= _GRID, b["hi"]).otherwise(F.get(own, F.ceil(last).cast("int")))
        return F.when(b["state"] == _WIDE, _bracket(b, _TEST, lo, hi, outer=(b["lo"], b["hi"]))).otherwise(b)

    return joined.select(*groups, "_all", F.transform("_brackets", proposed).alias("_brackets"))


def _counted(long: DataFrame, groups: list[str], brackets: DataFrame, size: int, limit: int) -> DataFrame:
    """``brackets`` after a pass that counts the rows between and at the ends of those to test.

    A row's region is the number of ends it exceeds and reaches; a region's extremes tell where it lies.
    """
    tests = [F.get("_brackets", F.lit(i)) for i in range(size)]
    ends = [F.when(b["state"] == _TEST, b[e]) for b in tests for e in ("lo", "hi")]
    flat = stage(brackets.where(_has(_TEST)).select(*groups, *[e.alias(f"_e{i}") for i, e in enumerate(ends)]), "ends")
    joined = _meet(long.where(~F.isnan("_v")), flat, groups)
    reached = [F.when(F.col("_v") > F.col(f"_e{i}"), 2).when(F.col("_v") == F.col(f"_e{i}"), 1).otherwise(0) for i in range(2 * size)]
    regions = joined.groupBy(*groups, sum(reached, F.lit(0)).alias("_region")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    listed = regions.groupBy(*groups).agg(F.collect_list(F.struct("n", "least", "most")).alias("_regions"))  # at most 4 * size + 1
    both = join_balanced(brackets, listed, groups, "left", null_safe=True, heavy=None)
    zero = F.lit(0).cast("long")

    def rows_where(test) -> Column:
        return F.aggregate(F.filter("_regions", test), zero, lambda total, r: total + r["n"])

    def judged(b: Column) -> Column:
        middle = F.filter("_regions", lambda r: (r["least"] > b["lo"]) & (r["most"] < b["hi"]))
        counts = F.struct(
            rows_where(lambda r: r["least"] < b["lo"]).alias("below"), rows_where(lambda r: r["least"] == b["lo"]).alias("at_lo"),
            rows_where(lambda r: (r["least"] > b["lo"]) & (r["most"] < b["hi"])).alias("middle"), rows_where(lambda r: (r["least"] == b["hi"]) & (b["hi"] > b["lo"])).alias("at_hi"),
            F.array_min(F.transform(middle, lambda r: r["least"])).alias("least"), F.array_max(F.transform(middle, lambda r: r["most"])).alias("most"),
        )

        def placed(c: Column) -> Column:
            first, last = c["below"] + c["at_lo"], c["below"] + c["at_lo"] + c["middle"]
            return (
                F.when(b["rank"] < c["below"], _bracket(b, _TEST, b["outer_lo"], b["lo"]))
                .when(b["rank"] < first, _bracket(b, _FOUND, b["lo"], b["lo"]))
                .when(b["rank"] < last, _by_size(b, c["least"], c["most"], first, c["middle"], limit))
                .when(b["rank"] < last + c["at_hi"], _bracket(b, _FOUND, b["hi"], b["hi"]))
                .otherwise(_bracket(b, _TEST, b["hi"], b["outer_hi"]))
            )

        return F.when(b["state"] == _TEST, F.get(F.transform(F.array(counts), placed), F.lit(0))).otherwise(b)

    return both.select(*groups, "_all", F.transform("_brackets", judged).alias("_brackets"))


def _chosen(long: DataFrame, groups: list[str], brackets: DataFrame, size: int) -> DataFrame:
    """The values at the ranks of small brackets, ``_v0`` and so on: their rows are counted by value and ordered."""
    values = _inside(long, groups, brackets, _SMALL).groupBy(*groups, "_r", "_v").agg(F.count(F.lit(1)).alias("_n"))
    by_value = Window.partitionBy(*groups, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.sum("_n").over(by_value))
    wanted = brackets.where(_has(_SMALL))
    flat = []
    for i in range(size):
        b = F.get("_brackets", F.lit(i))
        flat += [_range_of(b, _SMALL).alias(f"_r{i}"), (b["rank"] - b["below"]).alias(f"_rank{i}")]
    joined = _meet(ranked, stage(wanted.select(*groups, *flat), "ranks"), groups)
    picks = [F.min(F.when((F.col("_r") == F.col(f"_r{i}")) & (F.col("_upto") > F.col(f"_rank{i}")), F.col("_v"))).alias(f"_v{i}") for i in range(size)]
    return joined.groupBy(*groups).agg(*picks)


def exact_quantiles(df: DataFrame, keys: list[str], columns: list[str], probabilities: dict[str, float]) -> DataFrame:
    """One row per key group and column (``variable``) with one output column per probability.

    Linear interpolation between the two rows next to the place. Nulls are skipped, NaN counts as largest; a group
    without values has no row. The needed columns are written once, as they are read a few times.
    """
    limit = int(df.sparkSession.conf.get(BRACKET_ROWS, str(_DEFAULT_ROWS)))
    rows = stage(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), "measures")
    long = rows.unpivot(keys, columns, "variable", "_v").where(F.col("_v").isNotNull())
    groups, size = [*keys, "variable"], 2 * len(probabilities)
    brackets = stage(_start(long, groups, probabilities, limit), "brackets")
    while True:
        wide, test = brackets.agg(F.bool_or(_has(_WIDE)), F.bool_or(_has(_TEST))).first()
        if not wide and not test:
            break
        if wide:
            brackets = stage(_sketched(long, groups, brackets), "brackets")
        brackets = stage(_counted(long, groups, brackets, size, limit), "brackets")
    small = _chosen(long, groups, brackets, size)
    both = join_balanced(brackets, small, groups, "left", null_safe=True, heavy=None)
    out = []
    for j, (name, p) in enumerate(probabilities.items()):
        low, high = (
            F.when(F.get("_brackets", F.lit(i))["state"] == _FOUND, F.get("_brackets", F.lit(i))["lo"]).otherwise(F.col(f"_v{i}"))
            for i in (2 * j, 2 * j + 1)
        )
        place = (F.col("_all") - 1) * F.lit(p)
        part = place - F.floor(place)
        out.append(F.when((part == 0) | (low == high), low).otherwise(low + part * (high - low)).alias(name))
    return both.select(*groups, *out)
