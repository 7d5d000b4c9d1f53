"""Sliced windows and salted joins against the plain forms, on groups that own most of the rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.operators import codes, sequences
from wardline.plans import skew
from wardline.plans.ordered import number_rows, ordered_window
from wardline.plans.quantiles import BRACKET_ROWS, exact_quantiles
from wardline.sources import tables


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(1)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else (None if i % 2 else f"k{i % 40}")
        time = None if i % 11 == 0 else draw.randint(0, 60)
        rows.append((i, key, time, None if i % 7 == 0 else float(draw.randint(-50, 50))))
    return spark.createDataFrame(rows, "id long, key string, time int, value double")


def plain(df, keys):
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("time"), F.asc_nulls_last("id"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    return df.select(
        "id",
        F.row_number().over(w).cast("long").alias("rn"),
        F.lag("value").over(w).alias("lagged"),
        F.coalesce(F.sum("value").over(before), F.lit(0)).alias("sum_b"),
        F.coalesce(F.sum("value").over(upto), F.lit(0)).alias("sum_u"),
        F.max("value").over(before).alias("max_b"),
        F.coalesce(F.sum("value").over(everything), F.lit(0)).alias("total"),
        F.first("value").over(upto).alias("start"),
    )


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("limit", ["1000000", "10", "70"])
def test_ordered_window(spark, skewed, keys, limit):
    spark.conf.set(skew.MIN_ROWS, limit)
    try:
        got = ordered_window(
            skewed, keys, ["time", "id"], row_number="rn", lag={"lagged": "value"}, sum_before={"sum_b": "value"},
            sum_upto={"sum_u": "value"}, max_before={"max_b": "value"}, group_sum={"total": "value"},
            group_first={"start": "value"},
        ).drop("key", "time", "value")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain(skewed, keys).collect()))
    finally:
        spark.conf.unset(skew.MIN_ROWS)


def test_slices_are_small(spark, skewed, monkeypatch):
    """A forced heavy group is cut into many window groups, each a fraction of it."""
    from wardline.plans import ordered

    spark.conf.set(skew.MIN_ROWS, "40")
    seen = {}
    original = ordered.attach

    def spy(df, bounded, keys, how="left"):
        if "_w_slice" in keys:
            seen["sizes"] = [r["count"] for r in df.groupBy(*keys).count().collect()]
        return original(df, bounded, keys, how)

    monkeypatch.setattr(ordered, "attach", spy)
    try:
        ordered_window(skewed, ["key"], ["time", "id"], row_number="rn")
    finally:
        spark.conf.unset(skew.MIN_ROWS)
    assert len(seen["sizes"]) >= 10 and max(seen["sizes"]) < 200


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_join_balanced(spark, skewed, how, null_safe):
    side = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k3", 3), ("k6", 4), (None, 5), ("absent", 6)], "key string, extra int"
    )
    want = skew.join_balanced(skewed, side, ["key"], how, null_safe, heavy=None)
    spark.conf.set(skew.MIN_ROWS, "30")
    try:
        assert skew.find_heavy(skewed, ["key"]) is not None
        got = skew.join_balanced(skewed, side, ["key"], how, null_safe)
        rows = [sorted(map(repr, x.collect())) for x in (got, want)]
        assert rows[0] == rows[1] and got.columns == want.columns
    finally:
        spark.conf.unset(skew.MIN_ROWS)


@pytest.mark.parametrize("rows", ["1000000", "40", "3"])
@pytest.mark.parametrize("keys", [["key"], []])
def test_quantiles_equal_builtin(spark, skewed, keys, rows):
    shares = {"p0": 0.0, "q1": 0.25, "q2": 0.5, "p90": 0.9, "p100": 1.0}
    picked = [F.percentile(c, F.array(*[F.lit(p) for p in shares.values()])).alias(c) for c in ("value", "time")]
    plain_rows = skewed.groupBy(*keys).agg(*picked).collect()
    want = {(*[r[k] for k in keys], c): [round(v, 9) for v in r[c]] for r in plain_rows for c in ("value", "time") if r[c]}
    spark.conf.set(BRACKET_ROWS, rows)
    try:
        got = exact_quantiles(skewed, keys, ["value", "time"], shares).collect()
    finally:
        spark.conf.unset(BRACKET_ROWS)
    assert {tuple(r)[: len(keys) + 1]: [round(r[n], 9) for n in shares] for r in got} == want


def test_quantiles_of_odd_values(spark):
    """Not a number is largest, ends may be infinite, one value may own the group; nulls and empty groups vanish."""
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0), ("a", nan), ("a", None), (None, 5.0), ("b", None), ("c", inf), ("c", -inf), ("c", 0.0)]
    rows += [("d", 7.0)] * 300 + [("d", float(i)) for i in range(100)] + [("e", float(i // 40)) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, v double")
    want = {"a": [1.0, nan, nan], "c": [-inf, 0.0, inf], "d": [0.0, 7.0, 99.0], "e": [0.0, 1.0, 2.0], None: [5.0] * 3}
    for limit in ("1000", "2"):
        spark.conf.set(BRACKET_ROWS, limit)
        try:
            got = exact_quantiles(frame, ["k"], ["v"], {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()
            assert {r["k"]: [str(r[n]) for n in ("lo", "mid", "hi")] for r in got} == {k: list(map(str, v)) for k, v in want.items()}
            assert exact_quantiles(frame.limit(0), ["k"], ["v"], {"mid": 0.5}).count() == 0
        finally:
            spark.conf.unset(BRACKET_ROWS)


def test_quantiles_shuffle_only_the_last_brackets(spark, monkeypatch):
    from wardline.plans import quantiles

    seen = []
    original = quantiles._inside

    def spy(long, groups, brackets, state):
        found = original(long, groups, brackets, state)
        seen.append((state, found.count()))
        return found

    monkeypatch.setattr(quantiles, "_inside", spy)
    spark.conf.set(BRACKET_ROWS, "2000")
    try:
        numbers = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
        row = exact_quantiles(numbers, [], ["v"], {"q1": 0.25, "mid": 0.5}).first()
        want = numbers.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    finally:
        spark.conf.unset(BRACKET_ROWS)
    assert [row["q1"], row["mid"]] == want
    assert seen[-1][0] == quantiles._SMALL and seen[-1][1] <= 4 * 2_000


def test_long_subject_is_split_into_segments(spark):
    rows = [(1, i, i + 1, float(i), i % 2) for i in range(25)] + [(2, 100, 1, 5.0, 1)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, admission_no long, v double, y int")
    built = sequences.build_sequences(df, ["v"], "y", segment_size=10)
    found = {(r["subject_id"], r["segment"]): (r["length"], [s["hadm_id"] for s in r["steps"]]) for r in built.collect()}
    assert found[(1, 0)] == (25, list(range(10)))
    assert found[(1, 2)] == (25, list(range(20, 25)))
    assert found[(2, 0)] == (1, [100])
    padded = sequences.pad_sequences(built, 1, sequences.longest_segment(built))
    real = {(r["subject_id"], r["pos"]): r["x"][0] for r in sequences.mask_padding(padded).collect()}
    assert real == {**{(1, i): float(i) for i in range(25)}, (2, 0): 5.0}
    cells = {(r["subject_id"], r["pos"]) for r in sequences.unroll(padded).where("is_real").collect()}
    assert cells == set(real)


@pytest.mark.parametrize("groups", [["key"], []])
@pytest.mark.parametrize("parts", [1, 7, 60])
def test_numbers_follow_the_order(spark, skewed, groups, parts):
    got = number_rows(skewed, groups, ["time", "id"], "rn", "n", parts).select("id", "rn", "n")
    w = Window.partitionBy(*groups)
    order = w.orderBy(F.asc_nulls_last("time"), F.asc_nulls_last("id"))
    want = skewed.select("id", (F.row_number().over(order) - 1).cast("long").alias("rn"), F.count("*").over(w).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert number_rows(skewed.limit(0), groups, ["time", "id"], "rn").count() == 0


def test_plans_of_heavy_groups_carry_no_arrays(spark, skewed):
    spark.conf.set(skew.MIN_ROWS, "40")
    try:
        got = ordered_window(skewed, ["key"], ["time", "id"], row_number="rn", sum_upto={"s": "value"})
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "array" not in plan.lower() and "Window" in plan
    finally:
        spark.conf.unset(skew.MIN_ROWS)


def test_differential_codes_survive_large_totals(spark):
    from wardline.operators import tests_of_difference as tests

    base = [(i, "c1" if i % 2 else "c2") for i in range(40)]
    many = spark.createDataFrame(base, "hadm_id long, ccs_code string")
    outcomes = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "hadm_id long, hospital_expire_flag int")
    moments = spark.createDataFrame([("c1", 4_000_000_000, 1.0, 4_000_000_000, 1.0)], "ccs string, s0 long, q0 double, s1 long, q1 double")
    assert moments.select(tests._variance(0, (5, 5)).alias("v")).first()["v"] < 0  # no overflow under ANSI arithmetic
    assert tests.differential_codes(many, outcomes).count() == 2


def test_broadcast_looks_at_bytes(spark):
    wide = spark.range(50).withColumn("v", F.repeat(F.lit("x"), 1_000))
    assert skew.fits_broadcast(wide)
    spark.conf.set(skew.BROADCAST_BYTES, "10000")
    try:
        assert not skew.fits_broadcast(wide) and skew.fits_broadcast(wide.limit(5))
    finally:
        spark.conf.unset(skew.BROADCAST_BYTES)


def test_diagnoses_lie_in_tasks_of_bounded_size(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(6_000).selectExpr("id div 4 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "IF(id % 3 = 0, 'F', 'O') AS l_linestatus", "id % 20 AS l_partkey").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(1_500).selectExpr("id AS o_orderkey", "id % 70 AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(20).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size", "'LARGE' AS p_type").write.parquet(f"{folder}/part.parquet")
    before = tables.diagnoses(spark, folder).collect()
    spark.conf.set("spark.wardline.task.rows", "300")
    try:
        counts = codes.count_long(tables.diagnoses(spark, folder), "hadm_id", "icd_code")
        sizes = [r["n"] for r in counts.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
        after = tables.diagnoses(spark, folder).collect()
    finally:
        spark.conf.unset("spark.wardline.task.rows")
    assert sum(sizes) == 6_000 and max(sizes) <= 600
    assert Counter(before) == Counter(after) and len(after) == 6_000
