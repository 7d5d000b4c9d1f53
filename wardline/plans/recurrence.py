"""Linear recurrences along groups of any size, as an associative scan.

``h`` before an element is ``a * h + c`` of the element before it, from 0. An element is an affine map, and so is a run of
them: runs of bounded length are folded into one map each, the maps are scanned in the same way, and what comes
out is every run's start. Values are folded in order, so there are no large powers and no cancellation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.plans.skew import join_balanced
from wardline.session import stage

RUN = 256


def _after(h: Column, e: Column) -> Column:
    return F.zip_with(h, e["c"], lambda x, y: x * e["a"] + y)


def affine_before(df: DataFrame, keys: list[str], position: str, a: str, c: str, name: str, run: int = RUN) -> DataFrame:
    """Adds ``name``, the state before each row, for a whole array of recurrences that share the factor.

    ``position`` numbers a group's rows from 0, ``a`` is the factor (double), ``c`` an array of doubles of one length.
    """
    others = [x for x in df.columns if x not in (*keys, position, a, c)]
    element = F.struct(F.col(position).alias("p"), F.col(a).alias("a"), F.col(c).alias("c"), F.struct(*others).alias("row")) if others else F.struct(F.col(position).alias("p"), F.col(a).alias("a"), F.col(c).alias("c"))
    block = F.expr(f"CAST(`{position}` DIV {run} AS BIGINT)")
    runs = df.groupBy(*keys, block.alias("_run")).agg(F.collect_list(element).alias("_e"))  # at most ``run`` elements
    ordered = F.array_sort("_e", lambda x, y: (x["p"] - y["p"]).cast("int"))
    runs = stage(runs.withColumn("_e", ordered), "runs")
    zeros = F.transform(F.get("_e", F.lit(0))["c"], lambda x: F.lit(0.0))
    if (runs.agg(F.max("_run")).first()[0] or 0) > 0:
        one = F.struct(F.lit(1.0).alias("a"), zeros.alias("c"))
        whole = F.aggregate("_e", one, lambda s, e: F.struct((s["a"] * e["a"]).alias("a"), _after(s["c"], e).alias("c")))
        maps = runs.select(*keys, "_run", whole.alias("_m")).select(*keys, "_run", F.col("_m.a").alias("_a"), F.col("_m.c").alias("_c"))
        starts = affine_before(maps, keys, "_run", "_a", "_c", "_start", run).select(*keys, "_run", "_start")
        runs = join_balanced(runs, starts, [*keys, "_run"], null_safe=True, heavy=None)
    else:
        runs = runs.withColumn("_start", zeros)
    state = F.struct(F.col("_start").alias("h"), F.array().cast("array<array<double>>").alias("seen"))
    scanned = F.aggregate("_e", state, lambda s, e: F.struct(_after(s["h"], e).alias("h"), F.concat(s["seen"], F.array(s["h"])).alias("seen")))
    cells = runs.select(*keys, F.explode(F.arrays_zip(F.col("_e"), scanned["seen"].alias("h"))).alias("_x"))
    row = [F.col(f"_x._e.row.{x}").alias(x) for x in others]
    return cells.select(*keys, F.col("_x._e.p").alias(position), F.col("_x._e.a").alias(a), F.col("_x._e.c").alias(c), *row, F.col("_x.h").alias(name))
