"""Ordered admission sequences per subject.

A sequence is stored in segments of at most ``segment_size`` admissions, numbered from 0. Ordinary
subjects have one segment, so a row is the whole sequence; a subject with millions of admissions gets
many rows instead of one unbounded array. ``length`` is always the length of the whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.columns import quoted
from wardline.plans.ordered import number_rows, ordered_window
from wardline.plans.recurrence import RUN, affine_before
from wardline.plans.skew import FIND, HeavyKeys

# What the padded cells hold.
FEATURE_PAD = 0.0
LABEL_PAD = -1.0

SEGMENT_SIZE = 1_000
BATCH_ROWS = 64
DECAY = 0.5


def sort_subject_sequence(df: DataFrame) -> DataFrame:
    return df.orderBy("subject_id", "admission_no", "hadm_id")


def first_label_per_group(
    df: DataFrame, label: str, key: str = "subject_id", order: tuple[str, ...] = ("admission_no", "hadm_id")
) -> DataFrame:
    """The label on each subject's first admission; combines map-side, no sort."""
    return df.groupBy(key).agg(F.min_by(label, F.struct(*order)).alias(label))


def build_sequences(
    df: DataFrame, features: list[str], label: str, group: str | None = None, segment_size: int = SEGMENT_SIZE,
    heavy: HeavyKeys | None | str = FIND,
) -> DataFrame:
    """``(subject_id, segment, start, steps, n_steps, length[, group_label])``; ``steps`` holds the admissions in order.

    ``start`` is the position of the segment's first step in the whole sequence.
    Each step carries ``admission_no``, ``hadm_id``, the feature array ``x`` (floats) and the label ``y``.
    ``admission_no`` must number a subject's admissions from 1. The group label is the first admission's.
    """
    step = F.struct(
        F.col("admission_no"),
        F.col("hadm_id"),
        F.array(*[F.col(c).cast("float") for c in features]).alias("x"),
        F.col(label).cast("float").alias("y"),
    )
    segment = F.expr(f"CAST((admission_no - 1) DIV {segment_size} AS INT)")
    whole = ordered_window(
        df.withColumn("_one", F.lit(1)), ["subject_id"], ["admission_no", "hadm_id"],
        group_sum={"_length": "_one"}, group_first={"_group": group} if group else None, heavy=heavy,
    )
    return whole.groupBy("subject_id", segment.alias("segment"), (segment * segment_size).alias("start")).agg(
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.count(F.lit(1)).alias("n_steps"),
        F.max("_length").alias("length"),
        *([F.max("_group").alias("group_label")] if group else []),
    )


def pad_sequences(sequences: DataFrame, n_features: int, to_length: int) -> DataFrame:
    """Segments as fixed-length arrays: ``x`` padded with zero rows, ``y`` with -1, plus ``mask``.

    ``to_length`` is the longest segment (see :func:`longest_segment`) or the length of a bucket; a
    longer segment would lose admissions, so it is refused at run time.
    """
    size = F.size("steps")
    checked = F.when(size <= to_length, size).otherwise(
        F.raise_error(F.concat(F.lit("segment longer than padding: "), size.cast("string"))).cast("int")
    )
    missing = F.lit(to_length) - checked
    blank = F.array_repeat(F.lit(FEATURE_PAD).cast("float"), n_features)
    return sequences.select(
        *[c for c in sequences.columns if c not in ("steps", "n_steps")],
        F.concat(F.transform("steps", lambda s: s["x"]), F.array_repeat(blank, missing)).alias("x"),
        F.concat(
            F.transform("steps", lambda s: s["y"]), F.array_repeat(F.lit(LABEL_PAD).cast("float"), missing)
        ).alias("y"),
        F.transform(F.sequence(F.lit(1), F.lit(to_length)), lambda i: i <= size).alias("mask"),
    )


def longest_segment(sequences: DataFrame) -> int:
    """Counts only: the arrays are not built for it."""
    return sequences.agg(F.max("n_steps")).first()[0] or 0


def unroll(padded: DataFrame) -> DataFrame:
    """One row per cell of the padded arrays: ``pos`` in the whole sequence (from 0), ``x``, ``y`` and ``is_real``."""
    others = [c for c in padded.columns if c not in ("x", "y", "mask", "start")]
    zipped = F.posexplode_outer(F.arrays_zip("x", "y", "mask")).alias("_at", "cell")
    return padded.select(*others, "start", zipped).select(
        *others, (F.col("start") + F.col("_at")).alias("pos"), F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), F.col("cell.mask").alias("is_real")
    )


def mask_padding(padded: DataFrame) -> DataFrame:
    """Real cells only, told by position and not by value, so a real label of -1 survives.

    Padding is cut off the arrays before they become rows.
    """
    real = F.size(F.filter("mask", lambda m: m))
    cut = {c: F.slice(c, F.lit(1), real) for c in ("x", "y", "mask")}
    return unroll(padded.withColumns(cut).where(F.size("mask") > 0)).drop("is_real")


def lag_features(df: DataFrame, columns: list[str], heavy: HeavyKeys | None | str = FIND) -> DataFrame:
    """Earlier admissions as features: last value, mean, sum and maximum of each column, and how many.

    Only rows before the current one count, so a label column may be used as a feature safely.
    """
    kept = {f"_v_{c}": F.col(c).cast("double") for c in columns}
    seen = {f"_k_{c}": F.col(c).isNotNull().cast("long") for c in columns}
    run = ordered_window(
        df.withColumns({**kept, **seen}),
        ["subject_id"],
        ["admission_no", "hadm_id"],
        lag={f"{c}_prev": f"_v_{c}" for c in columns},
        sum_before={
            **{f"{c}_prev_sum": f"_v_{c}" for c in columns},
            **{f"_seen_{c}": f"_k_{c}" for c in columns},
        },
        max_before={f"{c}_prev_max": f"_v_{c}" for c in columns},
        heavy=heavy,
    )
    means: dict[str, Column] = {
        f"{c}_prev_mean": F.try_divide(F.col(f"{c}_prev_sum"), F.col(f"_seen_{c}")) for c in columns
    }
    return run.withColumns(means).drop(*kept, *seen, *[f"_seen_{c}" for c in columns])


def decayed_history(
    df: DataFrame, columns: list[str], factor: float = DECAY, heavy: HeavyKeys | None | str = FIND, run: int = RUN
) -> DataFrame:
    """Adds ``<name>_decayed``: earlier admissions' values, each admission further back weighing ``factor`` as much.

    A recurrent summary of the history: before an admission it is ``factor`` times the summary before the previous one, plus
    that one's value. Nulls add nothing; a first admission has 0.
    """
    numbered = ordered_window(df, ["subject_id"], ["admission_no", "hadm_id"], row_number="_at", heavy=heavy)
    values = F.array(*[F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)) for c in columns])
    ready = numbered.withColumns({"_at": F.col("_at") - 1, "_factor": F.lit(factor), "_values": values})
    out = affine_before(ready, ["subject_id"], "_at", "_factor", "_values", "_state", run)
    found = {f"{c}_decayed": F.col("_state")[i] for i, c in enumerate(columns)}
    return out.withColumns(found).select(*[quoted(c) for c in df.columns], *[quoted(c) for c in found])


def padded_batches(sequences: DataFrame, n_features: int, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Segments in batches of ``batch_rows`` of about equal length, padded to the longest of their batch.

    Segments are numbered in order of length by one range shuffle, so a batch's rows are neighbours and the padding is what
    lengths differ within a batch, not in the table. Adds ``batch`` and ``batch_length`` to what ``pad_sequences`` gives.
    """
    keys = ["subject_id", "segment"]
    numbered = number_rows(sequences, [], ["n_steps", *keys], "_row")
    placed = numbered.withColumn("batch", F.expr(f"CAST(_row DIV {batch_rows} AS BIGINT)")).drop("_row")
    longest = Window.partitionBy("batch")  # batch_rows rows
    sized = placed.withColumn("batch_length", F.max("n_steps").over(longest).cast("int"))
    missing = F.col("batch_length") - F.size("steps")
    blank = F.array_repeat(F.lit(FEATURE_PAD).cast("float"), n_features)
    label = F.lit(LABEL_PAD).cast("float")
    return sized.select(
        *[c for c in sized.columns if c not in ("steps", "n_steps")],
        F.concat(F.transform("steps", lambda s: s["x"]), F.array_repeat(blank, missing)).alias("x"),
        F.concat(F.transform("steps", lambda s: s["y"]), F.array_repeat(label, missing)).alias("y"),
        F.transform(F.sequence(F.lit(1), F.col("batch_length")), lambda i: i <= F.size("steps")).alias("mask"),
    )
