"""Expressions over scores, logits and one-hot groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Group labels and cut-offs that results depend on.
NO_GROUP = "race_UNKNOWN"
FOLD_CHANGE_CUT = 0.4
ADJUSTED_P_CUT = 10e-32
VOLCANO_LABELS = {"neither": "NS", "fold": "FC", "p": "P", "both": "FC_P"}


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softmax_pair(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1 from two logits, shifted by the larger one so neither exponential overflows."""
    top = F.greatest(logit0, logit1)
    e0, e1 = F.exp(logit0 - top), F.exp(logit1 - top)
    return e1 / (e0 + e1)


def argmax_pair(logit0: Column, logit1: Column) -> Column:
    return F.when(logit1 > logit0, 1).otherwise(0)


def threshold_label(score: Column, threshold: float) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def argmax_label(columns: list[str], default: str = NO_GROUP) -> Column:
    """Name of the largest column, the first on ties; ``default`` when all are null or zero."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    known = F.filter(values, lambda v: v.isNotNull())
    nothing = F.forall(known, lambda v: v == 0)
    place = F.array_position(values, F.array_max(values)).cast("int")
    return F.when(nothing, F.lit(default)).otherwise(F.element_at(F.array(*[F.lit(c) for c in columns]), place))


def log2_fold_change(treated_mean: Column, control_mean: Column) -> Column:
    return F.log2(treated_mean + 1) - F.log2(control_mean + 1)


def volcano_class(
    fold: Column, p: Column, fold_cut: float = FOLD_CHANGE_CUT, p_cut: float = ADJUSTED_P_CUT
) -> Column:
    large, small = F.abs(fold) > F.lit(fold_cut), p < F.lit(p_cut)
    return (
        F.when(large & small, VOLCANO_LABELS["both"])
        .when(small, VOLCANO_LABELS["p"])
        .when(large, VOLCANO_LABELS["fold"])
        .otherwise(VOLCANO_LABELS["neither"])
    )


def significant(value: Column, digits: int = 2) -> Column:
    """``value`` rounded to a number of significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - F.lit(digits - 1))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / scale) * scale)
