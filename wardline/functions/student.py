"""Two-sided p-value of Student's t: a small numpy helper applied to Arrow batches of test results.

It runs on one row per test (measure or code), never on data rows. The upper tail is computed
directly so that values far below machine epsilon keep their digits.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ship this helper with the task, so that workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEPS = 300
_TINY = 1e-300


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), element-wise."""

    def keep(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < _TINY, _TINY, v)

    c = np.ones_like(x)
    d = 1.0 / keep(1.0 - (a + b) * x / (a + 1.0))
    total = d.copy()
    for m in range(1, _STEPS + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 / keep(1.0 + term * d)
            c = keep(1.0 + term / c)
            total = total * d * c
    return total


def _upper(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), choosing the fast-converging side."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    norm = lgamma(a + b) - lgamma(a) - lgamma(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(norm + a * np.log(x) + b * np.log1p(-x))
    direct = x < (a + 1.0) / (a + b + 2.0)
    left = front * _beta_fraction(np.where(direct, x, 0.0), a, b) / a
    right = 1.0 - front * _beta_fraction(np.where(direct, 0.0, 1.0 - x), b, a) / b
    return np.where(direct, left, right)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom; NaN when either is missing."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    known = ~(np.isnan(t) | np.isnan(df))
    tt, dd = t[known], df[known]
    if tt.size:
        out[known] = np.where(tt == 0, 1.0, _upper(dd / (dd + tt * tt), dd / 2.0, np.full_like(dd, 0.5)))
    return out


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Column form of :func:`two_sided_p`; unknown results are null."""
    p = pd.Series(two_sided_p(t.to_numpy(float), df.to_numpy(float)), index=t.index)
    return p.astype(object).where(p.notna(), None)
