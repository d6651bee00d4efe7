"""p-values of test statistics: one Arrow batch of report rows at a time."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_SMALL = 8  # largest small side with an exact null distribution


def _tail_series(m: int) -> tuple[int, list[int]]:
    """Period L and numerator A(q) of 1 / ((1-q)(1-q)(1-q^2)...(1-q^m)) = A(q) / (1-q^L)^(m+1)."""
    period = math.lcm(*range(1, m + 1))
    series = np.array([1], dtype=object)
    for part in [1, *range(1, m + 1)]:
        steps = np.zeros(period - part + 1, dtype=object)
        steps[::part] = 1
        series = np.convolve(series, steps)
    return period, series.tolist()


def _free_partitions(v: int, m: int, period: int, series: list[int]) -> int:
    """Partitions of every size up to v into parts 1..m."""
    return sum(
        series[j] * math.comb((v - j) // period + m, m) for j in range(v % period, min(v, len(series) - 1) + 1, period)
    )


def exact_tail(u: int, m: int, n: int) -> float:
    """P(U <= u) without ties, m <= 8 rows against n: inclusion-exclusion on the size limit, exact for any n."""
    total, tail = 0, _tail_series(m)
    for size in range(m + 1):
        for chosen in combinations(range(1, m + 1), size):
            left = u - sum(n + i for i in chosen)
            if left >= 0:
                total += (-1) ** size * _free_partitions(left, m, *tail)
    return total / math.comb(m + n, m)


def rank_test_p(u1: float, n1: int, n2: int, z: float, ties: bool) -> float:
    if n1 < 2 or n2 < 2:
        return math.nan
    if min(n1, n2) <= _SMALL and not ties:
        m, n = int(min(n1, n2)), int(max(n1, n2))
        u = int(min(u1, n1 * n2 - u1))
        return min(1.0, 2 * exact_tail(u, m, n))
    return 1.0 if math.isnan(z) else min(1.0, math.erfc(z / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_test_p(*row) for row in zip(u1, n1, n2, z, ties)], dtype="float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    start = 1 - (a + b) * x / (a + 1)
    c, d = 1.0, 1 / (start if abs(start) > tiny else tiny)
    h = d
    for k in range(1, 500):
        for num in (
            k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)),
            -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


_LARGE_DOF = 1e6  # beyond it the expansion errs by less than 1e-8 of the tail


def student_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > _LARGE_DOF:  # next to the normal limit; the fraction below would lose digits
        return math.erfc(abs(t) * (1 - 1 / (4 * df)) / math.sqrt(2 * (1 + t * t / (2 * df))))
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return float(x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(float(x), float(d)) for x, d in zip(t, df)], dtype="float64")
