"""Tail probabilities of test statistics, for tables of few rows (one per test)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi_square(x: pd.Series, degrees: pd.Series) -> pd.Series:
    """P(X > x)."""
    return pd.Series([gamma_tail(k / 2, v / 2) for v, k in zip(x, degrees)])


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z])


@F.pandas_udf(DoubleType())
def correlation_two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
    """Of Pearson's r over n pairs, by Student's t with n - 2 degrees of freedom."""
    return pd.Series([math.nan if k < 3 else beta_part((k - 2) / 2, 0.5, max(0.0, 1 - v * v)) for v, k in zip(r, n)])
