"""Tail probabilities as Arrow functions over one row per group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    fraction = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            fraction *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) * fraction / a


def correlation_p(r: float, n: float) -> float | None:
    """Two-sided p of a correlation from the t distribution with n - 2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return beta_share(df / 2, 0.5, 1 - r * r)


def chi_square_p(x: float, df: int) -> float | None:
    """Upper tail of the chi-square distribution for an odd number of degrees of freedom."""
    if x is None or math.isnan(x):
        return None
    tail = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, df, 2):
        tail += term
        term *= x / (k + 2)
    return tail


@F.pandas_udf(T.DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def month_chi_p_udf(x: pd.Series) -> pd.Series:
    return pd.Series([chi_square_p(a, 11) for a in x], dtype="float64")
