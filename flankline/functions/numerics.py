"""Distribution functions that Spark lacks. They run as Arrow UDFs over rows that are already aggregated."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: the tables with the same margins that are no likelier than this one."""
    row, col, n = a + b, a + c, a + b + c + d
    if 0 in (row, col, n - row, n - col):
        return 1.0
    base = _log_choose(n, col)
    log_p = [_log_choose(row, x) + _log_choose(n - row, col - x) - base for x in range(max(0, col - (n - row)), min(row, col) + 1)]
    here = log_p[a - max(0, col - (n - row))]
    return min(1.0, math.fsum(math.exp(p) for p in log_p if p <= here + 1e-7))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < q else (low, mid)
    return (low + high) / 2


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        k = i * (a - i)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(DoubleType())
def fisher_p_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def erfc_udf(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


@F.pandas_udf(DoubleType())
def beta_quantile_udf(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([beta_quantile(*t) for t in zip(q, a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def chi_square_tail_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([gamma_tail(k / 2, v / 2) for v, k in zip(x, dof, strict=True)], dtype=float)
