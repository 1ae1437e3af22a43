"""Tail probabilities and quantiles of the usual test distributions.

Used on tiny aggregate frames only (one row per test), as Arrow-batched UDFs so
that the plan stays lazy.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, 2000):
        for numer in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                      -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numer * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + numer / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return total


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    total = d
    for i in range(1, 5000):
        numer = -i * (i - a)
        b += 2.0
        d = numer * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + numer / c
        c = c if abs(c) > _TINY else _TINY
        total *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * total


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_cdf(dof / (dof + t * t), dof / 2.0, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, dof: float) -> float:
    """P(X >= x) for chi-square."""
    return gamma_sf(dof / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def studentized_range_upper(q: float, groups: float, dof: float) -> float:
    """P(Q >= q) for the studentized range, by Gauss-Legendre quadrature over the scale and the smallest mean."""
    if q <= 0:
        return 1.0
    k = int(groups)
    nodes, weights = np.polynomial.legendre.leggauss(96)
    z = 8.0 * nodes
    zw = 8.0 * weights
    density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    erf = np.vectorize(math.erf)

    def cdf(v):
        return 0.5 * (1.0 + erf(v / math.sqrt(2.0)))

    def range_cdf(w: float) -> float:
        return float(k * np.sum(zw * density * (cdf(z + w) - cdf(z)) ** (k - 1)))

    if dof > 20_000:
        return max(0.0, 1.0 - range_cdf(q))
    spread = 8.0 / math.sqrt(2.0 * dof)
    low, high = max(1e-9, 1.0 - spread), 1.0 + spread if dof > 4 else 1.0 + 2 * spread
    s = 0.5 * (high - low) * nodes + 0.5 * (high + low)
    log_density = (math.log(2.0) + dof / 2.0 * math.log(dof / 2.0) - math.lgamma(dof / 2.0)
                   + (dof - 1.0) * np.log(s) - dof * s * s / 2.0)
    mass = 0.5 * (high - low) * weights * np.exp(log_density)
    return float(min(1.0, max(0.0, 1.0 - np.sum(mass * np.array([range_cdf(q * si) for si in s])))))


# MacKinnon response surfaces for the Dickey-Fuller tau with a constant (fixed published values).
ADF_TAU_MIN, ADF_TAU_MAX, ADF_TAU_STAR = -18.83, 2.74, -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf_p_value(tau: float) -> float:
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    surface = ADF_SMALL_P if tau <= ADF_TAU_STAR else ADF_LARGE_P
    return _NORMAL.cdf(sum(c * tau**i for i, c in enumerate(surface)))


def adf_critical_value(level: str, n: float) -> float:
    return sum(c / n**i for i, c in enumerate(ADF_CRITICAL[level]))


def _columnwise(fn):
    def run(*parts: pd.Series) -> pd.Series:
        rows = zip(*parts, strict=True)
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*map(float, row)) for row in rows], dtype="float64")
    return run


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _columnwise(t_two_sided)(t, dof)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _columnwise(f_upper)(f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _columnwise(chi2_upper)(x, dof)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _columnwise(normal_two_sided)(z)


@F.pandas_udf(DoubleType())
def tukey_p_value(q: pd.Series, groups: pd.Series, dof: pd.Series) -> pd.Series:
    return _columnwise(studentized_range_upper)(q, groups, dof)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return _columnwise(_NORMAL.inv_cdf)(p)
