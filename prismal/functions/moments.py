"""Sample-corrected moments (Spark's own skewness and kurtosis are population moments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skew(c: Column | str) -> Column:
    """Bias-corrected skewness; null below 3 values, 0 for constant data."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    scale = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(F.skewness(c) * scale)


def sample_kurtosis(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis; null below 4 values, 0 for constant data."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    body = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, None).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(body)


def pair_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are present; null where either side is constant."""
    x, y = F.col(a), F.col(b)
    spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))
