"""Encoding, scaling, transforms, binning and date features."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.operators.profile import distinct_profile
from prismal.plans.ordered import value_ranks
from prismal.plans.quantiles import quantile_name, quantiles
from prismal.plans.scalars import attach_row
from prismal.plans.sizing import may_broadcast
from prismal.sources.tables import roles

# --- encoding --------------------------------------------------------------------------------


def categories_of(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values: one for each column that ``one_hot`` makes of them. See ``one_hot_vector`` for wide columns."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().collect()
    return sorted(r["v"] for r in rows)


def one_hot_vector(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """One sparse vector column in place of one column for each category: any number of categories fits."""
    text = df.withColumn("_text", F.col(column).cast("string"))
    index = StringIndexer(inputCol="_text", outputCol="_code", stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCol="_code", outputCol=out or f"{column}_hot", dropLast=True)  # the last is the missing value
    return Pipeline(stages=[index, hot]).fit(text).transform(text).drop("_text", "_code")


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None, drop_first: bool = False,
            keep: bool = True) -> DataFrame:
    """One 0/1 column ``<column>_<category>`` per category."""
    values = list(categories) if categories is not None else categories_of(df, column)
    values = values[1:] if drop_first else values
    flags = {f"{column}_{re.sub(r'[.`]', '_', v)}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in values}
    out = df.withColumns(flags)
    return out if keep else out.drop(column)


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Codes 0..k-1 in lexical order; missing values are the label ``MISSING_VALUE``."""
    out = out or f"{column}_encoded"
    label = F.coalesce(F.col(column).cast("string"), F.lit("MISSING_VALUE"))
    tagged = df.withColumn("_label", label)
    counts = tagged.groupBy("_label").agg(F.count(F.lit(1)).alias("n"))
    codes = value_ranks(counts, "_label").select("_label", (F.col("dense_rank") - 1).cast("int").alias(out))
    return tagged.join(F.broadcast(codes) if may_broadcast(codes) else codes, "_label").select(*df.columns, out)


def ordinal_encode(df: DataFrame, column: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Position in the given order; missing becomes -1."""
    code = F.when(F.col(column).isNull(), -1)
    for i, v in enumerate(order):
        code = code.when(F.col(column) == v, i)
    return df.withColumn(out or f"{column}_ordinal", code)


def auto_encode(df: DataFrame, columns: Sequence[str] | None = None, most: int = 10) -> DataFrame:
    """One-hot text columns of few values in place of the source; wider columns stay as they are."""
    columns = list(columns or roles(df)["categorical"])
    unique = {r["column"]: r["unique"] for r in distinct_profile(df, columns).collect()}  # one row per column
    for c in columns:
        if unique[c] <= most:
            df = one_hot(df, c, keep=False)
    return df


# --- scaling ---------------------------------------------------------------------------------


def _scaled(df: DataFrame, row: DataFrame, scaled: dict[str, Column]) -> DataFrame:
    return attach_row(df, row).select(*df.columns, *[c.alias(name) for name, c in scaled.items()])


def minmax_scale(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``<column>_minmax``: (x - min) / (max - min) stretched to [low, high]; null for a constant column."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"r_{c}") for c in columns])
    return _scaled(df, row, {
        f"{c}_minmax": F.try_divide(F.col(c) - F.col(f"r_{c}.lo"), F.col(f"r_{c}.hi") - F.col(f"r_{c}.lo")) * (high - low) + low
        for c in columns})


def standard_scale(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """``<column>_std``: (x - mean) / std, sample std unless ``population``; null for a constant column."""
    std = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.struct(F.avg(c).alias("m"), std(c).alias("s")).alias(f"r_{c}") for c in columns])
    return _scaled(df, row, {f"{c}_std": F.try_divide(F.col(c) - F.col(f"r_{c}.m"), F.col(f"r_{c}.s")) for c in columns})


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_robust``: (x - median) / iqr."""
    row = quantiles(df, columns, [0.25, 0.5, 0.75])
    q = {c: F.col(quantile_name(c)) for c in columns}
    return _scaled(df, row, {f"{c}_robust": F.try_divide(F.col(c) - q[c][1], q[c][2] - q[c][0]) for c in columns})


# --- transforms ------------------------------------------------------------------------------


def _positive_shift(df: DataFrame, column: str) -> DataFrame:
    low = F.min(column).cast("double")
    return df.agg(F.when(low <= 0, F.abs(low) + 1).otherwise(0.0).alias("_shift"))


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """``<column>_log``: ln(x + shift), where the shift lifts a non-positive minimum to 1."""
    return _scaled(df, _positive_shift(df, column), {f"{column}_log": F.log(F.col(column) + F.col("_shift"))})


def sqrt_transform(df: DataFrame, column: str, signed: bool = False) -> DataFrame:
    """``<column>_sqrt``: sqrt(x + abs(min)) for a negative minimum, or sign(x) * sqrt(abs(x))."""
    if signed:
        return df.withColumn(f"{column}_sqrt", F.signum(column) * F.sqrt(F.abs(column)))
    low = F.min(column).cast("double")
    row = df.agg(F.when(low < 0, F.abs(low)).otherwise(0.0).alias("_shift"))
    return _scaled(df, row, {f"{column}_sqrt": F.sqrt(F.col(column) + F.col("_shift"))})


def boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def boxcox_lambda(df: DataFrame, column: str, low: float = -3.0, high: float = 3.0, points: int = 25, rounds: int = 4) -> float:
    """Maximum-likelihood lambda: each round is one aggregate over a lambda grid, narrowed around the best."""
    shifted = attach_row(df.select(column), _positive_shift(df, column)).select((F.col(column) + F.col("_shift")).alias("x"))
    x = F.col("x")
    best = 1.0
    for _ in range(rounds):
        grid = [float(v) for v in np.linspace(low, high, points)]
        row = shifted.agg(F.count("x").alias("n"), F.sum(F.log(x)).alias("logs"),
                          *[F.var_pop(boxcox(x, lam)).alias(f"v{i}") for i, lam in enumerate(grid)]).first()
        like = [-row["n"] / 2 * math.log(row[f"v{i}"]) + (lam - 1) * row["logs"] if row[f"v{i}"] else -math.inf
                for i, lam in enumerate(grid)]
        at = int(np.argmax(like))
        best = grid[at]
        low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return best


def boxcox_transform(df: DataFrame, column: str, lam: float | None = None) -> DataFrame:
    """``<column>_boxcox`` on values shifted to positive; lambda fitted unless given."""
    lam = boxcox_lambda(df, column) if lam is None else lam
    return _scaled(df, _positive_shift(df, column), {f"{column}_boxcox": boxcox(F.col(column) + F.col("_shift"), lam)})


# --- bins (right-closed, lowest value included) ----------------------------------------------


def bin_equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    row = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(column) - F.col("_lo")) / width).cast("int")))
    number = F.when(F.col(column).isNotNull(), F.when(width > 0, place).otherwise(F.lit(1)))
    return _scaled(df, row, {f"{column}_binned": F.concat(F.lit("Bin "), number.cast("string"))})


def bin_equal_freq(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Quantile edges; repeated edges merge, so a heavy value gives fewer bins."""
    row = quantiles(df, [column], [i / bins for i in range(bins + 1)]).select(
        F.array_distinct(quantile_name(column)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    number = F.when(F.col(column).isNotNull(), F.greatest(F.lit(1), below))
    return _scaled(df, row, {f"{column}_binned": F.concat(F.lit("Bin "), number.cast("string"))})


def bin_custom(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must grow")
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    c = F.col(column)
    label = F.when((c >= edges[0]) & (c <= edges[1]), labels[0])
    for low, high, name in zip(edges[1:], edges[2:], labels[1:]):
        label = label.when((c > low) & (c <= high), name)
    return df.withColumn(f"{column}_binned", label)


def bin_counts(binned: DataFrame, column: str) -> DataFrame:
    c = f"{column}_binned"
    return binned.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


# --- dates -----------------------------------------------------------------------------------


def date_features(df: DataFrame, column: str, since: str) -> DataFrame:
    c = F.col(column)
    return df.withColumns({
        f"{column}_weekday": F.weekday(c), f"{column}_month": F.month(c), f"{column}_year": F.year(c),
        f"{column}_quarter": F.quarter(c), f"{column}_is_weekend": F.weekday(c) >= 5,
        f"{column}_days_since": F.date_diff(c, F.lit(since).cast("date")).cast("long")})
