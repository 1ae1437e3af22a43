"""Chart-ready frames: the numbers behind each chart, ready to draw elsewhere."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions.moments import percent
from prismal.operators.corr import correlation_pairs
from prismal.operators.explore import crosstab_long, group_agg, histogram, pivot_long, value_counts_of
from prismal.plans.counts import long_values
from prismal.plans.ordered import running_totals
from prismal.plans.quantiles import quantile_name, quantiles, summarize
from prismal.plans.scalars import attach_row, union_all


def bar(df: DataFrame, category: str, value: str | None = None, how: str = "sum") -> DataFrame:
    """Counts per category, or an aggregate of a value by category."""
    return value_counts_of(df, category) if value is None else group_agg(df, [category], [value], [how])


def bar_grouped(df: DataFrame, a: str, b: str) -> DataFrame:
    return crosstab_long(df, a, b)


def histogram_density(df: DataFrame, column: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Bin counts with density (integral 1 over all rows)."""
    counts = histogram(df, column, bins, keys)
    total = df.agg(F.count(column).alias("_all"))
    width = F.col("right") - F.col("left")
    return attach_row(counts, total).select(
        *counts.columns, F.try_divide(F.col("n").cast("double"), F.col("_all") * width).alias("density"))


def kde(df: DataFrame, column: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density on an even grid over the data range, Scott bandwidth.

    Equal values collapse first; each task adds up its values on the whole grid,
    so a task emits one row per grid point whatever its input size.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    facts = rows.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = attach_row(rows.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w")), facts)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = grid = None
        for batch in batches:
            if batch.empty:
                continue
            n, s, lo, hi = (float(batch[c].iloc[0]) for c in ("n", "s", "lo", "hi"))
            if grid is None:
                grid, total, h = np.linspace(lo, hi, points), np.zeros(points), s * n ** -0.2
            v, w = batch["v"].to_numpy(), batch["w"].to_numpy()
            for start in range(0, len(v), 2000):
                z = (grid[:, None] - v[None, start:start + 2000]) / h
                total += np.exp(-0.5 * z * z) @ w[start:start + 2000]
        if grid is not None:
            yield pd.DataFrame({"i": np.arange(points), "x": grid, "part": total / (n * h * np.sqrt(2 * np.pi))})

    parts = cells.where("s > 0").mapInPandas(add_up, "i int, x double, part double")
    return parts.groupBy("i").agg(F.first("x").alias("x"), F.sum("part").alias("density"))


def box(df: DataFrame, value: str, by: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier count, by group."""
    keys = [by] if by else []
    rows = df.dropna(subset=[*keys, value]).select(*keys, F.col(value).cast("double").alias("v"))
    q = F.col(quantile_name("v"))
    cuts = quantiles(rows, ["v"], [0.25, 0.5, 0.75], keys)
    tagged = attach_row(rows, cuts) if not by else rows.join(cuts, by)
    inside = F.col("v").between(q[0] - k * (q[2] - q[0]), q[2] + k * (q[2] - q[0]))
    return tagged.groupBy(*keys).agg(
        F.count("v").alias("n"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.first(q[0]).alias("q1"),
        F.first(q[1]).alias("median"), F.first(q[2]).alias("q3"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def box_outliers(df: DataFrame, value: str, by: str, k: float = 1.5) -> DataFrame:
    rows = df.dropna(subset=[by, value])
    q = F.col(quantile_name(value))
    tagged = rows.join(quantiles(rows, [value], [0.25, 0.75], [by]), by)
    return tagged.where((F.col(value) < q[0] - k * (q[1] - q[0])) | (F.col(value) > q[1] + k * (q[1] - q[0]))).select(*df.columns)


def pie(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    parts = (value_counts_of(df, category).select(category, F.col("n").cast("double").alias("amount")) if value is None
             else group_agg(df, [category], [value], ["sum"]).select(category, F.col(f"{value}_sum").cast("double").alias("amount")))
    return attach_row(parts, parts.agg(F.sum("amount").alias("_all"))).select(category, "amount", percent(F.col("amount"), F.col("_all")).alias("share"))


def line(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    columns = [x, y] + ([colour] if colour else [])
    return df.select(*columns).dropna(subset=[x]).orderBy(*([colour] if colour else []), x)


def area_share(df: DataFrame, x: str, series: str, value: str) -> DataFrame:
    """Stacked areas: value per (x, series) and its percentage of the total of x."""
    cells = df.groupBy(x, series).agg(F.sum(value).alias("value"))
    totals = cells.groupBy(x).agg(F.sum("value").alias("_total"))
    return cells.join(totals, x).select(x, series, "value", percent(F.col("value"), F.col("_total")).alias("share"))


def point_sample(df: DataFrame, columns: Sequence[str], keys: Sequence[str], most: int | None = None, seed: int = 42) -> DataFrame:
    """All complete points, or ``most`` of them chosen by a hash of the key."""
    kept = [*keys, *[c for c in columns if c not in keys]]
    points = df.select(*kept).dropna(subset=list(columns))
    return points if most is None else points.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(most)


def scatter_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares line on an even grid over x, with r2; fitted on all rows."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    both = cx.isNotNull() & cy.isNotNull()
    fit = df.where(both).agg(F.regr_slope(cy, cx).alias("b"), F.regr_intercept(cy, cx).alias("a"), F.regr_r2(cy, cx).alias("r2"),
                             F.min(cx).alias("lo"), F.max(cx).alias("hi"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        "i", at.alias("x"), (F.col("a") + F.col("b") * at).alias("y"), "r2")


def bubble(df: DataFrame, x: str, y: str, size: str, colour: str, keys: Sequence[str], most: int | None = None) -> DataFrame:
    return point_sample(df, [x, y, size, colour], keys, most)


def scatter_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str], most: int | None = None) -> DataFrame:
    return point_sample(df, columns, keys, most)


def funnel(df: DataFrame, stage: str, value: str | None = None) -> DataFrame:
    """Stages by falling amount with their percentage of the first stage."""
    parts = pie(df, stage, value).select(stage, "amount")
    return attach_row(parts, parts.agg(F.max("amount").alias("_first"))).select(
        stage, "amount", percent(F.col("amount"), F.col("_first")).alias("pct_of_first")).orderBy(F.col("amount").desc(), stage)


def waterfall(df: DataFrame, step: str, value: str, blocks: int | None = None) -> DataFrame:
    """Running total over the ordered steps and a final total row."""
    parts = df.where(F.col(step).isNotNull()).groupBy(F.col(step).alias("step")).agg(F.sum(value).alias("amount"))
    run = running_totals(parts, "step", {"running": "amount"}, blocks=blocks).select(F.col("step").cast("string").alias("step"), "amount", "running")
    total = parts.agg(F.sum("amount").alias("amount")).select(F.lit("Total").alias("step"), "amount", F.col("amount").alias("running"))
    return union_all([run, total])


def hierarchy(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Totals of every path prefix with its level (0 is the whole)."""
    kept = df.dropna(subset=list(path))
    level = sum((1 - F.grouping(p).cast("int") for p in path), F.lit(0))
    return kept.rollup(*path).agg(F.sum(value).alias("total"), level.alias("level"))


def heatmap_correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Full square in long form, diagonal 1."""
    half = correlation_pairs(df, columns, method)
    turned = half.select(F.col("var_2").alias("var_1"), F.col("var_1").alias("var_2"), "corr")
    diagonal = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("var_1")).select(
        "var_1", F.col("var_1").alias("var_2"), F.lit(1.0).alias("corr"))
    return union_all([half, turned, diagonal])


def heatmap_pivot(df: DataFrame, index: str, columns: str, value: str, how: str = "mean") -> DataFrame:
    return pivot_long(df, index, columns, value, how)


def density2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Row counts per cell of an even grid (right-closed, lowest value included)."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    span = rows.agg(*[fn(c).alias(f"{fn.__name__}_{c}") for c in ("x", "y") for fn in (F.min, F.max)])

    def place(c: str) -> Column:
        width = (F.col(f"max_{c}") - F.col(f"min_{c}")) / bins
        return F.when(width > 0, F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(c) - F.col(f"min_{c}")) / width).cast("int")))).otherwise(1)

    return attach_row(rows, span).groupBy(place("x").alias("x_bin"), place("y").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def radar(df: DataFrame, series: str, axes: Sequence[str]) -> DataFrame:
    """Mean of every axis per series, long form."""
    means = df.groupBy(series).agg(*[F.avg(a).alias(a) for a in axes])
    return means.unpivot([series], list(axes), "axis", "value")


def geo_points(df: DataFrame, lat: str, lon: str, size: str | None = None) -> DataFrame:
    """Points with valid coordinates."""
    kept = df.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"), *([F.col(size).alias("size")] if size else []))
    return kept.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def facets(df: DataFrame, by: str, column: str, bins: int = 10) -> DataFrame:
    """Histogram per facet over one common range."""
    return histogram(df.where(F.col(by).isNotNull()), column, bins, [by])


# --- two datasets ----------------------------------------------------------------------------


def stacked(first: DataFrame, second: DataFrame, columns: Sequence[str], names: Sequence[str] = ("first", "second")) -> DataFrame:
    return union_all([d.select(F.lit(n).alias("dataset"), *columns) for d, n in zip((first, second), names)])


def compare_stats(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Five-number summary and mean per dataset and column."""
    long = long_values(both, columns, ["dataset"])
    keys = ["dataset", "column"]
    moments = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")]
    q = F.col(quantile_name("value"))
    return summarize(long, moments, ["value"], [0.25, 0.5, 0.75], keys).select(
        *keys, "n", "mean", "min", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), "max")


def compare_histogram(both: DataFrame, column: str, bins: int = 20) -> DataFrame:
    return histogram(both, column, bins, ["dataset"])


def compare_counts(both: DataFrame, column: str) -> DataFrame:
    return both.where(F.col(column).isNotNull()).groupBy("dataset", column).agg(F.count(F.lit(1)).alias("n"))


def compare_values(both: DataFrame, x: str, y: str, how: str = "mean") -> DataFrame:
    return group_agg(both, ["dataset", x], [y], [how])


def compare_correlations(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of each pair in both datasets and the difference."""
    a, b = (correlation_pairs(d, columns).withColumnRenamed("corr", f"corr_{i}") for i, d in ((1, first), (2, second)))
    return a.join(b, ["var_1", "var_2"]).withColumn("difference", F.col("corr_2") - F.col("corr_1"))
