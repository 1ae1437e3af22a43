"""Outlying rows by fences, z-score and isolation forest, with summary and context."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prismal.functions.moments import percent
from prismal.operators.explore import share_ratio
from prismal.plans.quantiles import quantile_name, quantiles
from prismal.plans.scalars import attach_row
from prismal.session import materialize


def fence_width(sensitivity: float) -> float:
    return 1.5 * 5.0 / sensitivity


def anomalies_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the fences, scored by distance from the median in iqr units."""
    q = F.col(quantile_name(column))
    x, iqr = F.col(column), q[2] - q[0]
    tagged = attach_row(df, quantiles(df, [column], [0.25, 0.5, 0.75]))
    low, high = q[0] - k * iqr, q[2] + k * iqr
    return tagged.where((x < low) | (x > high)).select(
        *df.columns, F.try_divide(F.abs(x - q[1]), iqr).alias("score"), F.when(x > high, "high").otherwise("low").alias("direction"))


def anomalies_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    x = F.col(column)
    tagged = attach_row(df, df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s")))
    score = F.abs(F.try_divide(x - F.col("_m"), F.col("_s")))
    return tagged.where(score > threshold).select(
        *df.columns, score.alias("score"), F.when(x > F.col("_m"), "high").otherwise("low").alias("direction"))


def anomaly_summary(df: DataFrame, anomalies: DataFrame, column: str) -> DataFrame:
    """Anomaly count, share of the non-missing rows, and high / low shares."""
    total = df.agg(F.count(column).alias("_n"))
    row = anomalies.agg(F.count(F.lit(1)).alias("anomalies"), F.count_if(F.col("direction") == "high").alias("_high"))
    return attach_row(row, total).select(
        "anomalies", percent(F.col("anomalies"), F.col("_n")).alias("anomaly_pct"),
        percent(F.col("_high"), F.col("anomalies")).alias("high_pct"),
        percent(F.col("anomalies") - F.col("_high"), F.col("anomalies")).alias("low_pct"))


def anomaly_context(df: DataFrame, column: str, by: str, k: float = 1.5) -> DataFrame:
    """How much more often each category occurs among the fence anomalies than overall."""
    q = F.col(quantile_name(column))
    tagged = attach_row(df.where(F.col(column).isNotNull()), quantiles(df, [column], [0.25, 0.75]))
    outside = (F.col(column) < q[0] - k * (q[1] - q[0])) | (F.col(column) > q[1] + k * (q[1] - q[0]))
    return share_ratio(tagged, by, outside)


# --- isolation forest ------------------------------------------------------------------------

TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _expected_depth(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n leaves."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """One random tree over a small sample, as node rows."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(2, len(points))))
    rows: list[list] = []
    stack = [(points, 0, -1, "")]
    while stack:
        part, depth, parent, side = stack.pop()
        node = len(rows)
        if parent >= 0:
            rows[parent][4 if side == "left" else 5] = node
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            rows.append([tree, node, -1, 0.0, -1, -1, depth + _expected_depth(len(part))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        rows.append([tree, node, feature, cut, -1, -1, 0.0])
        below = part[:, feature] < cut
        stack.append((part[~below], depth + 1, node, "right"))
        stack.append((part[below], depth + 1, node, "left"))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])


def isolation_forest(df: DataFrame, columns: Sequence[str], keys: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> tuple[DataFrame, int]:
    """The node rows of random trees (``TREE_SCHEMA``) and the rows each tree is grown from.

    Rows are dealt to trees by a hash of the key, each to so many trees that all get enough; a tree takes the ``sample`` rows of the lowest
    second hash. Every tree grows in a group of its own; no row of the data goes to the driver.
    """
    rows = df.dropna(subset=list(columns)).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    total = rows.count()
    times = min(trees, max(1, math.ceil(2 * trees * sample / max(total, 1))))
    first = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(trees)).cast("int")
    dealt = rows.select(*columns, F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: F.pmod(first + i, F.lit(trees)))).alias("_tree"),
                        F.xxhash64(*keys, F.lit(seed + 1)).alias("_draw"))
    dealt = dealt.withColumn("_draw", F.xxhash64("_draw", "_tree"))
    order = Window.partitionBy("_tree").orderBy("_draw", *columns)
    picked = dealt.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= sample)  # cut within the tasks first

    def plant(part: pd.DataFrame) -> pd.DataFrame:
        return _grow(part.sort_values("_place")[list(columns)].to_numpy(dtype="float64"), int(part["_tree"].iloc[0]), seed)

    return picked.groupBy("_tree").applyInPandas(plant, TREE_SCHEMA), min(sample, total)


def path_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str], forest: DataFrame, size: int) -> DataFrame:
    """Every complete row with its score by the given trees, which were grown from ``size`` rows each."""
    columns = list(columns)
    nodes = forest.toPandas().sort_values(["tree", "node"])  # the forest alone: two rows at most for each row a tree is grown from
    grown = [g[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, g in nodes.groupby("tree")]
    scale = max(_expected_depth(size), 1e-12)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[columns].to_numpy(dtype="float64")
            total = np.zeros(len(values))
            at_row = np.arange(len(values))
            for tree in grown:
                feature, left, right = (tree[:, i].astype(int) for i in (0, 2, 3))
                at = np.zeros(len(values), dtype=int)
                while (inner := feature[at] >= 0).any():
                    below = values[at_row, np.maximum(feature[at], 0)] < tree[at, 1]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                total += tree[at, 4]
            yield batch.assign(score=2.0 ** (-(total / len(grown)) / scale))

    rows = df.dropna(subset=columns).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInPandas(score, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def isolation_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str], trees: int = 100, sample: int = 256,
                     seed: int = 42) -> DataFrame:
    """Isolation-forest score (higher is more isolated) for every complete row, by Arrow batches."""
    forest, size = isolation_forest(df, columns, keys, trees, sample, seed)
    return path_scores(df, columns, keys, forest, size)


def anomalies_iforest(df: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str], sensitivity: float = 1.0,
                      seed: int = 42) -> DataFrame:
    """The most isolated share of rows; contamination is 5 % per unit of sensitivity, within 1 % .. 50 %."""
    contamination = max(0.01, min(0.5, 0.1 * sensitivity / 2.0))
    scored = materialize(isolation_scores(df, columns, keys, seed=seed), "scores")  # read by every pass of the quantile, the mean and the answer
    cut = quantiles(scored, ["score"], [1.0 - contamination])
    mean = scored.agg(F.avg(target).alias("_mean"))
    tagged = attach_row(attach_row(scored, cut), mean)
    return tagged.where(F.col("score") > F.col(quantile_name("score"))[0]).select(
        *scored.columns, F.when(F.col(target) > F.col("_mean"), "high").otherwise("low").alias("direction"))
