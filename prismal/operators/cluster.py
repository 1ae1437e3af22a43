"""Clustering and what describes the clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from prismal.plans.scalars import attach_row, rows_from_row

SEED = 42
PARTS = pa.schema([("k", pa.int32()), ("cluster", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), ("total", pa.list_(pa.float64()))])


def vectors(df: DataFrame, columns: Sequence[str], standardize: bool = True):
    """Complete rows with the vector ``_v`` (centred and scaled when asked) and the fitted scaler."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(df.dropna(subset=list(columns)))
    if not standardize:
        return rows.withColumnRenamed("_raw", "_v"), None
    scaler = StandardScaler(inputCol="_raw", outputCol="_v", withMean=True, withStd=True).fit(rows)
    return scaler.transform(rows).drop("_raw"), scaler


def kmeans(df: DataFrame, columns: Sequence[str], k: int, standardize: bool = True) -> DataFrame:
    """Rows with their ``cluster``."""
    rows, _ = vectors(df, columns, standardize)
    return KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=SEED).fit(rows).transform(rows).drop("_v")


def kmeans_centroids(df: DataFrame, columns: Sequence[str], k: int, standardize: bool = True) -> DataFrame:
    """Centroids in original units (k rows)."""
    rows, scaler = vectors(df.select(*columns), columns, standardize)
    centres = [np.asarray(c) for c in KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=SEED).fit(rows).clusterCenters()]
    if scaler is not None:
        centres = [c * scaler.std.toArray() + scaler.mean.toArray() for c in centres]
    return df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)],
                                           "cluster int, " + ", ".join(f"`{c}` double" for c in columns))


def elbow_of(ks: Sequence[int], costs: Sequence[float]) -> int:
    """The k where the normalized cost curve turns most sharply; 1 below three points."""
    if len(ks) < 3:
        return 1
    points = np.column_stack([np.asarray(ks, float), np.asarray(costs, float)])
    span = np.ptp(points, axis=0)
    points = (points - points.min(axis=0)) / np.where(span > 0, span, 1.0)
    steps = np.diff(points, axis=0)
    turns = np.abs(np.diff(np.arctan2(steps[:, 1], steps[:, 0])))
    return int(ks[int(np.argmax(turns)) + 1])


def starts(rows: DataFrame, most: int, sample: int = 2000) -> np.ndarray:
    """Up to ``most`` far-apart rows of a hash-chosen sample of vectors: the first k of them start k clusters."""
    picked = rows.select(vector_to_array("_v").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample).collect()  # at most ``sample`` rows
    points = np.array([r["v"] for r in picked])
    chosen = [int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    rng = np.random.default_rng(SEED)
    while len(chosen) < min(most, len(points)) and near.max() > 0:
        chosen.append(int(rng.choice(len(points), p=near / near.sum())))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def advance(rows: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One step of Lloyd's algorithm for every k at once, in one scan: the new centres, and the cost at the old ones.

    Tasks give one partial sum for each k and cluster; a cluster without rows keeps its centre.
    """

    def run(batches):
        sums = {k: (np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)) for k, c in centres.items()}
        for batch in batches:
            lists = batch.column(0)
            points = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            for k, c in centres.items():
                near = np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ c.T + (c**2).sum(axis=1), 0.0)
                own = near.argmin(axis=1)
                n, cost, total = sums[k]
                n += np.bincount(own, minlength=len(c))
                cost += np.bincount(own, ((points - c[own]) ** 2).sum(axis=1), minlength=len(c))
                np.add.at(total, own, points)
        for k, (n, cost, total) in sums.items():
            for i in range(len(n)):
                yield pa.RecordBatch.from_pydict({"k": [k], "cluster": [i], "n": [n[i]], "cost": [cost[i]], "total": [total[i]]}, schema=PARTS)

    parts = rows.select(vector_to_array("_v").alias("v")).mapInArrow(run, "k int, cluster int, n double, cost double, total array<double>")
    one = parts.select("k", "cluster", "n", "cost", F.posexplode("total").alias("i", "x")).groupBy("k", "cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    moved, costs = {k: c.copy() for k, c in centres.items()}, dict.fromkeys(centres, 0.0)
    for r in one.collect():  # a row for each k, cluster and coordinate
        if r["n"]:
            moved[r["k"]][r["cluster"], r["i"]] = r["x"] / r["n"]
        if r["i"] == 0:
            costs[r["k"]] += r["cost"]
    return moved, costs


def lloyd(rows: DataFrame, centres: dict[int, np.ndarray], steps: int = 20, tolerance: float = 1e-4) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Centres and cost for every k after ``steps`` steps, or when none of its centres moves by more than ``tolerance``."""
    costs, open_ = {}, dict(centres)
    done: dict[int, np.ndarray] = {}
    for _ in range(steps):
        moved, _ = advance(rows, open_)
        still = {k for k in open_ if np.sqrt(((moved[k] - open_[k]) ** 2).sum(axis=1)).max() > tolerance}
        done |= moved
        open_ = {k: moved[k] for k in still}
        if not open_:
            break
    _, costs = advance(rows, done)
    return done, costs


def kmeans_elbow(df: DataFrame, columns: Sequence[str], most: int = 10, standardize: bool = True) -> DataFrame:
    """Cost per k and the elbow, for k up to ``most`` and at most one cluster per 20 rows. Every step advances all k in one scan."""
    rows, _ = vectors(df, columns, standardize)
    rows = rows.select("_v").persist()
    limit = min(most, rows.limit(20 * most).count() // 20)
    costs = {1: _spread(rows)}
    if limit > 1:
        first = starts(rows, limit)
        costs |= lloyd(rows, {k: first[:k] for k in range(2, limit + 1)})[1]
    rows.unpersist()
    best = elbow_of(list(costs), list(costs.values()))
    return df.sparkSession.createDataFrame([(k, float(c), k == best) for k, c in costs.items()], "k int, cost double, is_elbow boolean")


def _spread(rows: DataFrame) -> float:
    """Sum of squared distances from the mean vector: the cost of a single cluster."""
    parts = rows.select(F.posexplode(vector_to_array("_v")).alias("i", "x")).groupBy("i").agg((F.var_pop("x") * F.count("x")).alias("ss"))
    return parts.agg(F.sum("ss")).first()[0] or 0.0


def hierarchical_bisecting(df: DataFrame, columns: Sequence[str], k: int, standardize: bool = True) -> DataFrame:
    """Top-down hierarchical clusters by repeated bisection."""
    rows, _ = vectors(df, columns, standardize)
    return BisectingKMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=SEED).fit(rows).transform(rows).drop("_v")


def pca_2d(df: DataFrame, columns: Sequence[str], keys: Sequence[str], standardize: bool = True) -> DataFrame:
    """Two principal components per row and the share of variance each explains."""
    rows, _ = vectors(df, columns, standardize)
    if not standardize:
        rows = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows).drop("_v").withColumnRenamed("_c", "_v")
    fit = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    share = fit.explainedVariance.toArray()
    p = vector_to_array("_p")
    return fit.transform(rows).select(*keys, p[0].alias("pc1"), p[1].alias("pc2"), F.lit(float(share[0])).alias("explained_1"), F.lit(float(share[1])).alias("explained_2"))


# --- descriptions (given labels) -------------------------------------------------------------


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_profile(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean of every feature per cluster in standard deviations from the overall mean, long form."""
    overall = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"o_{c}") for c in columns])
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean"),
                               F.try_divide(F.col(c) - F.col(f"o_{c}.m"), F.col(f"o_{c}.s")).alias("normalized")) for c in columns])
    return attach_row(means, overall).select(cluster, F.inline(cells))


def cluster_top_features(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", most: int = 5) -> DataFrame:
    """Features whose cluster mean differs most, in percent of the overall mean."""
    overall = df.agg(*[F.avg(c).alias(f"o_{c}") for c in columns])
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.try_divide((F.col(c) - F.col(f"o_{c}")) * 100, F.col(f"o_{c}")).alias("diff_pct"),
                               F.when(F.col(c) > F.col(f"o_{c}"), "higher").otherwise("lower").alias("direction")) for c in columns])
    long = attach_row(means, overall).select(cluster, F.inline(cells))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.abs("diff_pct").desc_nulls_last(), "feature"))  # one row per feature
    return long.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def cluster_samples(df: DataFrame, keys: Sequence[str], cluster: str = "cluster", most: int = 5) -> DataFrame:
    """The first rows per cluster along the key; every task keeps at most ``most`` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(*keys))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def noise_compare(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Noise rows (cluster -1) against all rows: mean, min, max, std and difference in percent."""
    noise = lambda c: F.when(F.col(cluster) == -1, F.col(c))
    row = df.agg(*[F.struct(F.avg(noise(c)).alias("mean"), F.min(noise(c)).alias("min"), F.max(noise(c)).alias("max"),
                            F.stddev_samp(noise(c)).alias("std"), F.avg(c).alias("overall")).alias(f"o_{c}") for c in columns])
    return rows_from_row(row, [
        F.struct(F.lit(c).alias("feature"), F.col(f"o_{c}.mean").alias("noise_mean"), F.col(f"o_{c}.min").cast("double").alias("noise_min"),
                 F.col(f"o_{c}.max").cast("double").alias("noise_max"), F.col(f"o_{c}.std").alias("noise_std"), F.col(f"o_{c}.overall").alias("overall_mean"),
                 F.try_divide((F.col(f"o_{c}.mean") - F.col(f"o_{c}.overall")) * 100, F.col(f"o_{c}.overall")).alias("diff_pct")) for c in columns])


def default_eps(df: DataFrame, columns: Sequence[str], standardize: bool = True) -> float:
    """Half a standard deviation on scaled data, else a tenth of the mean range (one row is read)."""
    if standardize:
        return 0.5
    row = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in columns]).first()
    return 0.1 * sum(row) / len(columns)
