"""Exact k nearest neighbours between two tables, and the vote and mean built on them.

The reference rows are cut into boxes by a tree of written tables. Every query row descends the tree to the boxes
that may hold one of its k nearest, and meets them best-first in waves: the closest boxes that together hold k rows, then
those still within the distance so found, ever more at a time. Boxes with many rows are split by a key hash, so one
task never holds more than a slice. Each meeting returns at most k rows per
query row, so pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.plans.space import box_tree, boxes_in_reach
from prismal.session import materialize

SLICE_ROWS = 50_000
#: Each wave goes to that many times the boxes of the one before.
WAVE = 8
_CHUNK = 4_000_000


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    gap = a[:, None, :] - b[None, :, :]
    return np.sqrt((gap**2).sum(axis=2)) if metric == "euclidean" else np.abs(gap).sum(axis=2)


def _meetings(visits: DataFrame, leaves: DataFrame, slice_rows: int) -> DataFrame:
    """``_box`` with the number of slices of its query rows and of its reference rows; one row for each box visited."""
    slices = lambda n: F.greatest(F.lit(1), F.ceil(n / slice_rows)).cast("long")
    asked = visits.groupBy("_box").agg(slices(F.count(F.lit(1))).alias("_qn"))
    return asked.join(leaves.select("_box", slices(F.col("n")).alias("_rn")), "_box")


def _meet(visits: DataFrame, reference: DataFrame, leaves: DataFrame, columns: Sequence[str], k: int, metric: str, slice_rows: int) -> DataFrame:
    """Best k reference rows per query row inside every (box, query slice, reference slice)."""
    names = list(columns)
    sizes = _meetings(visits, leaves, slice_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left, right = visits.select("_q", *names, "_box").join(sizes, "_box"), reference.join(sizes, "_box")
    left = left.select("_q", *names, "_box", F.pmod(F.xxhash64("_q"), F.col("_qn")).alias("_qs"), every("_rn").alias("_rs"))
    right = right.select("_r", *names, "_box", F.pmod(F.xxhash64("_r"), F.col("_rn")).alias("_rs"), every("_qn").alias("_qs"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_q": [], "_r": [], "distance": []})
        b = b.sort_values("_r")
        pa, pb, keys = a[names].to_numpy("float64"), b[names].to_numpy("float64"), b["_r"].to_numpy()
        parts = []
        step = max(1, _CHUNK // (len(pb) * len(names)))
        for start in range(0, len(pa), step):
            far = _distances(pa[start:start + step], pb, metric)
            order = np.argsort(far, axis=1, kind="stable")[:, :k]
            rows = np.repeat(a["_q"].to_numpy()[start:start + step], order.shape[1])
            parts.append(pd.DataFrame({"_q": rows, "_r": keys[order].ravel(), "distance": np.take_along_axis(far, order, axis=1).ravel()}))
        return pd.concat(parts)

    grouping = ["_box", "_qs", "_rs"]
    return left.groupBy(*grouping).cogroup(right.groupBy(*grouping)).applyInPandas(best, "_q long, _r long, distance double")


def _closest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of the partial results (at most k per box slice met)."""
    w = Window.partitionBy("_q").orderBy("distance", "_r")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, reference: DataFrame, columns: Sequence[str], k: int, query_key: str, reference_key: str,
            metric: str = "euclidean", slice_rows: int = SLICE_ROWS, box_rows: int = SLICE_ROWS) -> DataFrame:
    """``query_key``, ``reference_key``, ``distance`` and ``rank`` 1..k; equal distances go to the lower key. Keys are bigint."""
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    q = queries.dropna(subset=list(columns)).select(F.col(query_key).cast("long").alias("_q"), *doubles)
    r = reference.dropna(subset=list(columns)).select(F.col(reference_key).cast("long").alias("_r"), *doubles)
    tree = box_tree(r, columns, box_rows)
    meet = lambda visits: _meet(visits, tree.rows, tree.leaves, columns, k, metric, slice_rows)
    reach = boxes_in_reach(q, "_q", columns, tree, k, metric)
    if len(tree.levels) == 1:
        found = _closest(meet(reach), k)
    else:
        nearer = Window.partitionBy("_q").orderBy("gap", "_box")
        ahead = F.coalesce(F.sum("n").over(nearer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        later = 1 + F.floor(F.log(F.row_number().over(nearer).cast("double")) / F.log(F.lit(float(WAVE)))).cast("int")
        reach = materialize(reach.withColumn("_wave", F.when(ahead < k, 0).otherwise(later)), "waves")
        found = materialize(_closest(meet(reach.where("_wave = 0")), k), "nearest")
        for wave in range(1, 1 + (reach.agg(F.max("_wave")).first()[0] or 0)):
            bound = found.groupBy("_q").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_have"))
            bound = bound.select("_q", F.when(F.col("_have") >= k, F.col("_far")).otherwise(F.lit(float("inf"))).alias("_far"))
            visits = materialize(reach.where(F.col("_wave") == wave).join(bound, "_q").where("gap <= _far"), "visits")
            if not visits.isEmpty():
                found = materialize(_closest(found.drop("rank").unionByName(meet(visits)), k), "nearest")
    return found.select(F.col("_q").alias(query_key), F.col("_r").alias(reference_key), "distance", "rank")


def _weighted(pairs: DataFrame, weights: str, query_key: str) -> DataFrame:
    """Weight 1, or 1 / distance where an exact hit silences the rest."""
    if weights == "uniform":
        return pairs.withColumn("_w", F.lit(1.0))
    if weights != "distance":
        raise ValueError(f"unknown weights {weights!r}")
    hit = F.min("distance").over(Window.partitionBy(query_key)) == 0  # k rows per query row
    return pairs.withColumn("_w", F.when(hit, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance")))


def knn_classify(queries: DataFrame, train: DataFrame, columns: Sequence[str], target: str, k: int, query_key: str, train_key: str,
                 weights: str = "uniform", metric: str = "euclidean", **sizes) -> DataFrame:
    """Class with the largest vote among the k nearest training rows (the lowest class on ties)."""
    rows = train.where(F.col(target).isNotNull())
    pairs = nearest(queries, rows, columns, k, query_key, train_key, metric, **sizes).join(rows.select(train_key, target), train_key)
    votes = _weighted(pairs, weights, query_key).groupBy(query_key, target).agg(F.sum("_w").alias("vote"))
    best = F.min(F.struct((-F.col("vote")).alias("neg"), F.col(target).alias("label")))
    return votes.groupBy(query_key).agg(best.alias("b")).select(query_key, F.col("b.label").alias("prediction"), (-F.col("b.neg")).alias("vote"))


def knn_regress(queries: DataFrame, train: DataFrame, columns: Sequence[str], target: str, k: int, query_key: str, train_key: str,
                weights: str = "uniform", metric: str = "euclidean", **sizes) -> DataFrame:
    """(Weighted) mean of the target over the k nearest training rows."""
    rows = train.where(F.col(target).isNotNull())
    pairs = nearest(queries, rows, columns, k, query_key, train_key, metric, **sizes).join(rows.select(train_key, target), train_key)
    return _weighted(pairs, weights, query_key).groupBy(query_key).agg((F.sum(F.col("_w") * F.col(target)) / F.sum("_w")).alias("prediction"))
