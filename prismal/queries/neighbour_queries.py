"""Nearest neighbours over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.operators import density as db
from prismal.operators import neighbours as nb
from prismal.queries.registry import query

AXES = ["x", "y"]
PAIRS = """
WITH q AS (SELECT s_suppkey AS q, s_acctbal / 1000 AS x, s_nationkey / 5.0::DOUBLE AS y FROM supplier),
 r AS (SELECT c_custkey AS r, c_acctbal / 1000 AS x, c_nationkey / 5.0::DOUBLE AS y, c_mktsegment AS g, c_acctbal AS v FROM customer),
 p AS (SELECT q, r, g, v, {d} AS distance FROM q, r),
 n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, r) AS rank FROM p QUALIFY rank <= 7)
"""
EUCLID = PAIRS.replace("{d}", "sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y))")
MANHATTAN = PAIRS.replace("{d}", "abs(q.x - r.x) + abs(q.y - r.y)")


def _sides(t):
    q = t.supplier.select(F.col("s_suppkey").alias("q"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5.0).alias("y"))
    r = t.customer.select(F.col("c_custkey").alias("r"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 5.0).alias("y"),
                          F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v"))
    return q, r


@query("knn_pairs", EUCLID + "SELECT q, r, distance, rank::INT AS rank FROM n", "distance")
def _(t):
    return nb.nearest(*_sides(t), AXES, 7, "q", "r", box_rows=300)


@query("clf_knn", EUCLID + """
, v AS (SELECT q, g, count(*)::DOUBLE AS vote FROM n GROUP BY 1, 2)
SELECT q, g AS prediction, vote FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY vote DESC, g) = 1""")
def _(t):
    return nb.knn_classify(*_sides(t), AXES, "g", 7, "q", "r")


@query("clf_knn_manhattan", MANHATTAN + """
, w AS (SELECT *, CASE WHEN min(distance) OVER (PARTITION BY q) = 0 THEN (distance = 0)::INT::DOUBLE ELSE 1 / distance END AS w FROM n),
 v AS (SELECT q, g, sum(w) AS vote FROM w GROUP BY 1, 2)
SELECT q, g AS prediction, vote FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY vote DESC, g) = 1""", "vote", 4)
def _(t):
    return nb.knn_classify(*_sides(t), AXES, "g", 7, "q", "r", weights="distance", metric="manhattan")


@query("reg_knn", EUCLID + "SELECT q, avg(v) AS prediction FROM n GROUP BY 1", "prediction", 4)
def _(t):
    return nb.knn_regress(*_sides(t), AXES, "v", 7, "q", "r")


# --- density clusters ------------------------------------------------------------------------

DENSITY = """
WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey / 5.0::DOUBLE AS y FROM supplier),
 n AS (SELECT a.k AS a, b.k AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.64),
 c AS (SELECT a AS k FROM n GROUP BY a HAVING count(*) >= 4),
 e AS (SELECT a, b FROM n WHERE a IN (SELECT k FROM c) AND b IN (SELECT k FROM c)),
 r AS (SELECT k, k AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.k),
 m AS (SELECT k, min(root) AS root FROM r GROUP BY 1),
 i AS (SELECT k, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster FROM m),
 b AS (SELECT n.a AS k, min(i.cluster) AS cluster FROM n JOIN i ON i.k = n.b WHERE n.a NOT IN (SELECT k FROM c) GROUP BY 1)
SELECT p.k AS s_suppkey, coalesce(i.cluster, b.cluster, -1) AS cluster, i.cluster IS NOT NULL AS is_core
FROM p LEFT JOIN i USING (k) LEFT JOIN b USING (k)"""


@query("dbscan", DENSITY)
def _(t):
    rows = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5.0).alias("y"))
    return db.dbscan(rows, AXES, "s_suppkey", 0.8, 4)


@query("dbscan_scaled")
def _(t):
    found = db.dbscan(t.customer, ["c_acctbal", "c_nationkey"], "c_custkey", 0.15, 5, standardize=True)
    return found.groupBy("cluster", "is_core").agg(F.count(F.lit(1)).alias("n"))
