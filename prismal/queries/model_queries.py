"""Models, clustering and file sources over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from prismal.operators import cluster as cl
from prismal.operators import ml
from prismal.plans.scalars import union_all
from prismal.queries.registry import query
from prismal.session import work_path
from prismal.sources import tables as src

LINE_KEYS = ["l_orderkey", "l_linenumber"]


@query("target_distribution", """
SELECT l_returnflag, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM lineitem GROUP BY 1""", "pct")
def _(t):
    return ml.target_distribution(t.lineitem, "l_returnflag")


@query("train_test_split", """
SELECT l_returnflag, count(*) AS n, floor(count(*) * 0.2 + 0.5)::BIGINT AS n_test FROM lineitem GROUP BY 1""")
def _(t):
    split = ml.stratified_split(t.lineitem, "l_returnflag", LINE_KEYS)
    return split.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("ml_preprocess")
def _(t):
    stages = ml.preprocessing(t.dirty_lineitem, ["l_quantity", "l_extendedprice"], ["l_linestatus"])
    model = ml.Pipeline(stages=stages).fit(t.dirty_lineitem)
    return model.transform(t.dirty_lineitem).select("l_orderkey", "l_linenumber", "dup", ml.vector_to_array("features").alias("features"))


def _classify(t, kind: str, target: str = "l_linestatus", **params):
    data = t.lineitem.withColumn("ship_day", F.date_diff("l_shipdate", F.lit("1995-01-01").cast("date")))
    split = ml.stratified_split(data, target, LINE_KEYS)
    model = ml.fit_classifier(split.where("NOT is_test"), target, ["l_quantity", "l_extendedprice", "ship_day"], ["l_returnflag"] if target != "l_returnflag" else [], kind, **params)
    return ml.classification_metrics(ml.predict(model, split.where("is_test"))).select(F.lit(kind).alias("model"), "*")


@query("clf_logistic")
def _(t):
    return _classify(t, "logistic")


@query("clf_tree")
def _(t):
    return _classify(t, "tree", criterion="entropy")


@query("clf_forest")
def _(t):
    return _classify(t, "forest")


@query("clf_gbt")
def _(t):
    return _classify(t, "gbt")


@query("clf_gbt_multiclass")
def _(t):
    return _classify(t, "gbt", "l_returnflag")


@query("clf_linear_svm")
def _(t):
    return _classify(t, "linear_svm")


@query("clf_metrics", """
WITH c AS (SELECT quality AS a, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2),
 k AS (SELECT c, sum(s)::DOUBLE AS support, sum(d)::DOUBLE AS called, sum(h)::DOUBLE AS hits FROM (SELECT a AS c, n AS s, 0 AS d, CASE WHEN a = p THEN n ELSE 0 END AS h FROM c
   UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY 1),
 m AS (SELECT *, coalesce(hits / nullif(called, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM k)
SELECT sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
 sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support) AS f1 FROM m""", 'accuracy "precision" recall f1')
def _(t):
    return ml.classification_metrics(t.labels, "quality", "toxic")


@query("clf_confusion", "SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    return ml.confusion(t.labels, "quality", "toxic")


SCORED = "(SELECT quality AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id))"


def _scored(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")


@query("roc_curve", f"""
SELECT s AS threshold, sum(sum(1 - y)) OVER w / (SELECT sum(1 - y) FROM {SCORED}) AS fpr, sum(sum(y)) OVER w / (SELECT sum(y) FROM {SCORED}) AS tpr
FROM {SCORED} GROUP BY s WINDOW w AS (ORDER BY s DESC)""", "fpr tpr")
def _(t):
    return ml.roc_curve(_scored(t), "quality", "n_chars")


@query("roc_auc", f"""
SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) /
 (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {SCORED})""", "auc")
def _(t):
    return ml.roc_auc(_scored(t), "quality", "n_chars")


@query("feature_importance")
def _(t):
    model = ml.fit_classifier(t.lineitem, "l_linestatus", ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"], "forest")
    return ml.feature_importance(model, t.lineitem)


@query("feature_coefficients")
def _(t):
    return ml.feature_importance(ml.fit_regressor(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"]), t.lineitem)


@query("cross_validate")
def _(t):
    return ml.cross_validate(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], LINE_KEYS, kind="linear", task="regression")


@query("cross_validate_line", """
WITH k AS (SELECT unnest(range(5)) AS k),
f AS (SELECT k, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM k, lineitem WHERE l_orderkey % 5 <> k GROUP BY k),
r AS (SELECT k, 1 - sum((l_extendedprice - a - b * l_quantity) ^ 2) / (count(*) * var_pop(l_extendedprice)) AS r2 FROM f, lineitem WHERE l_orderkey % 5 = k GROUP BY k)
SELECT 'linear' AS model, 'r2' AS metric, 5::INT AS folds, avg(r2) AS mean, stddev_pop(r2) AS std FROM r""", "mean std")
def _(t):
    return ml.cross_validate(t.lineitem, "l_extendedprice", ["l_quantity"], LINE_KEYS, kind="linear", task="regression", fold=F.col("l_orderkey") % 5)


@query("cross_validate_ridge", """
WITH k AS (SELECT unnest(range(5)) AS k),
f AS (SELECT k, regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 500 * var_samp(l_quantity)) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx
      FROM k, lineitem WHERE l_orderkey % 5 <> k GROUP BY k),
r AS (SELECT k, 1 - sum((l_extendedprice - my - b * (l_quantity - mx)) ^ 2) / (count(*) * var_pop(l_extendedprice)) AS r2 FROM f, lineitem WHERE l_orderkey % 5 = k GROUP BY k)
SELECT 'ridge' AS model, 'r2' AS metric, 5::INT AS folds, avg(r2) AS mean, stddev_pop(r2) AS std FROM r""", "mean std")
def _(t):
    return ml.cross_validate(t.lineitem, "l_extendedprice", ["l_quantity"], LINE_KEYS, kind="ridge", task="regression", fold=F.col("l_orderkey") % 5, alpha=500.0)


@query("cross_validate_classifier")
def _(t):
    return ml.cross_validate(t.lineitem, "l_linestatus", ["l_quantity", "l_discount"], LINE_KEYS, ["l_returnflag"], kind="tree")


@query("reg_linear", """
WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a + b * l_quantity AS prediction FROM lineitem, f""", "prediction", 3)
def _(t):
    model = ml.fit_regressor(t.lineitem, "l_extendedprice", ["l_quantity"])
    return ml.predict(model, t.lineitem, LINE_KEYS).drop("label")


def _regress(t, kind: str, **params):
    split = ml.random_split(t.lineitem, LINE_KEYS)
    model = ml.fit_regressor(split.where("NOT is_test"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"], kind, **params)
    return ml.regression_metrics(ml.predict(model, split.where("is_test"))).select(F.lit(kind).alias("model"), "*")


@query("reg_ridge")
def _(t):
    return _regress(t, "ridge", alpha=0.5)


@query("reg_lasso")
def _(t):
    return _regress(t, "lasso", alpha=0.5)


@query("reg_tree")
def _(t):
    return _regress(t, "tree")


@query("reg_forest")
def _(t):
    return _regress(t, "forest")


@query("reg_gbt")
def _(t):
    return _regress(t, "gbt")


@query("reg_metrics", """
WITH f AS (SELECT l_extendedprice AS a, l_extendedprice - l_quantity * 1000 AS e FROM lineitem)
SELECT count(*) AS n, 1 - avg(e * e) / var_pop(a) AS r2, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e * e) AS mse FROM f""", "r2 rmse mae mse", 2)
def _(t):
    return ml.regression_metrics(t.lineitem.withColumn("guess", F.col("l_quantity") * 1000), "l_extendedprice", "guess")


@query("residual_frame")
def _(t):
    split = ml.random_split(t.lineitem, LINE_KEYS)
    model = ml.fit_regressor(split.where("NOT is_test"), "l_extendedprice", ["l_quantity", "l_discount"])
    return ml.residual_frame(ml.predict(model, split.where("is_test"), LINE_KEYS), LINE_KEYS)


@query("residual_line", """
WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, a + b * l_quantity AS predicted, l_extendedprice - a - b * l_quantity AS residual FROM lineitem, f""",
       "actual predicted residual", 3)
def _(t):
    model = ml.fit_regressor(t.lineitem, "l_extendedprice", ["l_quantity"])
    return ml.residual_frame(ml.predict(model, t.lineitem, LINE_KEYS), LINE_KEYS)


# One feature, standardized: the sum of squares plus alpha times the squared weight is least at sxy / (sxx + alpha); the
# lasso's weight is the covariance brought towards zero by alpha.
ONE_FEATURE = """
WITH f AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx, covar_pop(l_extendedprice, l_quantity) AS cxy,
  var_pop(l_quantity) AS vx, count(*) AS n FROM lineitem),
w AS (SELECT my, mx, sx, {weight} AS w FROM f)
SELECT l_orderkey, l_linenumber, my + w * (l_quantity - mx) / sx AS prediction FROM lineitem, w"""


@query("ridge_line", ONE_FEATURE.format(weight="(n * cxy / sx) / (n * vx / (sx * sx) + 500.0)"), "prediction", 2)
def _(t):
    model = ml.fit_regressor(t.lineitem, "l_extendedprice", ["l_quantity"], kind="ridge", alpha=500.0)
    return ml.predict(model, t.lineitem, LINE_KEYS).drop("label")


@query("lasso_line", ONE_FEATURE.format(weight="sign(cxy) * greatest(abs(cxy / sx) - 800.0, 0) / (vx / (sx * sx))"), "prediction", 1)
def _(t):
    model = ml.fit_regressor(t.lineitem, "l_extendedprice", ["l_quantity"], kind="lasso", alpha=800.0)
    return ml.predict(model, t.lineitem, LINE_KEYS).drop("label")


@query("model_registry")
def _(t):
    registry = ml.ModelRegistry(work_path(t.spark, "registry"))
    for kind in ("linear", "ridge"):
        model = ml.fit_regressor(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], kind=kind)
        registry.save(kind, model, ml.regression_metrics(ml.predict(model, t.lineitem)).withColumn("target", F.lit("l_extendedprice")))
    again = ml.predict(registry.load("ridge"), t.lineitem, LINE_KEYS).agg(F.count("prediction").alias("predictions"))
    return registry.facts(t.spark).join(F.broadcast(again))  # one row


# --- clustering ------------------------------------------------------------------------------

ELEMENTS = [f"e{i}" for i in range(64)]
E_SQL = "(SELECT vec_id, label AS cluster, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(64)) + " FROM embeddings)"


def elements(t):
    return t.embeddings.select("vec_id", F.col("label").alias("cluster"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("kmeans")
def _(t):
    return cl.kmeans(elements(t).drop("cluster"), ELEMENTS, 4)


@query("kmeans_elbow")
def _(t):
    return cl.kmeans_elbow(elements(t), ELEMENTS)


@query("kmeans_step", """
WITH c AS (SELECT * FROM (VALUES (2, 0, 10.3, 0.021), (2, 1, 40.0, 0.08), (3, 0, 5.3, 0.0), (3, 1, 25.1, 0.05), (3, 2, 45.0, 0.1)) AS c(k, i, q, d)),
near AS (
  SELECT k, l_quantity, l_discount, arg_min(i, (l_quantity - q) ** 2 + (l_discount - d) ** 2) AS i, min((l_quantity - q) ** 2 + (l_discount - d) ** 2) AS far
  FROM (SELECT *, row_number() OVER () AS r FROM lineitem), c GROUP BY r, l_quantity, l_discount, k)
SELECT k::INT AS k, i::INT AS cluster, avg(l_quantity) AS quantity, avg(l_discount) AS discount, sum(sum(far)) OVER (PARTITION BY k) AS cost FROM near GROUP BY k, i""", "quantity discount cost", 4)
def _(t):
    rows, _ = cl.vectors(t.lineitem, ["l_quantity", "l_discount"], standardize=False)
    fixed = {2: np.array([[10.3, 0.021], [40.0, 0.08]]), 3: np.array([[5.3, 0.0], [25.1, 0.05], [45.0, 0.1]])}
    moved, costs = cl.advance(rows, fixed)
    return t.spark.createDataFrame([(k, i, float(c[0]), float(c[1]), costs[k]) for k in moved for i, c in enumerate(moved[k])],
                                   "k int, cluster int, quantity double, discount double, cost double")


@query("centroids_original")
def _(t):
    return cl.kmeans_centroids(elements(t), ELEMENTS, 4)


@query("hierarchical_bisecting")
def _(t):
    return cl.hierarchical_bisecting(elements(t).drop("cluster"), ELEMENTS, 4)


@query("pca_2d")
def _(t):
    return cl.pca_2d(elements(t), ELEMENTS, ["vec_id"])


# Two standardized columns: the components are their sum and difference, of variance 1 + |r| and 1 - |r|.
@query("pca_two_columns", """
WITH f AS (SELECT avg(c_acctbal) AS m1, stddev_samp(c_acctbal) AS d1, avg(c_nationkey) AS m2, stddev_samp(c_nationkey) AS d2, corr(c_acctbal, c_nationkey) AS r FROM customer)
SELECT c_custkey, abs(((c_acctbal - m1) / d1 + sign(r) * (c_nationkey - m2) / d2) / sqrt(2)) AS pc1,
  abs(((c_acctbal - m1) / d1 - sign(r) * (c_nationkey - m2) / d2) / sqrt(2)) AS pc2, (1 + abs(r)) / 2 AS explained_1, (1 - abs(r)) / 2 AS explained_2 FROM customer, f""",
       "pc1 pc2 explained_1 explained_2", 5)
def _(t):
    found = cl.pca_2d(t.customer, ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return found.withColumns({c: F.abs(c) for c in ("pc1", "pc2")})


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def _(t):
    return cl.cluster_sizes(elements(t))


def _each(template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in ELEMENTS)


@query("cluster_profile", f"WITH d AS {E_SQL} " + _each("""
SELECT cluster, '{c}' AS feature, avg({c}) AS mean, (avg({c}) - (SELECT avg({c}) FROM d)) / (SELECT stddev_samp({c}) FROM d) AS normalized FROM d GROUP BY 1"""), "mean normalized")
def _(t):
    return cl.cluster_profile(elements(t), ELEMENTS)


@query("cluster_top_features", f"WITH d AS {E_SQL}, l AS (" + _each("""
SELECT cluster, '{c}' AS feature, 100 * (avg({c}) - (SELECT avg({c}) FROM d)) / (SELECT avg({c}) FROM d) AS diff_pct,
 CASE WHEN avg({c}) > (SELECT avg({c}) FROM d) THEN 'higher' ELSE 'lower' END AS direction FROM d GROUP BY 1""") + """)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(diff_pct) DESC, feature) <= 5""", "diff_pct", 4)
def _(t):
    return cl.cluster_top_features(elements(t), ELEMENTS)


@query("cluster_samples", """
SELECT label AS cluster, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5""")
def _(t):
    return cl.cluster_samples(elements(t).select("cluster", "vec_id"), ["vec_id"])


@query("noise_compare", f"WITH d AS {E_SQL}, n AS (SELECT *, cluster = 0 AS noise FROM d) " + _each("""
SELECT '{c}' AS feature, avg({c}) FILTER (WHERE noise) AS noise_mean, min({c}) FILTER (WHERE noise) AS noise_min, max({c}) FILTER (WHERE noise) AS noise_max,
 stddev_samp({c}) FILTER (WHERE noise) AS noise_std, avg({c}) AS overall_mean, 100 * (avg({c}) FILTER (WHERE noise) - avg({c})) / avg({c}) AS diff_pct FROM n"""),
       "noise_mean noise_min noise_max noise_std overall_mean diff_pct", 4)
def _(t):
    return cl.noise_compare(elements(t).withColumn("cluster", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster"))), ELEMENTS)


# --- sources and sinks -----------------------------------------------------------------------

ORDERS_SQL = "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate::DATE AS o_orderdate FROM orders"
ORDERS_SCHEMA = "o_orderkey bigint, o_orderpriority string, o_totalprice double, o_orderdate date"


def _orders(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))


@query("scan_csv", f"SELECT c_custkey, segment, nation_text, c_acctbal FROM ({{}}) v".replace("({})", """(
SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 10 = 0 THEN 'NA' ELSE c_name END AS nation_text FROM customer)"""))
def _(t):
    d = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"),
                          F.when(F.col("c_custkey") % 10 == 0, "NA").otherwise(F.col("c_name")).alias("nation_text"), "c_acctbal")
    path = src.write_csv(d, work_path(t.spark, "csv"))
    return src.scan_csv(t.spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "segment", "nation_text", "c_acctbal")


@query("scan_csv_options", ORDERS_SQL)
def _(t):
    path = src.write_csv(_orders(t), work_path(t.spark, "csv"), sep=";", encoding="ISO-8859-1")
    return src.scan_csv(t.spark, path, sep=";", encoding="ISO-8859-1", schema=ORDERS_SCHEMA)


@query("scan_tsv", ORDERS_SQL)
def _(t):
    return src.scan_tsv(t.spark, src.write_csv(_orders(t), work_path(t.spark, "tsv"), sep="\t"), schema=ORDERS_SCHEMA)


@query("scan_json", ORDERS_SQL)
def _(t):
    return src.scan_json(t.spark, src.write_json(_orders(t), work_path(t.spark, "json")), schema=ORDERS_SCHEMA)


@query("sink_csv", ORDERS_SQL)
def _(t):
    return src.scan_csv(t.spark, src.export(_orders(t), work_path(t.spark, "csv"), "csv"), schema=ORDERS_SCHEMA)


@query("sink_json_records", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    summary = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return src.scan_json(t.spark, src.export(summary, work_path(t.spark, "json"), "json")).select("l_returnflag", "l_linestatus", "n")


@query("scan_parquet", """
SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'pages', count(*) FROM pages
UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'embeddings', count(*) FROM embeddings""")
def _(t):
    names = ["region", "nation", "pages", "benchmark", "conversations", "embeddings"]
    return union_all([src.scan_parquet(t.spark, f"{t.sf_dir}/{n}.parquet").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in names])
