"""Hypothesis tests and regressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.operators import stats as s
from prismal.plans.scalars import union_all
from prismal.queries.registry import query
from prismal.queries.series_queries import KENDALL, RANKED


def tail_t(t: str, v: str) -> str:
    """Two-sided t probability by Simpson's rule over u in [0, 1), x = |t| + u / (1 - u)."""
    return f"""(SELECT 2 * sum(w * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - ln({v} * pi()) / 2
      - ({v} + 1) / 2 * ln(1 + pow(abs({t}) + u / (1 - u), 2) / {v})) / pow(1 - u, 2)) / (3 * 4000)
      FROM (SELECT i / 4000.0::DOUBLE AS u, CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 4000) r(i)))"""


@query("normality_test", """
WITH m AS (SELECT count(*) AS n, avg(value) AS mu, var_pop(value) AS v FROM events),
 g AS (SELECT n, avg(pow(value - mu, 3)) / pow(max(v), 1.5) AS skew, avg(pow(value - mu, 4)) / pow(max(v), 2) - 3 AS kurtosis FROM events, m GROUP BY n)
SELECT n, skew, kurtosis, n / 6.0 * (skew * skew + kurtosis * kurtosis / 4) AS statistic, exp(-n / 12.0 * (skew * skew + kurtosis * kurtosis / 4)) AS p_value FROM g""",
       "skew kurtosis statistic p_value", 5)
def _(t):
    return s.normality_test(t.events, "value")


@query("qq_quantiles")
def _(t):
    return s.qq_quantiles(t.events, "value")


@query("qq_sample_quantiles", """
SELECT (i / 100.0)::DOUBLE AS p, quantile_cont(l_extendedprice, i / 100.0) AS sample FROM lineitem, range(1, 100) r(i) GROUP BY i""".replace(
    "SELECT (i / 100.0)::DOUBLE AS p, quantile_cont(l_extendedprice, i / 100.0) AS sample FROM lineitem, range(1, 100) r(i) GROUP BY i",
    "SELECT unnest([" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "])::DOUBLE AS p, unnest(q) AS sample FROM (SELECT quantile_cont(l_extendedprice, ["
    + ", ".join(f"{i / 100}" for i in range(1, 100)) + "]) AS q FROM lineitem)"), "p sample", 5)
def _(t):
    return s.qq_quantiles(t.lineitem, "l_extendedprice").select("p", "sample")


ONE = "SELECT count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, (avg(l_quantity) - 25.4) / (stddev_samp(l_quantity) / sqrt(count(l_quantity))) AS statistic, (count(l_quantity) - 1)::DOUBLE AS dof FROM lineitem"


@query("ttest_one_sample", f"SELECT *, {tail_t('statistic', 'dof')} AS p_value FROM ({ONE}) o", "mean std statistic p_value", 5)
def _(t):
    return s.ttest_one_sample(t.lineitem, "l_quantity", 25.4)


@query("ttest_paired", """
SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS std, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS statistic, (count(d) - 1)::DOUBLE AS dof
FROM (SELECT l_discount - l_tax AS d FROM lineitem)""", "mean std statistic", 5)
def _(t):
    return s.ttest_paired(t.lineitem, "l_discount", "l_tax").drop("p_value")


ANOVA = """
SELECT count(*) AS k, max(total)::BIGINT AS n, sum(n * pow(mean - grand, 2)) AS between, sum((n - 1) * var) AS within, (count(*) - 1)::DOUBLE AS df_between,
 (max(total) - count(*))::DOUBLE AS df_within, (sum(n * pow(mean - grand, 2)) / (count(*) - 1)) / (sum((n - 1) * var) / (max(total) - count(*))) AS statistic
FROM (SELECT g, count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM {rows} GROUP BY 1), (SELECT count(v) AS total, avg(v) AS grand FROM {rows})"""


def anova_sql(rows: str) -> str:
    return ANOVA.replace("{rows}", rows)


APART = """(SELECT event_type AS g, abs(value - med) AS v FROM events JOIN (SELECT event_type, median(value) AS med FROM events GROUP BY 1) USING (event_type))"""


@query("levene_test", anova_sql(APART), "between within statistic", 3)
def _(t):
    return s.levene_test(t.events, "event_type", "value").drop("p_value")


@query("anova_oneway", anova_sql("(SELECT o_orderpriority AS g, o_totalprice / 1000 AS v FROM orders)"), "between within statistic", 2)
def _(t):
    return s.anova_oneway(t.orders.withColumn("v", F.col("o_totalprice") / 1000), "o_orderpriority", "v").drop("p_value")


TWO = """
WITH r AS (SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'view')),
 m AS (SELECT count(v) FILTER (WHERE g = 'click') AS n1, count(v) FILTER (WHERE g = 'view') AS n2, avg(v) FILTER (WHERE g = 'click') AS mean1,
  avg(v) FILTER (WHERE g = 'view') AS mean2, var_samp(v) FILTER (WHERE g = 'click') AS v1, var_samp(v) FILTER (WHERE g = 'view') AS v2 FROM r)
SELECT n1, n2, mean1, mean2, 'pooled' AS method, (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS statistic,
 (n1 + n2 - 2)::DOUBLE AS dof FROM m"""


@query("ttest_two_sample", TWO, "mean1 mean2 statistic dof", 5)
def _(t):
    return s.ttest_two_sample(t.events, "event_type", "value", "click", "view").drop("p_value", "levene_p")


@query("tukey_hsd", """
WITH g AS (SELECT event_type AS g, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM events GROUP BY 1),
 w AS (SELECT sum((n - 1) * var) / (sum(n) - count(*)) AS msw FROM g)
SELECT a.g AS group_1, b.g AS group_2, b.mean - a.mean AS mean_diff, abs(b.mean - a.mean) / sqrt(msw / 2 * (1.0 / a.n + 1.0 / b.n)) AS q
FROM g a JOIN g b ON a.g < b.g, w""", "mean_diff q")
def _(t):
    return s.tukey_hsd(t.events, "event_type", "value").drop("p_value", "reject")


@query("tukey_hsd_p")
def _(t):
    return s.tukey_hsd(t.events, "event_type", "value")


GRID = """
WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2),
 g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS observed FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
 e AS (SELECT *, sum(observed) OVER (PARTITION BY a) * sum(observed) OVER (PARTITION BY b) / (sum(observed) OVER ())::DOUBLE AS expected FROM g)
"""
PRIORITY = GRID.replace("{a}", "o_orderpriority").replace("{b}", "o_orderstatus").replace("{t}", "orders")


@query("chi2_independence", PRIORITY + """
SELECT sum(observed)::BIGINT AS n, sum(pow(observed - expected, 2) / expected) AS statistic,
 ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS dof FROM e""", "statistic")
def _(t):
    return s.chi2_independence(t.orders, "o_orderpriority", "o_orderstatus").drop("p_value")


@query("chi2_cells", PRIORITY + """
SELECT a AS o_orderpriority, b AS o_orderstatus, observed, expected, 100 * pow(observed - expected, 2) / expected / sum(pow(observed - expected, 2) / expected) OVER () AS contribution_pct FROM e""",
       "expected contribution_pct")
def _(t):
    return s.chi2_cells(t.orders, "o_orderpriority", "o_orderstatus")


@query("chi2_yates", GRID.replace("{a}", "quality").replace("{b}", "toxic").replace("{t}", "labels") + """
SELECT sum(observed)::BIGINT AS n, sum(pow(abs(observed - expected) - least(0.5, abs(observed - expected)), 2) / expected) AS statistic, 1.0::DOUBLE AS dof FROM e""", "statistic")
def _(t):
    return s.chi2_independence(t.labels, "quality", "toxic").drop("p_value")


CORR_TEST = f"""
WITH p AS (SELECT 'pearson' AS method, corr(l_quantity, l_discount) AS r FROM lineitem
 UNION ALL SELECT 'spearman', corr FROM ({RANKED.replace("{a}", "l_quantity").replace("{b}", "l_discount").replace("{src}", "lineitem")})
 UNION ALL SELECT 'kendall', corr FROM ({KENDALL.replace("{a}", "l_quantity").replace("{b}", "l_discount").replace("{src}", "lineitem")}))
SELECT method, (SELECT count(*) FROM lineitem) AS n, r, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction,
 CASE WHEN abs(r) >= .7 THEN 'strong' WHEN abs(r) >= .3 THEN 'moderate' ELSE 'weak' END AS strength FROM p"""


@query("corr_test", CORR_TEST, "r")
def _(t):
    return union_all([s.corr_test(t.lineitem, "l_quantity", "l_discount", m) for m in ("pearson", "spearman", "kendall")]).drop("p_value")


@query("confidence_flags")
def _(t):
    tests = {
        "t one sample": s.ttest_one_sample(t.lineitem, "l_quantity", 25.5), "t two sample": s.ttest_two_sample(t.events, "event_type", "value", "click", "view"),
        "levene": s.levene_test(t.events, "event_type", "value"), "anova": s.anova_oneway(t.orders, "o_orderpriority", "o_totalprice"),
        "chi-square": s.chi2_independence(t.orders, "o_orderpriority", "o_orderstatus"), "pearson": s.corr_test(t.lineitem, "l_quantity", "l_extendedprice").withColumnRenamed("r", "statistic")}
    return union_all([s.decided(test).select(F.lit(name).alias("test"), "statistic", "p_value", "significant") for name, test in tests.items()])


# --- regression ------------------------------------------------------------------------------

@query("ols_simple", """
WITH f AS (SELECT count(*) AS n, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_slope(l_extendedprice, l_quantity) AS slope,
 regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem)
SELECT n, intercept, slope, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, sqrt(syy * (1 - r2) / n) AS rmse, slope / sqrt(syy * (1 - r2) / (n - 2) / sxx) AS t FROM f""",
       "intercept slope r2 adj_r2 rmse t", 4)
def _(t):
    return s.ols_simple(t.lineitem, "l_quantity", "l_extendedprice").drop("p_value")


@query("ols_residuals", """
WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a + b * l_quantity AS predicted, l_extendedprice - (a + b * l_quantity) AS residual FROM lineitem, f""", "predicted residual", 4)
def _(t):
    return s.ols_residuals(t.lineitem, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "predicted", "residual")


@query("ols_multiple")
def _(t):
    return s.ols_multiple(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"])


# Two predictors: coefficients and errors from sums of squares and products about the means.
OLS_TWO = """
WITH f AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, count(*) * var_pop(l_extendedprice) AS syy,
  count(*) * var_pop(l_quantity) AS s11, count(*) * var_pop(l_discount) AS s22, count(*) * covar_pop(l_quantity, l_discount) AS s12,
  count(*) * covar_pop(l_quantity, l_extendedprice) AS s1y, count(*) * covar_pop(l_discount, l_extendedprice) AS s2y FROM lineitem),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM f),
e AS (SELECT *, 1 - (syy - b1 * s1y - b2 * s2y) / syy AS r2, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM b)
SELECT 'l_quantity' AS term, b1 AS coefficient, sqrt(v * s22 / det) AS std_error, b1 / sqrt(v * s22 / det) AS t, r2 FROM e
UNION ALL SELECT 'l_discount', b2, sqrt(v * s11 / det), b2 / sqrt(v * s11 / det), r2 FROM e
UNION ALL SELECT 'intercept', my - b1 * m1 - b2 * m2, sqrt(v * (1.0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)),
  (my - b1 * m1 - b2 * m2) / sqrt(v * (1.0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)), r2 FROM e"""


@query("ols_two_predictors", OLS_TWO, "coefficient std_error t r2", 3)
def _(t):
    return s.ols_multiple(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]).select("term", "coefficient", "std_error", "t", "r2")


@query("vif_three", """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS 'column', (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'l_extendedprice', (1 - b * b) / det FROM d
UNION ALL SELECT 'l_discount', (1 - a * a) / det FROM d""", "vif")
def _(t):
    return s.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select("column", "vif")


# One 0/1 predictor: the odds ratio of the two-by-two table.
@query("logit_two_by_two", """
WITH c AS (SELECT count(*) FILTER (WHERE b AND e) AS be, count(*) FILTER (WHERE b AND NOT e) AS bn, count(*) FILTER (WHERE NOT b AND e) AS ne,
  count(*) FILTER (WHERE NOT b AND NOT e) AS nn FROM (SELECT l_extendedprice > 50000 AS b, l_linestatus = (SELECT max(l_linestatus) FROM lineitem) AS e FROM lineitem))
SELECT 'big' AS term, ln(be * nn / (bn * ne)) AS coefficient, sqrt(1.0 / be + 1.0 / bn + 1.0 / ne + 1.0 / nn) AS std_error, be * nn / (bn * ne) AS odds_ratio FROM c
UNION ALL SELECT 'intercept', ln(ne / nn), sqrt(1.0 / ne + 1.0 / nn), ne / nn FROM c""", "coefficient std_error odds_ratio", 5)
def _(t):
    rows = t.lineitem.select("l_linestatus", (F.col("l_extendedprice") > 50000).cast("double").alias("big"))
    return s.logit_regression(rows, "l_linestatus", ["big"]).select("term", "coefficient", "std_error", "odds_ratio")


@query("vif", """
SELECT unnest(['l_quantity', 'l_extendedprice']) AS 'column', 1 / (1 - r * r) AS vif, CASE WHEN 1 / (1 - r * r) >= 10 THEN 'high'
 WHEN 1 / (1 - r * r) >= 5 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)""", "vif")
def _(t):
    return s.vif(t.lineitem, ["l_quantity", "l_extendedprice"])


@query("vif_many")
def _(t):
    return s.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
DISTINCT = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique" FROM lineitem""" for c in LINEITEM)


@query("binary_columns", f"""SELECT * FROM ({DISTINCT}) WHERE "unique" = 2""")
def _(t):
    return s.binary_columns(t.lineitem)


@query("outcome_columns", f"""SELECT * FROM ({DISTINCT}) WHERE "unique" BETWEEN 2 AND 10""")
def _(t):
    return s.binary_columns(t.lineitem, most=10)


@query("logit_regression")
def _(t):
    return s.logit_regression(t.lineitem, "l_linestatus", ["l_quantity", "l_discount"], ["l_returnflag"])


@query("confusion_metrics", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
 count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM labels),
 r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c)
SELECT tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn) AS accuracy, p AS precision, q AS recall, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1 FROM r""",
       "accuracy \"precision\" recall f1")
def _(t):
    return s.confusion_metrics(t.labels, "quality", "toxic")
