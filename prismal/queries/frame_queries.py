"""Chart-ready frames over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.operators import frames as fr

from prismal.queries.registry import query
from prismal.queries.series_queries import COLS, PEARSON, pairs_sql


@query("frame_bar", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return fr.bar(t.customer, "c_mktsegment")


@query("frame_bar_value", "SELECT c_mktsegment, avg(c_acctbal) AS c_acctbal_mean FROM customer GROUP BY 1", "c_acctbal_mean")
def _(t):
    return fr.bar(t.customer, "c_mktsegment", "c_acctbal", "mean")


@query("frame_bar_grouped", """
SELECT a.lang, b.source, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) a CROSS JOIN (SELECT DISTINCT source FROM documents) b
LEFT JOIN documents d ON d.lang = a.lang AND d.source = b.source GROUP BY 1, 2""")
def _(t):
    return fr.bar_grouped(t.documents, "lang", "source")


@query("frame_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM events),
     b AS (SELECT least(30, floor((value - lo) / ((hi - lo) / 30))::INT + 1) AS bin FROM events, s)
SELECT i::INT AS bin, lo + (i - 1) * (hi - lo) / 30 AS left, lo + i * (hi - lo) / 30 AS right, count(b.bin) AS n,
  count(b.bin) / (total * (hi - lo) / 30) AS density FROM range(1, 31) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i GROUP BY i, lo, hi, total""",
       '"left" "right" density', 8)
def _(t):
    return fr.histogram_density(t.events, "value")


@query("frame_kde", """
WITH v AS (SELECT l_quantity AS v, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1),
 f AS (SELECT count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
 g AS (SELECT i::INT AS i, lo + (hi - lo) * i / 999 AS x, n, h FROM f, range(0, 1000) r(i))
SELECT i, x, sum(w * exp(-0.5 * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi())) AS density FROM g, v GROUP BY i, x, n, h""", "x density", 8)
def _(t):
    return fr.kde(t.lineitem, "l_quantity")


@query("frame_kde_continuous", """
WITH v AS (SELECT value AS v, count(*)::DOUBLE AS w FROM events GROUP BY 1),
 f AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi FROM events),
 g AS (SELECT i::INT AS i, lo + (hi - lo) * i / 199 AS x, n, h FROM f, range(0, 200) r(i))
SELECT i, x, sum(w * exp(-0.5 * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi())) AS density FROM g, v GROUP BY i, x, n, h""", "x density", 8)
def _(t):
    return fr.kde(t.events, "value", 200)


BOX = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
 e AS (SELECT event_type, value, q1, med, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q USING (event_type))
"""


@query("frame_box", BOX + """
SELECT event_type, count(value) AS n, min(value) FILTER (WHERE inside) AS whisker_low, max(q1) AS q1, max(med) AS median, max(q3) AS q3,
 max(value) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers FROM e GROUP BY 1""", "q1 median q3")
def _(t):
    return fr.box(t.events, "value", "event_type")


@query("frame_box_outliers", BOX + "SELECT event_type, value FROM e WHERE NOT inside")
def _(t):
    return fr.box_outliers(t.events.select("event_type", "value"), "value", "event_type")


@query("frame_pie", """
SELECT o_orderpriority, sum(o_totalprice) AS amount, 100.0 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share FROM orders GROUP BY 1""", "amount share", 2)
def _(t):
    return fr.pie(t.orders, "o_orderpriority", "o_totalprice")


@query("frame_line", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value, event_type FROM events")
def _(t):
    return fr.line(t.events, "ts", "value", "event_type").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value", "event_type")


@query("frame_area_share", """
SELECT year(o_orderdate)::INT AS year, o_orderstatus, sum(o_totalprice) AS value,
 100.0 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY year(o_orderdate)) AS share FROM orders GROUP BY 1, 2, year(o_orderdate)""", "value share", 2)
def _(t):
    return fr.area_share(t.orders.withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus", "o_totalprice")


@query("frame_scatter_trend", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2,
  min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT i::INT AS i, lo + (hi - lo) * i / 99 AS x, a + b * (lo + (hi - lo) * i / 99) AS y, r2 FROM f, range(0, 100) r(i)""", "x y r2", 5)
def _(t):
    return fr.scatter_line(t.lineitem, "l_quantity", "l_extendedprice")


@query("frame_scatter_points", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def _(t):
    return fr.point_sample(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"])


@query("frame_bubble", "SELECT s_suppkey, s_acctbal, s_nationkey, s_name FROM supplier")
def _(t):
    return fr.bubble(t.supplier, "s_suppkey", "s_acctbal", "s_nationkey", "s_name", ["s_suppkey"]).select(
        "s_suppkey", "s_acctbal", "s_nationkey", "s_name")


@query("frame_scatter_matrix", "SELECT l_orderkey, l_linenumber, " + ", ".join(COLS) + " FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS))
def _(t):
    return fr.scatter_matrix(t.lineitem, COLS, ["l_orderkey", "l_linenumber"])


@query("frame_funnel", """
SELECT event_type, count(*)::DOUBLE AS amount, 100.0 * count(*) / max(count(*)) OVER () AS pct_of_first FROM events GROUP BY 1""", "pct_of_first")
def _(t):
    return fr.funnel(t.events, "event_type")


WATERFALL = """
WITH s AS (SELECT r_name AS step, sum(c_acctbal) AS amount FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT step, amount, sum(amount) OVER (ORDER BY step) AS running FROM s UNION ALL SELECT 'Total', sum(amount), sum(amount) FROM s"""


@query("frame_waterfall", WATERFALL, "amount running", 2)
def _(t):
    joined = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return fr.waterfall(joined, "r_name", "c_acctbal")


@query("frame_hierarchy", """
SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) AS total, (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::INT AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""", "total", 2)
def _(t):
    joined = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return fr.hierarchy(joined, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")


@query("frame_heatmap_correlation", f"""
WITH p AS ({pairs_sql(COLS, "lineitem", PEARSON)}) SELECT * FROM p UNION ALL SELECT var_2, var_1, corr FROM p
UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c, c, 1.0""", "corr")
def _(t):
    return fr.heatmap_correlation(t.lineitem, COLS)


@query("frame_heatmap_pivot", """
SELECT p_brand, p_type, avg(p_retailprice) AS value FROM part GROUP BY 1, 2""", "value")
def _(t):
    return fr.heatmap_pivot(t.part, "p_brand", "p_type", "p_retailprice")


@query("frame_density2d", """
WITH s AS (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_extendedprice) AS pl, max(l_extendedprice) AS ph FROM lineitem)
SELECT least(20, greatest(1, ceil((l_quantity - ql) / ((qh - ql) / 20))::INT)) AS x_bin,
  least(20, greatest(1, ceil((l_extendedprice - pl) / ((ph - pl) / 20))::INT)) AS y_bin, count(*) AS n FROM lineitem, s GROUP BY 1, 2""")
def _(t):
    return fr.density2d(t.lineitem, "l_quantity", "l_extendedprice")


@query("frame_radar", """
SELECT l_returnflag, 'l_quantity' AS axis, avg(l_quantity) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_discount', avg(l_discount) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_tax', avg(l_tax) FROM lineitem GROUP BY 1""", "value")
def _(t):
    return fr.radar(t.lineitem, "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


GEO = "SELECT c_custkey, c_nationkey * 10.0::DOUBLE - 120 AS lat, c_acctbal / 50 AS lon, c_acctbal FROM customer"


@query("frame_geo_points", f"""
SELECT lat, lon, c_acctbal AS size FROM ({GEO}) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""", "lat lon")
def _(t):
    placed = t.customer.select((F.col("c_nationkey") * 10.0 - 120).alias("lat"), (F.col("c_acctbal") / 50).alias("lon"), "c_acctbal")
    return fr.geo_points(placed, "lat", "lon", "c_acctbal")


@query("frame_facets", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
     b AS (SELECT event_type, least(10, floor((value - lo) / ((hi - lo) / 10))::INT + 1) AS bin FROM events, s)
SELECT e.event_type, i::INT AS bin, lo + (i - 1) * (hi - lo) / 10 AS left, lo + i * (hi - lo) / 10 AS right, count(b.bin) AS n
FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN range(1, 11) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i AND b.event_type = e.event_type
GROUP BY e.event_type, i, lo, hi""", '"left" "right"')
def _(t):
    return fr.facets(t.events, "event_type", "value")


# --- two datasets ----------------------------------------------------------------------------

YEARS = "SELECT CASE WHEN year(o_orderdate) = 1996 THEN '1996' ELSE '1997' END AS dataset, * FROM orders WHERE year(o_orderdate) IN (1996, 1997)"


def two_years(t):
    return t.orders.where(F.year("o_orderdate") == 1996), t.orders.where(F.year("o_orderdate") == 1997)


@query("frame_compare_stats", f"""
SELECT dataset, 'o_totalprice' AS 'column', count(o_totalprice) AS n, avg(o_totalprice) AS mean, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1,
 median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max FROM ({YEARS}) GROUP BY 1""", "mean q1 median q3", 5)
def _(t):
    return fr.compare_stats(fr.stacked(*two_years(t), ["o_totalprice"], ["1996", "1997"]), ["o_totalprice"])


@query("frame_compare_histogram", f"""
WITH o AS ({YEARS}), s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM o),
     b AS (SELECT dataset, least(20, floor((o_totalprice - lo) / ((hi - lo) / 20))::INT + 1) AS bin FROM o, s)
SELECT e.dataset, i::INT AS bin, lo + (i - 1) * (hi - lo) / 20 AS left, lo + i * (hi - lo) / 20 AS right, count(b.bin) AS n
FROM (SELECT DISTINCT dataset FROM o) e CROSS JOIN range(1, 21) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i AND b.dataset = e.dataset
GROUP BY e.dataset, i, lo, hi""", '"left" "right"', 4)
def _(t):
    return fr.compare_histogram(fr.stacked(*two_years(t), ["o_totalprice"], ["1996", "1997"]), "o_totalprice")


@query("frame_compare", f"SELECT dataset, o_orderpriority, count(*) AS n FROM ({YEARS}) GROUP BY 1, 2")
def _(t):
    return fr.compare_counts(fr.stacked(*two_years(t), ["o_orderpriority"], ["1996", "1997"]), "o_orderpriority")


@query("frame_compare_values", f"SELECT dataset, o_orderpriority, avg(o_totalprice) AS o_totalprice_mean FROM ({YEARS}) GROUP BY 1, 2", "o_totalprice_mean", 5)
def _(t):
    return fr.compare_values(fr.stacked(*two_years(t), ["o_orderpriority", "o_totalprice"], ["1996", "1997"]), "o_orderpriority", "o_totalprice")


@query("frame_compare_correlations", """
WITH a AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT * FROM lineitem WHERE l_linestatus = 'F')
SELECT x.var_1, x.var_2, x.corr AS corr_1, y.corr AS corr_2, y.corr - x.corr AS difference FROM ({a}) x JOIN ({b}) y USING (var_1, var_2)""".replace(
    "{a}", pairs_sql(COLS, "a", PEARSON)).replace("{b}", pairs_sql(COLS, "b", PEARSON)), "corr_1 corr_2 difference")
def _(t):
    return fr.compare_correlations(t.lineitem.where("l_linestatus = 'O'"), t.lineitem.where("l_linestatus = 'F'"), COLS)
