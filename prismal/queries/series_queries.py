"""Correlation, anomalies and time series over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.operators import anomaly as a
from prismal.operators import corr as k
from prismal.operators import timeseries as ts
from prismal.plans.scalars import union_all
from prismal.queries.clean_queries import fences
from prismal.queries.registry import DIRTY_LINEITEM, GAPPY_EVENTS, query

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY = ["l_quantity", "l_extendedprice", "l_tax_sparse"]


def pairs_sql(cols: list[str], source: str, template: str) -> str:
    return " UNION ALL ".join(
        template.replace("{a}", x).replace("{b}", y).replace("{src}", source) for i, x in enumerate(cols) for y in cols[i + 1:])


PEARSON = "SELECT '{a}' AS var_1, '{b}' AS var_2, corr({a}, {b}) AS corr FROM {src} v"
RANKED = """
SELECT '{a}' AS var_1, '{b}' AS var_2, corr(rx, ry) AS corr FROM (
 SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS ry
 FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL) r"""
KENDALL = """
SELECT '{a}' AS var_1, '{b}' AS var_2, (SELECT sum(sign(p.x - q.x) * sign(p.y - q.y) * p.n * q.n) / 2
   FROM (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) p,
        (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) q)
 / sqrt(((SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL)
   - (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})))
  * ((SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL)
   - (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM {src} v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b})))) AS corr"""
LINE_PAIRS = pairs_sql(COLS, "lineitem", PEARSON)
BOTH_WAYS = f"WITH p AS ({LINE_PAIRS}) SELECT * FROM p UNION ALL SELECT var_2, var_1, corr FROM p"


@query("corr_matrix_pearson", f"WITH p AS ({pairs_sql(DIRTY, DIRTY_LINEITEM, PEARSON)}) SELECT * FROM p UNION ALL SELECT var_2, var_1, corr FROM p", "corr")
def _(t):
    return k.correlation_matrix(t.dirty_lineitem, DIRTY)


@query("corr_matrix_spearman", pairs_sql(DIRTY, DIRTY_LINEITEM, RANKED), "corr")
def _(t):
    return k.spearman_pairs(t.dirty_lineitem, DIRTY)


@query("corr_matrix_kendall", pairs_sql(["l_quantity", "l_discount", "l_tax"], "lineitem", KENDALL), "corr", 8)
def _(t):
    return k.kendall_pairs(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query("top_correlations", f"SELECT * FROM ({LINE_PAIRS}) ORDER BY abs(corr) DESC, var_1, var_2 LIMIT 3", "corr")
def _(t):
    return k.top_correlations(t.lineitem, COLS, n=3)


@query("corr_strength", f"""
SELECT *, CASE WHEN abs(corr) >= .8 THEN 'Very Strong' WHEN abs(corr) >= .6 THEN 'Strong' WHEN abs(corr) >= .4 THEN 'Moderate'
 WHEN abs(corr) >= .2 THEN 'Weak' ELSE 'Very Weak' END AS strength, CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END AS direction
FROM ({LINE_PAIRS})""", "corr")
def _(t):
    return k.correlation_strength(t.lineitem, COLS)


@query("corr_best_partner", f"""
SELECT var_1, var_2 AS partner, corr FROM ({BOTH_WAYS}) QUALIFY row_number() OVER (PARTITION BY var_1 ORDER BY abs(corr) DESC, var_2 DESC) = 1""", "corr")
def _(t):
    return k.best_partner(t.lineitem, COLS)


@query("corr_insights", f"""
WITH m AS ({BOTH_WAYS}), p AS (SELECT var_1, max(abs(corr)) AS most, count(*) FILTER (WHERE abs(corr) > .4) AS partners FROM m GROUP BY 1)
SELECT 'multicollinear' AS kind, var_1, var_2, abs(corr) AS value FROM m WHERE abs(corr) >= .8 AND var_1 < var_2
UNION ALL SELECT 'isolated', var_1, NULL, most FROM p WHERE most < .2
UNION ALL SELECT 'connected', var_1, NULL, partners::DOUBLE FROM p WHERE partners > 0""", "value")
def _(t):
    return k.correlation_insights(t.lineitem, COLS)


@query("strong_pairs", f"SELECT * FROM ({LINE_PAIRS}) WHERE abs(corr) > 0.6", "corr")
def _(t):
    return k.strong_pairs(t.lineitem, COLS)


# --- anomalies -------------------------------------------------------------------------------

@query("anomaly_iqr", f"""
SELECT event_id, value, abs(value - med) / (q3 - q1) AS score, CASE WHEN value > hi THEN 'high' ELSE 'low' END AS direction
FROM events, {fences("value", "events")} f, (SELECT median(value) AS med FROM events) m WHERE value < lo OR value > hi""", "score")
def _(t):
    return a.anomalies_iqr(t.events.select("event_id", "value"), "value", a.fence_width(5))


@query("anomaly_zscore", f"""
SELECT l_orderkey, l_linenumber, dup, abs((l_extendedprice - m) / s) AS score, CASE WHEN l_extendedprice > m THEN 'high' ELSE 'low' END AS direction
FROM {DIRTY_LINEITEM} v, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM {DIRTY_LINEITEM} w) z
WHERE abs((l_extendedprice - m) / s) > 3""", "score")
def _(t):
    return a.anomalies_zscore(t.dirty_lineitem, "l_extendedprice").select("l_orderkey", "l_linenumber", "dup", "score", "direction")


@query("anomaly_iforest")
def _(t):
    return a.anomalies_iforest(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


# Two fixed trees over quantity and discount: tree, node, feature, cut, left, right, depth.
TREES = [(0, 0, 0, 10.5, 1, 2, 0.0), (0, 1, 1, 0.045, 3, 4, 0.0), (0, 2, -1, 0.0, -1, -1, 4.5), (0, 3, -1, 0.0, -1, -1, 2.0), (0, 4, -1, 0.0, -1, -1, 3.25),
         (1, 0, 1, 0.095, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 5.0), (1, 2, -1, 0.0, -1, -1, 1.5)]


@query("anomaly_iforest_paths", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
       2 ** (-(CASE WHEN l_quantity < 10.5 THEN CASE WHEN l_discount < 0.045 THEN 2.0 ELSE 3.25 END ELSE 4.5 END + CASE WHEN l_discount < 0.095 THEN 5.0 ELSE 1.5 END) / 2
              / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)) AS score
FROM lineitem""", "score")
def _(t):
    columns = "tree int, node int, feature int, cut double, left int, right int, depth double"
    return a.path_scores(t.lineitem, ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"], t.spark.createDataFrame(TREES, columns), 256)


@query("anomaly_summary", f"""
SELECT count(*) FILTER (WHERE value < lo OR value > hi) AS anomalies, 100.0 * count(*) FILTER (WHERE value < lo OR value > hi) / count(value) AS anomaly_pct,
 100.0 * count(*) FILTER (WHERE value > hi) / count(*) FILTER (WHERE value < lo OR value > hi) AS high_pct,
 100.0 * count(*) FILTER (WHERE value < lo) / count(*) FILTER (WHERE value < lo OR value > hi) AS low_pct
FROM events, {fences("value", "events")} f""", "anomaly_pct high_pct low_pct")
def _(t):
    return a.anomaly_summary(t.events, a.anomalies_iqr(t.events, "value"), "value")


@query("anomaly_context", f"""
WITH g AS (SELECT event_type, count(*) AS n_all, count(*) FILTER (WHERE value < lo OR value > hi) AS n_sub FROM events, {fences("value", "events")} f GROUP BY 1),
 s AS (SELECT event_type, 100.0 * n_all / sum(n_all) OVER () AS overall_pct, 100.0 * n_sub / sum(n_sub) OVER () AS subset_pct, n_sub FROM g)
SELECT event_type, overall_pct, subset_pct, subset_pct / overall_pct AS ratio, subset_pct / overall_pct > 2 AS over_represented FROM s WHERE n_sub > 0""",
       "overall_pct subset_pct ratio")
def _(t):
    return a.anomaly_context(t.events, "value", "event_type")


# --- time series -----------------------------------------------------------------------------

MONTHLY = """(SELECT last_day(o_orderdate) AS period, avg(o_totalprice) AS value FROM orders GROUP BY 1)"""
DAILY = f"""(SELECT d::DATE AS period, value FROM range((SELECT min(ts)::DATE FROM {GAPPY_EVENTS} a), (SELECT max(ts)::DATE + 1 FROM {GAPPY_EVENTS} b), INTERVAL 1 DAY) r(d)
 LEFT JOIN (SELECT ts::DATE AS p, avg(value) AS value FROM {GAPPY_EVENTS} c GROUP BY 1) e ON e.p = d::DATE)"""


def monthly(t):
    return ts.resample(t.orders, "o_orderdate", "o_totalprice", "M", "mean")


@query("resample", f"""
WITH s AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM {GAPPY_EVENTS} v),
 d AS (SELECT 'D' AS freq, x::DATE AS period, coalesce(sum(value), 0) AS value FROM s, range(lo, hi + 1, INTERVAL 1 DAY) r(x)
   LEFT JOIN {GAPPY_EVENTS} e ON e.ts::DATE = x::DATE GROUP BY 2),
 w AS (SELECT 'W' AS freq, (date_trunc('week', ts)::DATE + 6) AS period, avg(value) AS value FROM {GAPPY_EVENTS} e GROUP BY 2),
 m AS (SELECT 'M', last_day(o_orderdate), min(o_totalprice) FROM orders GROUP BY 2),
 q AS (SELECT 'Q', (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE, max(o_totalprice) FROM orders GROUP BY 2),
 y AS (SELECT 'Y', (date_trunc('year', o_orderdate) + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE, count(o_totalprice)::DOUBLE FROM orders GROUP BY 2)
SELECT * FROM d UNION ALL SELECT * FROM w UNION ALL SELECT * FROM m UNION ALL SELECT * FROM q UNION ALL SELECT * FROM y""", "value", 4)
def _(t):
    cases = [(t.gappy_events, "ts", "value", "D", "sum"), (t.gappy_events, "ts", "value", "W", "mean")]
    cases += [(t.orders, "o_orderdate", "o_totalprice", f, h) for f, h in (("M", "min"), ("Q", "max"), ("Y", "count"))]
    return union_all([ts.resample(*case).select(F.lit(case[3]).alias("freq"), "*") for case in cases])


@query("resample_keyed", """
SELECT event_type, ts::DATE AS period, avg(value) AS value FROM events GROUP BY 1, 2""", "value")
def _(t):
    return ts.resample(t.events, "ts", "value", "D", "mean", ["event_type"])


@query("rolling_mean", f"""
SELECT period, value, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS rolling FROM {DAILY} s
WINDOW w AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "value rolling")
def _(t):
    return ts.rolling_mean(ts.resample(t.gappy_events, "ts", "value", "D"), 3)


@query("linear_trend", f"""
SELECT count(*) AS n, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, regr_r2(value, i) AS r2,
 CASE WHEN regr_slope(value, i) > 0 THEN 'increasing' WHEN regr_slope(value, i) < 0 THEN 'decreasing' ELSE 'flat' END AS direction
FROM (SELECT value, row_number() OVER (ORDER BY period) - 1 AS i FROM {MONTHLY} m)""", "slope intercept r2", 5)
def _(t):
    return ts.linear_trend(monthly(t)).drop("p_value")


@query("trend_line", f"""
WITH s AS (SELECT period, value, row_number() OVER (ORDER BY period) - 1 AS i FROM {MONTHLY} m)
SELECT period, value, (SELECT regr_intercept(value, i) FROM s) + i * (SELECT regr_slope(value, i) FROM s) AS trend FROM s""", "value trend", 4)
def _(t):
    return ts.trend_line(monthly(t))


@query("year_over_year", """
SELECT month(o_orderdate)::INT AS part, year(o_orderdate)::INT AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""", "value", 4)
def _(t):
    return ts.year_over_year(t.orders, "o_orderdate", "o_totalprice", "month")


@query("year_over_year_weeks", """
SELECT week(o_orderdate)::INT AS part, year(o_orderdate)::INT AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""", "value", 6)
def _(t):
    return ts.year_over_year(t.orders, "o_orderdate", "o_totalprice", "week")


@query("first_last_change", """
WITH f AS (SELECT (SELECT o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) AS a,
  (SELECT o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS b)
SELECT a AS first_value, b AS last_value, b - a AS change, 100 * (b - a) / a AS change_pct,
 CASE WHEN 100 * (b - a) / a > 5 THEN 'upward' WHEN 100 * (b - a) / a < -5 THEN 'downward' ELSE 'stable' END AS trend FROM f""", "change change_pct")
def _(t):
    return ts.first_last_change(t.orders, "o_orderdate", "o_totalprice", ["o_orderkey"])


@query("diff", "SELECT event_id, value, value - lag(value) OVER (ORDER BY event_id) AS diff FROM events", "diff")
def _(t):
    return ts.diff(t.events.select("event_id", "value"), "event_id", "value").select("event_id", "value", "diff")


@query("diff_blocks", "SELECT event_id, value, value - lag(value) OVER (ORDER BY event_id) AS diff FROM events", "diff")
def _(t):
    return ts.diff(t.events.select("event_id", "value"), "event_id", "value", blocks=8).select("event_id", "value", "diff")


@query("infer_frequency", f"""
WITH g AS (SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM (SELECT DISTINCT ts::DATE AS d FROM {GAPPY_EVENTS} v)),
 c AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT gap::INT AS modal_gap, CASE WHEN gap = 1 THEN 'D' WHEN gap = 7 THEN 'W' ELSE gap || 'D' END AS frequency, n / (SELECT sum(n) FROM c) AS share,
 (SELECT count(*) FROM c) = 1 OR n / (SELECT sum(n) FROM c) > 0.8 AS regular FROM c ORDER BY n DESC, gap LIMIT 1""", "share")
def _(t):
    return ts.infer_frequency(t.gappy_events, "ts")


PARTS = f"""
WITH s AS (SELECT period, value, row_number() OVER (ORDER BY period) - 1 AS i FROM {MONTHLY} m),
 t AS (SELECT *, (i % 12)::INT AS slot, ((lag(value, 6) OVER w + lead(value, 6) OVER w) / 2 + sum(value) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) / 12 AS trend
   FROM s WINDOW w AS (ORDER BY i)),
 a AS (SELECT slot, avg(value - trend) AS raw, avg(value / trend) AS mraw FROM t GROUP BY 1),
 c AS (SELECT slot, raw - (SELECT avg(raw) FROM a) AS seasonal, mraw / (SELECT avg(mraw) FROM a) AS mseasonal FROM a),
 p AS (SELECT t.*, c.seasonal, c.mseasonal, value - trend - seasonal AS resid, value / trend / mseasonal AS mresid FROM t JOIN c USING (slot))
"""


@query("seasonal_decompose", PARTS + "SELECT period, value, trend, seasonal, resid FROM p", "value trend seasonal resid", 4)
def _(t):
    return ts.seasonal_decompose(monthly(t), 12).drop("i", "slot")


@query("seasonal_decompose_multiplicative", PARTS + "SELECT period, value, trend, mseasonal AS seasonal, mresid AS resid FROM p", "value trend seasonal resid", 5)
def _(t):
    return ts.seasonal_decompose(monthly(t), 12, "multiplicative").drop("i", "slot")


@query("seasonal_decompose_odd", """
WITH s AS (SELECT event_type, ts::DATE AS period, avg(value) AS value FROM events GROUP BY 1, 2),
 i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY period) - 1 AS i FROM s),
 t AS (SELECT *, i % 7 AS slot, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend FROM i
   WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 a AS (SELECT event_type, slot, avg(value - trend) AS raw FROM t GROUP BY 1, 2),
 c AS (SELECT event_type, slot, raw - avg(raw) OVER (PARTITION BY event_type) AS seasonal FROM a)
SELECT event_type, period, value, trend, seasonal, value - trend - seasonal AS resid FROM t JOIN c USING (event_type, slot)""", "value trend seasonal resid")
def _(t):
    daily = ts.resample(t.events, "ts", "value", "D", "mean", ["event_type"])
    return ts.seasonal_decompose(daily, 7, keys=["event_type"]).drop("i", "slot")


STRENGTH = PARTS + """, v AS (SELECT var_samp(resid) AS r, var_samp(seasonal) AS s, var_samp(ln(mresid)) AS mr, var_samp(ln(mseasonal)) AS ms FROM p WHERE resid IS NOT NULL),
 b AS (SELECT 'additive' AS model, greatest(0, 1 - r / (s + r)) AS strength FROM v UNION ALL SELECT 'multiplicative', greatest(0, 1 - mr / (ms + mr)) FROM v)
SELECT model, strength, CASE WHEN strength >= .7 THEN 'strong' WHEN strength >= .3 THEN 'moderate' ELSE 'weak' END AS label FROM b"""


@query("seasonal_strength", STRENGTH, "strength")
def _(t):
    return union_all([ts.seasonal_strength(ts.seasonal_decompose(monthly(t), 12, m), m).select(F.lit(m).alias("model"), "*")
                      for m in ("additive", "multiplicative")])


@query("seasonal_pattern", PARTS + """
SELECT 'month' AS kind, month(period)::INT AS part, avg(seasonal) AS seasonal FROM p GROUP BY 2
UNION ALL SELECT 'quarter', quarter(period)::INT, avg(seasonal) FROM p GROUP BY 2
UNION ALL SELECT 'position', slot, avg(seasonal) FROM p GROUP BY 2""", "seasonal", 4)
def _(t):
    parts = ts.seasonal_decompose(monthly(t), 12)
    return union_all([ts.seasonal_pattern(parts, kind).select(F.lit(kind).alias("kind"), "*") for kind in ("month", "quarter", "position")])


ACF = f"""
WITH s AS (SELECT period, value - (SELECT avg(value) FROM {MONTHLY} m) AS d, count(*) OVER () AS n FROM {MONTHLY} m),
 i AS (SELECT d, n, row_number() OVER (ORDER BY period) AS i FROM s),
 r AS (SELECT k::INT AS lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM s) AS acf, max(a.n) AS n FROM range(0, 25) g(k) JOIN i a ON true JOIN i b ON b.i = a.i - k GROUP BY k)
SELECT lag, acf, lag > 0 AND abs(acf) > 1.96 / sqrt(n) AS significant, n FROM r"""


@query("acf", ACF, "acf")
def _(t):
    return ts.acf(monthly(t), 24)


@query("pacf")
def _(t):
    return ts.pacf(monthly(t), 24)


@query("pacf_two_lags", f"""
WITH a AS (SELECT max(acf) FILTER (WHERE lag = 1) AS r1, max(acf) FILTER (WHERE lag = 2) AS r2 FROM ({ACF}))
SELECT 0::INT AS lag, 1.0::DOUBLE AS pacf FROM a UNION ALL SELECT 1, r1 FROM a UNION ALL SELECT 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM a""", "pacf")
def _(t):
    return ts.pacf(monthly(t), 2).select("lag", "pacf")


@query("seasonal_lag_hint", f"""
WITH d AS (SELECT lag - lag(lag) OVER (ORDER BY lag) AS space FROM ({ACF}) WHERE significant)
SELECT space FROM d WHERE space IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, space LIMIT 1""")
def _(t):
    return ts.seasonal_lag_hint(monthly(t), 24)


@query("adf_test")
def _(t):
    return ts.adf_levels(monthly(t))


@query("adf_test_keyed")
def _(t):
    return ts.adf_test(ts.resample(t.events, "ts", "value", "D", "mean", ["event_type"]), ["event_type"])


FORECAST = f"""
WITH l AS (SELECT period, value FROM {MONTHLY} m ORDER BY period DESC LIMIT 5),
 e AS (SELECT max(period) AS p, max_by(value, period) AS v1, min_by(value, period) AS v5 FROM l),
 f AS (SELECT i::INT AS i, last_day(p + to_months(i::INT)) AS period, v1 + i * (v1 - v5) / 4 AS forecast, v1 AS last_value FROM e, range(1, 13) r(i))
"""


@query("forecast_drift", FORECAST + """
SELECT i, period, forecast, forecast - abs(forecast) * 0.15 AS lower, forecast + abs(forecast) * 0.15 AS upper, last_value FROM f""",
       "forecast lower upper last_value", 4)
def _(t):
    return ts.forecast_drift(monthly(t), 12, "M")


@query("forecast_summary", FORECAST + """
SELECT max(last_value) AS last_value, max_by(forecast, i) AS end_value, 100 * (max_by(forecast, i) - max(last_value)) / max(last_value) AS end_pct,
 max(forecast) AS max_value, 100 * (max(forecast) - max(last_value)) / max(last_value) AS max_pct FROM f""", "last_value end_value end_pct max_value max_pct", 4)
def _(t):
    return ts.forecast_summary(ts.forecast_drift(monthly(t), 12, "M"))


@query("time_sorted", "SELECT ts::DATE AS day, value FROM events")
def _(t):
    return ts.time_sorted(t.events, "ts", "value").select(F.to_date("ts").alias("day"), "value")
