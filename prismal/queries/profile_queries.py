"""Profiles, quality and recommendations over the given tables and their derived dirty views."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.operators import profile as p
from prismal.operators import quality as q
from prismal.operators.insights import dataset_insights
from prismal.queries.registry import DIRTY_CUSTOMER, DIRTY_LINEITEM, TEXT_DATES, query

NUMERIC = ["l_quantity", "l_extendedprice", "l_tax_sparse"]
DATE_TRY = ("coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%m/%d/%Y'), "
            "try_strptime({c}, '%Y/%m/%d'), try_strptime({c}, '%d-%m-%Y'), try_strptime({c}, '%m-%d-%Y'), "
            "try_strptime({c}, '%Y-%m-%d %H:%M:%S'), try_strptime({c}, '%d/%m/%Y %H:%M:%S'))")


def no_dup(t):
    return t.dirty_lineitem.drop("dup")


def per_column(source: str, columns: list[str], template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c).replace("{src}", source) for c in columns)


MOMENTS = """
SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS cnt, avg({c}) AS mean, stddev_samp({c}) AS std,
  var_samp({c}) AS variance, min({c}) AS lo, max({c}) AS hi, skewness({c}) AS skew, kurtosis({c}) AS kurt,
  quantile_cont({c}, 0.05) AS q05, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS med,
  quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.95) AS q95,
  count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives FROM {src} v"""
OUTLIERS = """
SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM {src} v, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src} w) b"""


def numeric_sql(source: str, columns: list[str]) -> str:
    return (f"SELECT m.*, o.outliers, 100.0 * o.outliers / m.n_rows AS outlier_pct, q25 - 1.5 * (q75 - q25) AS lower, "
            f"q75 + 1.5 * (q75 - q25) AS upper FROM ({per_column(source, columns, MOMENTS)}) m JOIN "
            f"({per_column(source, columns, OUTLIERS)}) o USING (column_name)")


TEXTS = """
SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS uniq,
  count(DISTINCT lower({c})) AS uniq_lower, count(*) FILTER (WHERE try_cast(trim({c}) AS DOUBLE) IS NOT NULL) AS numeric_rows,
  count(*) FILTER (WHERE DATE_TRY IS NOT NULL) AS date_rows,
  count(*) FILTER (WHERE regexp_matches({c}, '^\\s|\\s$')) AS space_rows,
  count(*) FILTER (WHERE regexp_matches({c}, '[^a-zA-Z0-9\\s]')) AS special_rows,
  coalesce(bool_or({c} <> lower({c})), false) AS any_upper, min(length({c})) AS len_min, max(length({c})) AS len_max,
  avg(length({c})) AS len_mean, mode_value, mode_n FROM {src} v,
  (SELECT {c} AS mode_value, count(*) AS mode_n FROM {src} w WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) m
  GROUP BY mode_value, mode_n"""


def text_sql(source: str, columns: list[str]) -> str:
    template = TEXTS.replace("DATE_TRY", DATE_TRY)
    return per_column(source, columns, template)


# --- whole table -----------------------------------------------------------------------------

INFO = f"""
SELECT count(*) AS n_rows, 7 - 0 AS n_cols, sum(missing)::BIGINT AS missing_cells,
  100.0 * sum(missing) / (count(*) * 7) AS missing_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (dup) FROM {DIRTY_LINEITEM} d)) AS duplicate_rows,
  100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (dup) FROM {DIRTY_LINEITEM} d))) / count(*) AS duplicate_pct,
  5 AS numeric_cols, 2 AS categorical_cols, 0 AS datetime_cols
FROM (SELECT (l_quantity IS NULL)::INT + (l_linestatus IS NULL)::INT + (l_tax_sparse IS NULL)::INT AS missing
      FROM {DIRTY_LINEITEM} v)"""


@query("table_info", INFO, "missing_pct duplicate_pct")
def _(t):
    return p.table_info(no_dup(t))


@query("missing_profile", f"""
SELECT * FROM ({per_column(DIRTY_LINEITEM, ["l_quantity", "l_linestatus", "l_tax_sparse"],
  "SELECT '{c}' AS 'column', count(*) - count({c}) AS missing, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct FROM {src} v")})
""", "missing_pct")
def _(t):
    return p.missing_profile(t.dirty_lineitem)


@query("missing_indicator", f"""
SELECT l_orderkey, l_linenumber, dup, 0.0::DOUBLE AS l_returnflag, (l_quantity IS NULL)::INT::DOUBLE AS l_quantity,
  0.0::DOUBLE AS l_extendedprice, (l_linestatus IS NULL)::INT::DOUBLE AS l_linestatus,
  (l_tax_sparse IS NULL)::INT::DOUBLE AS l_tax_sparse FROM {DIRTY_LINEITEM} v""")
def _(t):
    return p.missing_indicator(t.dirty_lineitem, ["l_orderkey", "l_linenumber", "dup"])


# --- numeric columns -------------------------------------------------------------------------

@query("describe_numeric", f"""
SELECT s.column_name AS 'column', cnt AS count, n_rows - cnt AS missing, 100.0 * (n_rows - cnt) / n_rows AS missing_pct, mean, std,
  variance, lo AS min, q25, med AS median, q75, hi AS max, skew, kurt AS kurtosis, mode FROM
 ({per_column(DIRTY_LINEITEM, NUMERIC, MOMENTS)}) s JOIN
 ({per_column(DIRTY_LINEITEM, NUMERIC, "SELECT * FROM (SELECT '{c}' AS column_name, {c} AS mode FROM {src} v WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 1)")}) m
 USING (column_name)""", "missing_pct mean std variance q25 median q75 skew kurtosis", 3)
def _(t):
    return p.describe_numeric(t.dirty_lineitem, NUMERIC)


@query("outlier_profile", f"""
SELECT column_name AS 'column', q25, q75, lower, upper, outliers, outlier_pct FROM ({numeric_sql(DIRTY_LINEITEM, NUMERIC)})""",
       "q25 q75 lower upper outlier_pct", 4)
def _(t):
    return p.outlier_profile(t.dirty_lineitem, NUMERIC)


@query("column_stats_numeric", f"""
WITH s AS (SELECT n_rows::DOUBLE AS n_rows, cnt::DOUBLE AS count, (n_rows - cnt)::DOUBLE AS missing,
    100.0::DOUBLE * (n_rows - cnt) / n_rows AS missing_pct, mean, std, variance, lo AS min, q05, q25, med AS median, q75, q95, hi AS max,
    skew, kurt AS kurtosis, zeros::DOUBLE AS zeros, negatives::DOUBLE AS negatives, lower, upper, outliers::DOUBLE AS outliers,
    outlier_pct::DOUBLE AS outlier_pct FROM ({numeric_sql("customer", ["c_acctbal"])}))
SELECT name AS stat, value FROM (UNPIVOT s ON COLUMNS(*))
UNION ALL (SELECT 'top_' || row_number() OVER (ORDER BY c_acctbal DESC), c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 5)
UNION ALL (SELECT 'bottom_' || row_number() OVER (ORDER BY c_acctbal), c_acctbal FROM customer ORDER BY c_acctbal LIMIT 5)""", "value", 4)
def _(t):
    return p.column_stats_numeric(t.customer, "c_acctbal")


# --- categorical columns ---------------------------------------------------------------------

@query("describe_categorical", f"""
SELECT column_name AS 'column', uniq AS "unique", n_rows - non_null AS missing, 100.0 * (n_rows - non_null) / n_rows AS missing_pct,
  mode_value AS top, mode_n AS freq, 100.0 * mode_n / non_null AS freq_pct
FROM ({text_sql(DIRTY_CUSTOMER, ["segment", "name", "nation_text", "opt_in_text"])})""", "missing_pct freq_pct")
def _(t):
    return p.describe_categorical(t.dirty_customer)


@query("text_profile", f"""
SELECT column_name AS 'column', uniq AS "unique", uniq_lower AS unique_lower, numeric_rows, date_rows, space_rows, special_rows,
  any_upper, len_min, len_max, len_mean FROM ({text_sql(DIRTY_CUSTOMER, ["segment", "name", "nation_text", "opt_in_text"])})""", "len_mean")
def _(t):
    return p.text_profile(t.dirty_customer).select(
        "column", "unique", "unique_lower", "numeric_rows", "date_rows", "space_rows", "special_rows", "any_upper",
        "len_min", "len_max", "len_mean")


@query("column_stats_categorical", """
WITH f AS (SELECT count(DISTINCT p_name) AS "unique", count(*) - count(p_name) AS missing, min(length(p_name)) AS len_min,
  max(length(p_name)) AS len_max, avg(length(p_name)) AS len_mean, count(p_name) AS c FROM part)
SELECT p_name AS value, count(*) AS n, 100.0 * count(*) / c AS pct, "unique", missing, len_min, len_max, len_mean
FROM part, f GROUP BY ALL ORDER BY n DESC, value LIMIT 10""".replace("GROUP BY ALL", "GROUP BY p_name, c, \"unique\", missing, len_min, len_max, len_mean"),
       "pct len_mean")
def _(t):
    return p.column_stats_categorical(t.part, "p_name")


@query("top_values", """
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1),
     r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS i, sum(n) OVER () AS total FROM c)
SELECT CASE WHEN i <= 10 THEN value ELSE 'Others' END AS value, sum(n)::BIGINT AS n, 100.0 * sum(n) / max(total) AS pct
FROM r GROUP BY 1""", "pct")
def _(t):
    return p.top_values(t.part, "p_brand")


@query("text_length_stats", """
SELECT avg(length(text)) AS mean, median(length(text))::DOUBLE AS median, min(length(text))::DOUBLE AS min,
  max(length(text))::DOUBLE AS max FROM documents""", "mean median")
def _(t):
    return p.text_length_stats(t.documents, "text")


@query("text_length_histogram", """
WITH l AS (SELECT length(text)::DOUBLE AS v FROM conversations), s AS (SELECT min(v) AS lo, max(v) AS hi FROM l),
     b AS (SELECT least(30, floor((v - lo) / ((hi - lo) / 30))::INT + 1) AS bin FROM l, s)
SELECT i::INT AS bin, lo + (i - 1) * (hi - lo) / 30 AS left, lo + i * (hi - lo) / 30 AS right,
       count(b.bin) AS n FROM range(1, 31) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i GROUP BY i, lo, hi""", '"left" "right"', 4)
def _(t):
    return p.text_length_histogram(t.conversations, "text")


@query("column_sample", f"""
SELECT l_orderkey, l_linenumber, dup, l_quantity FROM {DIRTY_LINEITEM} v WHERE l_quantity IS NOT NULL
ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, dup, 42)), l_orderkey, l_linenumber, dup, l_quantity LIMIT 5""")
def _(t):
    return p.column_sample(t.dirty_lineitem, "l_quantity", 5, ["l_orderkey", "l_linenumber", "dup"])


# --- dates -----------------------------------------------------------------------------------

@query("column_stats_datetime", """
SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last,
  (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::BIGINT AS range_days, count(o_orderdate) AS count FROM orders""")
def _(t):
    return p.date_stats(t.orders, "o_orderdate")


@query("datetime_component_counts", """
SELECT 'year' AS part, year(ts)::INT AS key, year(ts)::VARCHAR AS label, count(*) AS n FROM events GROUP BY 2, 3
UNION ALL SELECT 'month', month(ts)::INT, monthname(ts), count(*) FROM events GROUP BY 2, 3
UNION ALL SELECT 'day', day(ts)::INT, day(ts)::VARCHAR, count(*) FROM events GROUP BY 2, 3
UNION ALL SELECT 'hour', hour(ts)::INT, hour(ts)::VARCHAR, count(*) FROM events GROUP BY 2, 3
UNION ALL SELECT 'weekday', (isodow(ts) - 1)::INT, dayname(ts), count(*) FROM events GROUP BY 2, 3""")
def _(t):
    return p.date_counts(t.events, "ts", ["year", "month", "day", "hour", "weekday"])


@query("column_stats_datetime_counts", """
SELECT 'year' AS part, year(o_orderdate)::INT AS key, year(o_orderdate)::VARCHAR AS label, count(*) AS n FROM orders GROUP BY 2, 3
UNION ALL SELECT 'month', month(o_orderdate)::INT, monthname(o_orderdate), count(*) FROM orders GROUP BY 2, 3
UNION ALL SELECT 'weekday', (isodow(o_orderdate) - 1)::INT, dayname(o_orderdate), count(*) FROM orders GROUP BY 2, 3""")
def _(t):
    return p.date_counts(t.orders, "o_orderdate", ["year", "month", "weekday"])


@query("date_coverage", """
SELECT (max(ts)::DATE - min(ts)::DATE)::BIGINT AS span_days, count(DISTINCT ts::DATE) AS distinct_days,
  (DATE '2024-06-01' - max(ts)::DATE)::BIGINT AS stale_days, count(DISTINCT strftime(ts, '%Y-%m')) AS months,
  count(DISTINCT year(ts)) AS years, count(DISTINCT ts::DATE) < 0.7 * (max(ts)::DATE - min(ts)::DATE) AS has_gaps
FROM (SELECT * FROM events WHERE day(ts) NOT IN (5, 6, 17))""")
def _(t):
    return p.date_coverage(t.gappy_events, "ts", "2024-06-01")


# --- type hints ------------------------------------------------------------------------------

@query("potential_datetime_columns", f"""
WITH f AS (SELECT 'order_date_text' AS 'column', count(order_date_text) AS c,
  count(*) FILTER (WHERE {DATE_TRY.replace("{c}", "order_date_text")} IS NOT NULL) AS date_rows,
  count(*) FILTER (WHERE regexp_matches(order_date_text, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')) AS pattern_rows,
  count(DISTINCT order_date_text) AS u FROM {TEXT_DATES} v)
SELECT "column", CASE WHEN c = date_rows THEN 'parsed' ELSE 'pattern' END AS evidence, date_rows, pattern_rows FROM f WHERE c = date_rows OR (u < 100 AND pattern_rows > 0.75 * c)""")
def _(t):
    return p.potential_datetime_columns(t.text_dates)


@query("suggest_type", f"""
WITH f AS (SELECT count(DISTINCT c_acctbal) AS a, count(DISTINCT segment) AS s, count(DISTINCT name) AS nm,
  count(DISTINCT nation_text) AS nt, count(DISTINCT opt_in_text) AS o, count(*) AS n,
  count(*) FILTER (WHERE try_cast(trim(nation_text) AS DOUBLE) IS NOT NULL) AS num FROM {DIRTY_CUSTOMER} v)
SELECT 'c_custkey' AS 'column', 'bigint' AS current_type, 'bigint' AS suggested_type FROM f
UNION ALL SELECT 'c_acctbal', 'double', 'double' FROM f
UNION ALL SELECT 'segment', 'string', CASE WHEN s <= 20 THEN 'category' ELSE 'string' END FROM f
UNION ALL SELECT 'name', 'string', CASE WHEN nm <= 20 THEN 'category' ELSE 'string' END FROM f
UNION ALL SELECT 'nation_text', 'string', CASE WHEN nt <= 20 THEN 'category' WHEN num > 0.8 * n THEN 'int64' ELSE 'string' END FROM f
UNION ALL SELECT 'opt_in_text', 'string', CASE WHEN o <= 20 THEN 'category' ELSE 'string' END FROM f""")
def _(t):
    return p.suggest_type(t.dirty_customer)


# --- combined profile and rules --------------------------------------------------------------

@query("full_profile", f"""
WITH m AS ({numeric_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"])}),
     x AS ({text_sql("customer", ["c_name", "c_mktsegment"])}),
     u AS ({per_column("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                       "SELECT '{c}' AS column_name, count(*) AS n, count(DISTINCT {c}) AS u, count({c}) AS c FROM {src}")})
SELECT u.column_name AS 'column', CASE u.column_name WHEN 'c_custkey' THEN 'bigint' WHEN 'c_nationkey' THEN 'int'
  WHEN 'c_acctbal' THEN 'double' ELSE 'string' END AS dtype, n AS n_rows, n - c AS missing, 100.0 * (n - c) / n AS missing_pct, u AS "unique",
  100.0 * u / n AS unique_pct, mean, std, lo AS min, q25, med AS median, q75, hi AS max, skew, kurt AS kurtosis, zeros, outliers,
  lower, upper, mode_value AS top, mode_n AS freq, len_min, len_max, len_mean
FROM u LEFT JOIN m USING (column_name) LEFT JOIN x USING (column_name)""",
       "missing_pct unique_pct mean std min q25 median q75 max skew kurtosis lower upper len_mean", 4)
def _(t):
    return p.full_profile(t.customer)


@query("column_insights_numeric", f"""
WITH m AS ({numeric_sql("events", ["value"])}), u AS (SELECT count(DISTINCT value) AS u FROM events),
f AS (SELECT *, abs(mean - med) * 100 / med AS gap, 100.0 * u / n_rows AS share FROM m, u)
SELECT column_name AS 'column', insight FROM f, LATERAL (SELECT unnest([
  CASE WHEN skew > 1 THEN 'skewed_right' END, CASE WHEN skew < -1 THEN 'skewed_left' END,
  CASE WHEN abs(skew) BETWEEN 0.5 AND 1 THEN 'moderate_skew' END,
  CASE WHEN gap > 10 AND mean > med THEN 'mean_above_median' END, CASE WHEN gap > 10 AND mean < med THEN 'median_above_mean' END,
  CASE WHEN outlier_pct > 10 THEN 'many_outliers' END, CASE WHEN outlier_pct > 0 AND outlier_pct <= 10 THEN 'some_outliers' END,
  CASE WHEN 100.0 * zeros / n_rows > 10 THEN 'many_zeros' END, CASE WHEN share < 1 THEN 'few_distinct' END,
  CASE WHEN share > 90 THEN 'mostly_distinct' END, CASE WHEN kurt >= 0.5 THEN 'heavy_tails' END,
  CASE WHEN kurt <= -0.5 THEN 'light_tails' END]) AS insight) WHERE insight IS NOT NULL""")
def _(t):
    return p.numeric_insights(t.events, ["value"])


@query("column_insights_categorical", f"""
WITH f AS (SELECT *, uniq < 20 AS low, 100.0 * mode_n / non_null AS top_pct FROM ({text_sql(DIRTY_CUSTOMER, ["segment", "name", "nation_text", "opt_in_text"])}))
SELECT column_name AS 'column', insight FROM f, LATERAL (SELECT unnest([
  CASE WHEN low AND top_pct > 80 THEN 'extreme_imbalance' END, CASE WHEN low AND top_pct > 50 AND top_pct <= 80 THEN 'moderate_imbalance' END,
  CASE WHEN low AND uniq = 2 THEN 'binary' END, CASE WHEN low AND uniq <> 2 AND uniq <= 10 THEN 'low_cardinality' END,
  CASE WHEN low AND uniq > 10 THEN 'higher_cardinality' END, CASE WHEN low AND n_rows > non_null THEN 'has_missing' END,
  CASE WHEN NOT low AND 100.0 * uniq / n_rows > 90 THEN 'identifier' END,
  CASE WHEN NOT low AND 100.0 * (n_rows - non_null) / n_rows > 20 THEN 'mostly_missing' END]) AS insight) WHERE insight IS NOT NULL""")
def _(t):
    return p.categorical_insights(t.dirty_customer)


@query("suggest_targets", """
SELECT 'o_orderstatus' AS 'column', 2 AS place, 'status' AS keyword,
  CASE WHEN u = 2 THEN 'classification' WHEN u < 10 THEN 'classification' END AS kind,
  CASE WHEN u = 2 THEN 'high' ELSE 'medium' END AS likelihood
FROM (SELECT count(DISTINCT o_orderstatus) AS u FROM orders) WHERE u < 10""")
def _(t):
    return p.suggest_targets(t.orders)


@query("suggest_targets_fallback", """
WITH u AS (SELECT count(DISTINCT s_suppkey) AS k, count(DISTINCT s_nationkey) AS n, count(DISTINCT s_acctbal) AS a FROM supplier)
SELECT 's_suppkey' AS 'column', 30000 AS place, NULL::VARCHAR AS keyword, 'regression' AS kind, 'low' AS likelihood FROM u WHERE k > 10
UNION ALL SELECT 's_nationkey', 30002, NULL, 'regression', 'low' FROM u WHERE n > 10""")
def _(t):
    return p.suggest_targets(t.supplier)


@query("suggest_features", f"""
WITH v AS (SELECT skewness(value) AS sv, skewness(event_id) AS se, skewness(user_id) AS su, count(DISTINCT props) AS up,
  avg(length(props)) AS lp, count(DISTINCT event_type) AS ut, avg(length(event_type)) AS lt FROM events)
SELECT 'ts' AS 'column', 'datetime' AS kind FROM v
UNION ALL SELECT 'value', CASE WHEN sv > 0 THEN 'reduce_right_skew' ELSE 'reduce_left_skew' END FROM v WHERE abs(sv) > 1.5
UNION ALL SELECT 'event_id', CASE WHEN se > 0 THEN 'reduce_right_skew' ELSE 'reduce_left_skew' END FROM v WHERE abs(se) > 1.5
UNION ALL SELECT 'user_id', CASE WHEN su > 0 THEN 'reduce_right_skew' ELSE 'reduce_left_skew' END FROM v WHERE abs(su) > 1.5
UNION ALL SELECT 'props', CASE WHEN lp > 20 THEN 'text' ELSE 'high_cardinality' END FROM v WHERE up > 10 OR lp > 20
UNION ALL SELECT 'event_type', CASE WHEN lt > 20 THEN 'text' ELSE 'high_cardinality' END FROM v WHERE ut > 10 OR lt > 20
UNION ALL SELECT 'interactions', 'interaction' FROM v""")
def _(t):
    return p.suggest_features(t.events)


# --- quality ---------------------------------------------------------------------------------

CUSTOMER_TEXTS = ["segment", "name", "nation_text", "opt_in_text"]
PARTS_SQL = f"""
WITH x AS ({text_sql(DIRTY_CUSTOMER, CUSTOMER_TEXTS)}), m AS ({numeric_sql(DIRTY_CUSTOMER, ["c_custkey", "c_acctbal"])}),
a AS (SELECT count(*) FILTER (WHERE uniq > 100 AND uniq > 0.5 * n_rows) AS high_card_cols,
   count(*) FILTER (WHERE numeric_rows > 0.8 * non_null) + count(*) FILTER (WHERE date_rows > 0.8 * non_null) AS dtype_issues,
   count(*) FILTER (WHERE uniq < 10 AND any_upper) + count(*) FILTER (WHERE uniq < 10 AND space_rows > 0) AS text_issues FROM x),
b AS (SELECT count(*) FILTER (WHERE outlier_pct > 10) AS outlier_cols, count(*) FILTER (WHERE abs(skew) > 3) AS skewed_cols,
   max(n_rows) AS n_rows FROM m),
c AS (SELECT 100.0 * sum((nation_text IS NULL)::INT) / (count(*) * 6) AS missing_pct,
   100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY_CUSTOMER} d))) / count(*) AS duplicate_pct FROM {DIRTY_CUSTOMER} v),
s AS (SELECT *, greatest(0, least(100, round_even(100 - least(30, 3 * missing_pct) - least(15, 3 * duplicate_pct)
   - least(10, 2 * high_card_cols) - least(15, 3 * outlier_cols), 0))) AS first FROM a, b, c)
"""


@query("quality_score", PARTS_SQL + """
SELECT n_rows, missing_pct, duplicate_pct, outlier_cols, skewed_cols, high_card_cols, dtype_issues, text_issues,
  greatest(0, least(100, round_even(first - least(15, 3 * dtype_issues) - least(5, skewed_cols) - least(10, 2 * text_issues), 0)))::INT AS score
FROM s""", "missing_pct duplicate_pct")
def _(t):
    return q.quality_score(t.dirty_customer)


@query("quality_issues", f"""
WITH x AS ({text_sql(DIRTY_LINEITEM, ["l_returnflag", "l_linestatus"])}),
m AS ({numeric_sql(DIRTY_LINEITEM, ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax_sparse"])}),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (dup) FROM {DIRTY_LINEITEM} d)) AS n FROM {DIRTY_LINEITEM} v)
SELECT 'missing' AS issue, column_name AS 'column', (n_rows - cnt)::DOUBLE AS amount FROM m WHERE n_rows > cnt
UNION ALL SELECT 'missing', column_name, (n_rows - non_null)::DOUBLE FROM x WHERE n_rows > non_null
UNION ALL SELECT 'duplicates', NULL, n::DOUBLE FROM d WHERE n > 0
UNION ALL SELECT 'outliers', column_name, outlier_pct::DOUBLE FROM m WHERE outliers > 0
UNION ALL SELECT 'skewed', column_name, skew FROM m WHERE abs(skew) > 3
UNION ALL SELECT 'likely_numeric', column_name, numeric_rows::DOUBLE FROM x WHERE numeric_rows > 0.8 * non_null
UNION ALL SELECT 'likely_datetime', column_name, date_rows::DOUBLE FROM x WHERE date_rows > 0.8 * non_null
UNION ALL SELECT 'high_cardinality', column_name, uniq::DOUBLE FROM x WHERE uniq > 100 AND uniq > 0.5 * n_rows
UNION ALL SELECT 'text_format', column_name, uniq::DOUBLE FROM x WHERE uniq < 15 AND (uniq_lower < uniq OR space_rows > 0)""", "amount", 4)
def _(t):
    return q.quality_issues(no_dup(t))


ISSUES_SQL = f"""
WITH x AS ({text_sql(DIRTY_CUSTOMER, CUSTOMER_TEXTS)}), m AS ({numeric_sql(DIRTY_CUSTOMER, ["c_custkey", "c_acctbal"])}),
i AS (
SELECT column_name AS 'column', 'outliers' AS issue, outliers AS count, 100.0 * outliers / n_rows AS pct FROM m WHERE outliers > 0
UNION ALL SELECT column_name, 'zeros', zeros, 100.0 * zeros / n_rows FROM m WHERE zeros > 0
UNION ALL SELECT column_name, 'negatives', negatives, 100.0 * negatives / n_rows FROM m WHERE negatives > 0
UNION ALL SELECT column_name, 'missing_values', n_rows - cnt, 100.0 * (n_rows - cnt) / n_rows FROM m WHERE n_rows > cnt
UNION ALL SELECT column_name, 'missing_values', n_rows - non_null, 100.0 * (n_rows - non_null) / n_rows FROM x WHERE n_rows > non_null
UNION ALL SELECT column_name, 'possible_numeric', numeric_rows, 100.0 * numeric_rows / non_null FROM x WHERE numeric_rows > 0.8 * non_null
UNION ALL SELECT column_name, 'possible_datetime', date_rows, 100.0 * date_rows / non_null FROM x WHERE date_rows > 0.8 * non_null
UNION ALL SELECT column_name, 'inconsistent_case', uniq - uniq_lower, 100.0 * (uniq - uniq_lower) / uniq FROM x WHERE uniq_lower < uniq
UNION ALL SELECT column_name, 'whitespace', space_rows, 100.0 * space_rows / n_rows FROM x WHERE space_rows > 0
UNION ALL SELECT column_name, 'special_characters', special_rows, 100.0 * special_rows / n_rows FROM x WHERE special_rows > 0
UNION ALL SELECT column_name, 'high_cardinality', uniq, 100.0 * uniq / n_rows FROM x WHERE uniq > 50 AND uniq > 0.5 * n_rows)
"""


@query("cleaning_issues", ISSUES_SQL + "SELECT * FROM i", "pct")
def _(t):
    return q.cleaning_issues(t.dirty_customer)


@query("cleaning_suggestions", ISSUES_SQL + """
SELECT "column", issue, CASE issue
  WHEN 'missing_values' THEN CASE WHEN pct > 80 THEN 'drop column' WHEN pct > 30 THEN 'drop or impute with median or mode'
    ELSE 'impute with mean, median or mode' END
  WHEN 'outliers' THEN CASE WHEN pct > 10 THEN 'investigate outliers' WHEN pct > 2 THEN 'cap or transform' ELSE 'remove or cap' END
  WHEN 'zeros' THEN 'check whether zeros mean missing' WHEN 'negatives' THEN 'verify negative values'
  WHEN 'possible_numeric' THEN 'convert to numeric' WHEN 'possible_datetime' THEN 'convert to datetime'
  WHEN 'inconsistent_case' THEN 'standardize case' WHEN 'whitespace' THEN 'strip whitespace'
  WHEN 'special_characters' THEN 'remove special characters' WHEN 'high_cardinality' THEN 'group or encode categories'
  END AS action FROM i""")
def _(t):
    return q.cleaning_suggestions(t.dirty_customer)


ALL_NUMERIC = ["l_orderkey", "l_linenumber", *NUMERIC, "dup"]
ALL_TEXT = ["l_returnflag", "l_linestatus"]


@query("impute_recommendation", f"""
WITH m AS ({numeric_sql(DIRTY_LINEITEM, ALL_NUMERIC)})
SELECT column_name AS 'column', CASE WHEN 100.0 * outliers / cnt > 5 THEN 'median' WHEN abs(skew) > 1 THEN 'median' ELSE 'mean' END AS method FROM m
UNION ALL {per_column(DIRTY_LINEITEM, ALL_TEXT, "SELECT '{c}', CASE WHEN count(DISTINCT {c}) < 10 THEN 'mode' ELSE 'constant' END FROM {src} v")}""")
def _(t):
    return q.impute_recommendation(t.dirty_lineitem)


@query("outlier_recommendation", f"""
SELECT column_name AS 'column', 100.0 * outliers / cnt AS outlier_pct, CASE WHEN 100.0 * outliers / cnt < 1 THEN 'remove'
  WHEN 100.0 * outliers / cnt < 5 THEN 'cap' ELSE 'transform' END AS method FROM ({numeric_sql(DIRTY_LINEITEM, ALL_NUMERIC)})""", "outlier_pct")
def _(t):
    return q.outlier_recommendation(t.dirty_lineitem)


@query("cleaning_diff", f"""
WITH b AS (SELECT count(*) AS n, count(*) - count(l_quantity) AS q, count(*) - count(l_tax_sparse) AS tx FROM {DIRTY_LINEITEM} v),
     a AS (SELECT count(*) AS n, count(*) - count(l_quantity) AS q FROM {DIRTY_LINEITEM} v WHERE l_linestatus IS NOT NULL)
SELECT 'l_orderkey' AS 'column', 'kept' AS status, false AS type_changed, 0::BIGINT AS missing_before, 0::BIGINT AS missing_after, b.n - a.n AS rows_removed FROM a, b
UNION ALL SELECT 'l_quantity', 'kept', true, b.q, a.q, b.n - a.n FROM a, b
UNION ALL SELECT 'l_tax_sparse', 'removed', NULL, b.tx, NULL, b.n - a.n FROM a, b
UNION ALL SELECT 'flag', 'new', NULL, NULL, 0, b.n - a.n FROM a, b""")
def _(t):
    before = t.dirty_lineitem.select("l_orderkey", "l_quantity", "l_tax_sparse")
    after = (t.dirty_lineitem.where("l_linestatus IS NOT NULL")
             .select("l_orderkey", F.col("l_quantity").cast("int").alias("l_quantity"), F.col("l_returnflag").alias("flag")))
    return q.cleaning_diff(before, after)


def insights_sql(source: str, numeric: list[str], texts: list[str], dates: list[str], target: str) -> str:
    """All findings about a table. ``target`` is a query of (column, kind) for the best target."""
    both = numeric_sql(source, numeric)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {source} v"
                               for i, a in enumerate(numeric) for b in numeric[i + 1:])
    columns = [*numeric, *texts, *dates]
    holes = per_column(source, columns, "SELECT '{c}' AS c, count(*) - count({c}) AS missing, count(*) AS n FROM {src} v")
    place = lambda names, c: "CASE " + " ".join(f"WHEN {c} = '{n}' THEN {i}" for i, n in enumerate(names)) + " END"
    parts = [
        f"""SELECT 1 AS section, 'overview' AS insight_type, 1 AS place, NULL AS 'column', NULL AS other, count(*)::DOUBLE AS value, {len(columns)}::DOUBLE AS second,
  'numeric={len(numeric)} categorical={len(texts)} datetime={len(dates)}' AS detail FROM {source} v""",
        f"""SELECT 2, 'missing', row_number() OVER (ORDER BY missing DESC, {place(INSIGHT_ORDER, 'c')}), c, NULL, missing, 100.0 * missing / n, NULL FROM ({holes}) h WHERE missing > 0""",
        f"""SELECT 3, 'distribution', row_number() OVER (ORDER BY {place(numeric, 'column_name')}), column_name, NULL, mean, med, concat_ws(',', CASE WHEN skew > 1 THEN 'skewed_right' END,
  CASE WHEN skew < -1 THEN 'skewed_left' END, CASE WHEN med <> 0 AND abs(mean - med) * 100 / abs(med) > 10 THEN 'mean_off_median' END) FROM ({both})""",
        f"""SELECT 4, 'breakdown', row_number() OVER (ORDER BY {place(texts, 'column_name')}), column_name, NULL, 100.0 * mode_n / non_null, uniq, mode_value FROM ({text_sql(source, texts)})""",
        f"""SELECT 5, 'correlation', row_number() OVER (ORDER BY abs(r) DESC, a, b), a, b, r, NULL, CASE WHEN abs(r) > .8 THEN 'strong ' ELSE 'moderate ' END ||
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END FROM ({pairs}) WHERE abs(r) > .6""",
        f"SELECT 6, 'outliers', row_number() OVER (ORDER BY outlier_pct DESC, {place(numeric, 'column_name')}), column_name, NULL, outlier_pct, NULL, NULL FROM ({both}) WHERE outlier_pct > 5",
        f"SELECT 8, 'group_comparison', 1, '{numeric[0]}', '{texts[0]}', NULL, NULL, NULL FROM {source} v HAVING count(DISTINCT {texts[0]}) <= 10",
        f"SELECT 9, 'predictive', 1, c, NULL, NULL, NULL, kind FROM ({target})",
    ]
    if dates:
        varied = per_column(source, numeric, "SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM {src} v")
        parts.append(f"SELECT 7, 'time_trend', 1, c, '{dates[0]}', NULL, NULL, NULL FROM ({varied}) WHERE u > 10 QUALIFY row_number() OVER (ORDER BY {place(numeric, 'c')}) = 1")
    rows = " UNION ALL ".join(parts)
    return f"SELECT section::INT AS section, insight_type, place::INT AS place, \"column\"::VARCHAR AS 'column', other::VARCHAR AS other, value::DOUBLE AS value, second::DOUBLE AS second, detail::VARCHAR AS detail FROM ({rows})"


INSIGHT_ORDER = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus", "l_tax_sparse"]


@query("dataset_insights", insights_sql(DIRTY_LINEITEM, ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax_sparse"], ["l_returnflag", "l_linestatus"], [],
       "SELECT 'l_linestatus' AS c, 'classification' AS kind"), "value second", 4)
def _(t):
    return dataset_insights(no_dup(t))


@query("dataset_insights_dates", insights_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"],
       "SELECT 'o_orderstatus' AS c, 'classification' AS kind"), "value second", 4)
def _(t):
    return dataset_insights(t.orders)
