"""Cleaning, type conversion and feature engineering over the derived dirty views."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.operators import clean as c
from prismal.operators import features as f
from prismal.operators import types as ty
from prismal.plans.scalars import union_all
from prismal.queries.profile_queries import CUSTOMER_TEXTS, text_sql
from prismal.queries.registry import DIRTY_CUSTOMER, DIRTY_LINEITEM, TEXT_DATES, query

KEYS = ["l_orderkey", "l_linenumber", "dup"]
LINE = DIRTY_LINEITEM
FENCES = """(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
 (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src} w))"""


def fences(column: str, source: str) -> str:
    return FENCES.replace("{c}", column).replace("{src}", source)


# --- missing values --------------------------------------------------------------------------

@query("impute_mean", f"""
SELECT l_orderkey, l_linenumber, dup, coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LINE} w)) AS l_quantity FROM {LINE} v""", "l_quantity")
def _(t):
    return c.impute_mean(t.dirty_lineitem, ["l_quantity"]).select(*KEYS, "l_quantity")


@query("impute_median", f"""
SELECT l_orderkey, l_linenumber, dup, coalesce(l_quantity, (SELECT median(l_quantity) FROM {LINE} w)) AS l_quantity,
  coalesce(l_tax_sparse, (SELECT median(l_tax_sparse) FROM {LINE} w)) AS l_tax_sparse FROM {LINE} v""", "l_quantity l_tax_sparse")
def _(t):
    return c.impute_median(t.dirty_lineitem, ["l_quantity", "l_tax_sparse"]).select(*KEYS, "l_quantity", "l_tax_sparse")


MODE_STATUS = f"(SELECT l_linestatus FROM {LINE} w WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
MODE_TAX = f"(SELECT l_tax_sparse FROM {LINE} w WHERE l_tax_sparse IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("impute_mode", f"""
SELECT l_orderkey, l_linenumber, dup, coalesce(l_linestatus, {MODE_STATUS}) AS l_linestatus,
  coalesce(l_tax_sparse, {MODE_TAX}) AS l_tax_sparse FROM {LINE} v""")
def _(t):
    return c.impute_mode(t.dirty_lineitem, ["l_linestatus", "l_tax_sparse"]).select(*KEYS, "l_linestatus", "l_tax_sparse")


@query("impute_constant", f"""
SELECT l_orderkey, l_linenumber, dup, coalesce(l_linestatus, 'none') AS l_linestatus, coalesce(l_quantity, -1) AS l_quantity FROM {LINE} v""")
def _(t):
    return c.impute_constant(t.dirty_lineitem, {"l_linestatus": "none", "l_quantity": -1}).select(*KEYS, "l_linestatus", "l_quantity")


@query("drop_missing", f"""
SELECT 'column' AS how, l_orderkey, l_linenumber, dup FROM {LINE} v WHERE l_quantity IS NOT NULL
UNION ALL SELECT 'any', l_orderkey, l_linenumber, dup FROM {LINE} v
WHERE l_quantity IS NOT NULL AND l_linestatus IS NOT NULL AND l_tax_sparse IS NOT NULL""")
def _(t):
    d = t.dirty_lineitem
    return union_all([c.drop_missing(d, ["l_quantity"]).select(F.lit("column").alias("how"), *KEYS),
                      c.drop_missing(d).select(F.lit("any").alias("how"), *KEYS)])


@query("auto_impute", f"""
SELECT l_orderkey, l_linenumber, dup, l_returnflag, coalesce(l_quantity, (SELECT median(l_quantity) FROM {LINE} w)) AS l_quantity,
  l_extendedprice, coalesce(l_linestatus, {MODE_STATUS}) AS l_linestatus FROM {LINE} v""", "l_quantity l_extendedprice")
def _(t):
    return c.auto_impute(t.dirty_lineitem)


@query("impute_all", f"""
SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, dup::DOUBLE AS dup, l_returnflag,
  coalesce(l_quantity, (SELECT median(l_quantity) FROM {LINE} w)) AS l_quantity, l_extendedprice,
  coalesce(l_linestatus, {MODE_STATUS}) AS l_linestatus,
  coalesce(l_tax_sparse, (SELECT median(l_tax_sparse) FROM {LINE} w)) AS l_tax_sparse FROM {LINE} v""",
       "l_quantity l_extendedprice l_tax_sparse")
def _(t):
    return c.impute_all(t.dirty_lineitem)


# --- duplicates ------------------------------------------------------------------------------

@query("dedupe_first", f"SELECT DISTINCT * EXCLUDE (dup) FROM {LINE} v")
def _(t):
    return c.dedupe_first(t.dirty_lineitem.drop("dup"))


SUBSET = ["l_returnflag", "l_quantity", "l_tax_sparse"]


@query("dedupe_first_subset", f"""
SELECT l_orderkey, l_linenumber, dup, l_returnflag, l_quantity, l_tax_sparse FROM {LINE} v
QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_quantity, l_tax_sparse ORDER BY l_orderkey, l_linenumber, dup) = 1""")
def _(t):
    return c.dedupe_first(t.dirty_lineitem.select(*KEYS, *SUBSET), SUBSET, KEYS)


@query("dedupe_last", f"""
SELECT l_orderkey, l_linenumber, dup, l_returnflag, l_quantity, l_tax_sparse FROM {LINE} v
QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_quantity, l_tax_sparse
  ORDER BY l_orderkey DESC, l_linenumber DESC, dup DESC) = 1""")
def _(t):
    return c.dedupe_last(t.dirty_lineitem.select(*KEYS, *SUBSET), SUBSET, KEYS)


@query("dedupe_none", f"""
SELECT * EXCLUDE (dup) FROM {LINE} v
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_linestatus, l_tax_sparse) = 1""")
def _(t):
    return c.dedupe_none(t.dirty_lineitem.drop("dup"))


@query("duplicate_rows", f"""
SELECT * FROM {LINE} v
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_linestatus, l_tax_sparse ORDER BY dup) > 1""")
def _(t):
    d = t.dirty_lineitem
    return c.duplicate_rows(d, [x for x in d.columns if x != "dup"], ["dup"])


@query("duplicate_count", f"""
WITH g AS (SELECT count(*) AS n FROM {LINE} v GROUP BY l_returnflag, l_quantity, l_tax_sparse)
SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicates, 100.0 * sum(n - 1) / sum(n) AS duplicate_pct FROM g""", "duplicate_pct")
def _(t):
    return c.duplicate_count(t.dirty_lineitem, SUBSET)


# --- outliers --------------------------------------------------------------------------------

@query("iqr_bounds", f"""
SELECT 'l_extendedprice' AS 'column', q1, q3, q3 - q1 AS iqr, lo AS lower, hi AS upper FROM {fences("l_extendedprice", LINE)}
UNION ALL SELECT 'l_quantity', q1, q3, q3 - q1, lo, hi FROM {fences("l_quantity", LINE)}""", "q1 q3 iqr lower upper")
def _(t):
    return c.iqr_bounds(t.dirty_lineitem, ["l_extendedprice", "l_quantity"])


@query("cap_outliers", f"""
SELECT l_orderkey, l_linenumber, dup, CASE WHEN l_extendedprice < lo THEN lo WHEN l_extendedprice > hi THEN hi
  ELSE l_extendedprice END AS l_extendedprice FROM {LINE} v, {fences("l_extendedprice", LINE)} b""", "l_extendedprice")
def _(t):
    return c.cap_outliers(t.dirty_lineitem, ["l_extendedprice"]).select(*KEYS, "l_extendedprice")


@query("remove_outliers", f"""
SELECT l_orderkey, l_linenumber, dup, l_extendedprice FROM {LINE} v, {fences("l_extendedprice", LINE)} b
WHERE l_extendedprice BETWEEN lo AND hi""")
def _(t):
    return c.remove_outliers(t.dirty_lineitem, ["l_extendedprice"]).select(*KEYS, "l_extendedprice")


@query("outlier_mask", f"""
SELECT l_orderkey, l_linenumber, dup, l_extendedprice < lo OR l_extendedprice > hi AS by_iqr,
  abs((l_extendedprice - m) / s) > 3 AS by_zscore FROM {LINE} v, {fences("l_extendedprice", LINE)} b,
  (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM {LINE} w) z""")
def _(t):
    both = c.outlier_mask(c.outlier_mask(t.dirty_lineitem, "l_extendedprice", "iqr", "by_iqr"), "l_extendedprice", "zscore", "by_zscore")
    return both.select(*KEYS, "by_iqr", "by_zscore")


# --- values, names, replay -------------------------------------------------------------------

@query("replace_values", f"""
SELECT c_custkey, CASE WHEN nation_text = 'n/a' THEN 'unknown' ELSE nation_text END AS nation_text,
  (SELECT count(*) FROM {DIRTY_CUSTOMER} w WHERE nation_text = 'n/a') AS occurrences FROM {DIRTY_CUSTOMER} v""")
def _(t):
    d = t.dirty_customer
    replaced = c.replace_values(d, "nation_text", "n/a", "unknown").select("c_custkey", "nation_text")
    return replaced.join(F.broadcast(c.count_value(d, "nation_text", "n/a")))  # one row


@query("drop_column", f"SELECT * EXCLUDE (opt_in_text) FROM {DIRTY_CUSTOMER} v")
def _(t):
    return c.drop_column(t.dirty_customer, "opt_in_text")


@query("clean_column_names", """
SELECT r_regionkey AS region_key, r_name AS col_1st_name, r_name AS "column", r_name AS column_1 FROM region""")
def _(t):
    r = t.region
    return c.clean_column_names(r.select(
        F.col("r_regionkey").alias(" Region Key!"), F.col("r_name").alias("1st Name"), F.col("r_name").alias("#"), F.col("r_name").alias("$$")))


@query("replay_pipeline", f"""
WITH a AS (SELECT DISTINCT * EXCLUDE (dup) FROM {LINE} v),
     b AS (SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(l_quantity, (SELECT median(l_quantity) FROM a)) AS l_quantity,
           l_extendedprice, l_linestatus FROM a WHERE l_linestatus IS NOT NULL)
SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS l_returnflag, l_quantity, CASE WHEN l_extendedprice < lo THEN lo
  WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END AS l_extendedprice, l_linestatus FROM b, {fences("l_extendedprice", "b")} z""".replace(
    "(SELECT median(l_quantity) FROM a)", "(SELECT median(l_quantity) FROM a WHERE l_linestatus IS NOT NULL)"), "l_quantity l_extendedprice")
def _(t):
    plan = (c.CleaningPlan(t.dirty_lineitem.drop("dup")).add("remove_duplicates").add("drop_missing", "l_linestatus")
            .add("fill_mean", "l_quantity").add("drop_column", "l_tax_sparse").add("uppercase", "l_linestatus"))
    plan = plan.without(2).undo().add("fill_median", "l_quantity").add("cap_outliers", "l_extendedprice").add("lowercase", "l_returnflag")
    return plan.result()


# --- types -----------------------------------------------------------------------------------

@query("to_numeric", f"SELECT c_custkey, try_cast(trim(nation_text) AS DOUBLE) AS nation FROM {DIRTY_CUSTOMER} v")
def _(t):
    return t.dirty_customer.select("c_custkey", ty.to_numeric("nation_text").alias("nation"))


@query("to_int", f"SELECT c_custkey, coalesce(try_cast(nation_text AS BIGINT), 0) AS nation, trunc(c_acctbal)::BIGINT AS whole FROM {DIRTY_CUSTOMER} v")
def _(t):
    return t.dirty_customer.select("c_custkey", ty.to_int("nation_text").alias("nation"), ty.to_int("c_acctbal").alias("whole"))


@query("to_string", "SELECT o_orderkey, o_custkey::VARCHAR AS customer FROM orders")
def _(t):
    return t.orders.select("o_orderkey", ty.to_string("o_custkey").alias("customer"))


@query("to_datetime", f"SELECT o_orderkey, try_strptime(order_date_text, '%Y-%m-%d')::DATE AS d FROM {TEXT_DATES} v")
def _(t):
    return t.text_dates.select("o_orderkey", F.to_date(ty.to_datetime("order_date_text", "yyyy-MM-dd")).alias("d"))


@query("to_boolean", f"SELECT c_custkey, CASE opt_in_text WHEN 'yes' THEN true WHEN 'no' THEN false END AS opt_in FROM {DIRTY_CUSTOMER} v")
def _(t):
    return t.dirty_customer.select("c_custkey", ty.to_boolean("opt_in_text").alias("opt_in"))


@query("to_binary", """
SELECT doc_id, quality::TINYINT AS quality, toxic::TINYINT AS toxic FROM labels""")
def _(t):
    return t.labels.select("doc_id", ty.to_binary("quality").alias("quality"), ty.to_binary("toxic").alias("toxic"))


@query("to_category", f"""
SELECT column_name AS 'column', uniq AS "unique", uniq < least(0.2 * n_rows, 50) AS is_category
FROM ({text_sql(DIRTY_CUSTOMER, CUSTOMER_TEXTS)})""")
def _(t):
    return ty.category_columns(t.dirty_customer)


PLAN_SQL = f"""
SELECT column_name AS 'column', CASE WHEN uniq <= least(0.5 * n_rows, 100) AND numeric_rows > 0.8 * non_null THEN 'double'
  WHEN uniq <= least(0.5 * n_rows, 100) AND date_rows > 0.8 * non_null THEN 'timestamp'
  WHEN uniq < least(0.2 * n_rows, 50) THEN 'category' ELSE 'string' END AS new_type, numeric_rows, date_rows, non_null
FROM ({text_sql(DIRTY_CUSTOMER, CUSTOMER_TEXTS)})"""


@query("infer_types_plan", PLAN_SQL)
def _(t):
    return ty.inference_plan(t.dirty_customer)


@query("infer_types", f"""
SELECT c_custkey, c_acctbal, segment, name, try_cast(nation_text AS DOUBLE) AS nation_text, opt_in_text FROM {DIRTY_CUSTOMER} v""")
def _(t):
    return ty.infer_types(t.dirty_customer)


@query("infer_types_strict", f"""
SELECT o_orderkey, o_totalprice, order_date_text FROM {TEXT_DATES} v""")
def _(t):
    return ty.infer_types(t.text_dates, strict=True)  # one value that is no date keeps the column as text


@query("infer_types_enhanced", f"""
WITH n AS (SELECT nation_text AS v FROM {DIRTY_CUSTOMER} x),
o AS (SELECT lower(opt_in_text) AS v FROM {DIRTY_CUSTOMER} x)
SELECT 'opt_in_text' AS 'column', 'string' AS original_type, 'boolean' AS new_type, NULL::VARCHAR AS format,
  (count(*) FILTER (WHERE v IN ('true','yes','1','t','y','false','no','0','f','n')) / count(*))::DOUBLE AS confidence FROM o
UNION ALL SELECT 'segment', 'string', 'category', NULL, 0.7 FROM (SELECT count(DISTINCT segment) AS u, count(*) AS n FROM {DIRTY_CUSTOMER} x)
  WHERE u < least(20, 0.05 * n)
UNION ALL SELECT 'nation_text', 'string', 'bigint', NULL, 0.9 FROM n HAVING count(*) = count(try_cast(v AS DOUBLE))""")
def _(t):
    return ty.inference_log(t.dirty_customer, ["c_custkey"])


@query("infer_types_enhanced_dates", """
SELECT 'order_date_text' AS 'column', 'string' AS original_type, 'timestamp' AS new_type, 'yyyy-MM-dd' AS format, 0.85::DOUBLE AS confidence
FROM (SELECT order_date_text AS v FROM """ + TEXT_DATES + """ x)
HAVING count(*) = count(try_strptime(v, '%Y-%m-%d'))""")
def _(t):
    return ty.inference_log(t.text_dates, ["o_orderkey"])


# --- encoding and scaling --------------------------------------------------------------------

@query("one_hot", """
SELECT o_orderkey, (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O",
  (o_orderstatus = 'P')::INT AS "o_orderstatus_P" FROM orders""")
def _(t):
    return f.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", keep=False)


@query("label_encode", f"""
WITH l AS (SELECT coalesce(l_linestatus, 'MISSING_VALUE') AS v, l_orderkey, l_linenumber, dup FROM {LINE} x)
SELECT l_orderkey, l_linenumber, dup, (dense_rank() OVER (ORDER BY v) - 1)::INT AS l_linestatus_encoded FROM l""")
def _(t):
    return f.label_encode(t.dirty_lineitem, "l_linestatus").select(*KEYS, "l_linestatus_encoded")


@query("ordinal_encode", f"""
SELECT l_orderkey, l_linenumber, dup, CASE WHEN l_linestatus IS NULL THEN -1 WHEN l_linestatus = 'O' THEN 0 WHEN l_linestatus = 'F' THEN 1 END AS
  l_linestatus_ordinal FROM {LINE} v""")
def _(t):
    return f.ordinal_encode(t.dirty_lineitem, "l_linestatus", ["O", "F"]).select(*KEYS, "l_linestatus_ordinal")


@query("auto_encode", """
SELECT c_custkey, c_name, (c_mktsegment = 'AUTOMOBILE')::INT AS "c_mktsegment_AUTOMOBILE", (c_mktsegment = 'BUILDING')::INT AS "c_mktsegment_BUILDING",
 (c_mktsegment = 'FURNITURE')::INT AS "c_mktsegment_FURNITURE", (c_mktsegment = 'HOUSEHOLD')::INT AS "c_mktsegment_HOUSEHOLD",
 (c_mktsegment = 'MACHINERY')::INT AS "c_mktsegment_MACHINERY" FROM customer""")
def _(t):
    return f.auto_encode(t.customer.select("c_custkey", "c_name", "c_mktsegment"))


@query("minmax_scale", f"""
SELECT l_orderkey, l_linenumber, dup, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity_minmax
FROM {LINE} v""", "l_quantity_minmax")
def _(t):
    return f.minmax_scale(t.dirty_lineitem, ["l_quantity"]).select(*KEYS, "l_quantity_minmax")


@query("standard_scale", f"""
SELECT l_orderkey, l_linenumber, dup, (l_quantity - m) / s AS l_quantity_std, (l_quantity - m) / sp AS pop FROM {LINE} v,
 (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, stddev_pop(l_quantity) AS sp FROM {LINE} w) z""", "l_quantity_std pop")
def _(t):
    sample = f.standard_scale(t.dirty_lineitem, ["l_quantity"]).withColumn("pop", F.lit(None))
    both = f.standard_scale(sample.withColumnRenamed("l_quantity_std", "s").drop("pop"), ["l_quantity"], population=True)
    return both.select(*KEYS, F.col("s").alias("l_quantity_std"), F.col("l_quantity_std").alias("pop"))


@query("robust_scale", f"""
SELECT l_orderkey, l_linenumber, dup, (l_extendedprice - med) / (q3 - q1) AS l_extendedprice_robust FROM {LINE} v,
 (SELECT median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM {LINE} w) z""",
       "l_extendedprice_robust")
def _(t):
    return f.robust_scale(t.dirty_lineitem, ["l_extendedprice"]).select(*KEYS, "l_extendedprice_robust")


# --- transforms ------------------------------------------------------------------------------

@query("log_transform", """
SELECT c_custkey, ln(c_acctbal + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END) AS c_acctbal_log
FROM customer, (SELECT min(c_acctbal) AS lo FROM customer) m""", "c_acctbal_log")
def _(t):
    return f.log_transform(t.customer, "c_acctbal").select("c_custkey", "c_acctbal_log")


@query("sqrt_transform", """
SELECT c_custkey, sqrt(c_acctbal + CASE WHEN lo < 0 THEN abs(lo) ELSE 0 END) AS shifted, sign(c_acctbal) * sqrt(abs(c_acctbal)) AS signed
FROM customer, (SELECT min(c_acctbal) AS lo FROM customer) m""", "shifted signed")
def _(t):
    shifted = f.sqrt_transform(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").withColumnRenamed("c_acctbal_sqrt", "shifted")
    return f.sqrt_transform(shifted, "c_acctbal", signed=True).select("c_custkey", "shifted", F.col("c_acctbal_sqrt").alias("signed"))


@query("boxcox_transform")
def _(t):
    return f.boxcox_transform(t.events.select("event_id", "value"), "value")


@query("boxcox_fixed_lambda", "SELECT event_id, (pow(value, 0.25) - 1) / 0.25 AS value_boxcox FROM events", "value_boxcox")
def _(t):
    return f.boxcox_transform(t.events.select("event_id", "value"), "value", lam=0.25).select("event_id", "value_boxcox")


# --- bins ------------------------------------------------------------------------------------

@query("bin_equal_width", """
SELECT event_id, 'Bin ' || least(5, greatest(1, ceil((value - lo) / ((hi - lo) / 5))::INT)) AS value_binned
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) s""")
def _(t):
    return f.bin_equal_width(t.events, "value", 5).select("event_id", "value_binned")


@query("bin_equal_freq", """
WITH e AS (SELECT quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, 'Bin ' || greatest(1, len(list_filter(list_distinct(e), lambda x: x < l_quantity))) AS l_quantity_binned
FROM lineitem, e""")
def _(t):
    return f.bin_equal_freq(t.lineitem, "l_quantity", 5).select("l_orderkey", "l_linenumber", "l_quantity_binned")


CUSTOM = ([0, 10, 100, 500], ["low", "mid", "high"])


@query("bin_custom", """
SELECT event_id, CASE WHEN value >= 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 100 THEN 'mid'
  WHEN value > 100 AND value <= 500 THEN 'high' END AS value_binned FROM events""")
def _(t):
    return f.bin_custom(t.events, "value", *CUSTOM).select("event_id", "value_binned")


@query("bin_counts", """
SELECT CASE WHEN value <= 10 THEN 'low' WHEN value <= 100 THEN 'mid' ELSE 'high' END AS value_binned, count(*) AS n
FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1""")
def _(t):
    return f.bin_counts(f.bin_custom(t.events, "value", *CUSTOM), "value")


@query("date_features", """
SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS o_orderdate_weekday, month(o_orderdate)::INT AS o_orderdate_month,
  year(o_orderdate)::INT AS o_orderdate_year, quarter(o_orderdate)::INT AS o_orderdate_quarter, isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend,
  (o_orderdate::DATE - DATE '1995-01-01')::BIGINT AS o_orderdate_days_since FROM orders""")
def _(t):
    return f.date_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1995-01-01").drop("o_orderdate")
