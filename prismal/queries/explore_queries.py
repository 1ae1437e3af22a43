"""Filters, projections, ordering, joins, grouping and pivots over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismal.functions import dates, text
from prismal.operators import explore as x
from prismal.plans.scalars import attach_row, union_all
from prismal.queries.registry import DIRTY_CUSTOMER, DIRTY_LINEITEM, TEXT_DATES, query

FIVE_KEYS = ["l_orderkey", "l_linenumber"]


# --- filters ---------------------------------------------------------------------------------

@query("filter_numeric", """
SELECT 'equals' AS op, count(*) AS n FROM lineitem WHERE l_quantity = 10
UNION ALL SELECT 'not_equals', count(*) FROM lineitem WHERE l_quantity IS DISTINCT FROM 10
UNION ALL SELECT 'greater', count(*) FROM lineitem WHERE l_quantity > 40
UNION ALL SELECT 'less', count(*) FROM lineitem WHERE l_quantity < 5
UNION ALL SELECT 'between', count(*) FROM lineitem WHERE l_quantity BETWEEN 10 AND 20""")
def _(t):
    cases = [("equals", 10), ("not_equals", 10), ("greater", 40), ("less", 5), ("between", (10, 20))]
    counts = t.lineitem.agg(*[
        F.count_if(x.numeric_predicate("l_quantity", op, v)).alias(op) for op, v in cases])
    return counts.unpivot([], [op for op, _ in cases], "op", "n")


@query("filter_numeric_rows", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 12""")
def _(t):
    return t.lineitem.where(x.numeric_predicate("l_quantity", "between", (10, 12))).select(
        *FIVE_KEYS, "l_quantity", "l_extendedprice")


@query("filter_category", f"""
SELECT c_custkey, segment FROM {DIRTY_CUSTOMER} v
WHERE segment IN ('BUILDING', 'building') OR regexp_matches(segment, '^ +AUTO')
   OR (segment IS DISTINCT FROM 'MACHINERY' AND segment = 'machinery')""")
def _(t):
    p = (x.category_predicate("segment", "in", ["BUILDING", "building"])
         | x.category_predicate("segment", "contains", "^ +AUTO")
         | (x.category_predicate("segment", "not_equals", "MACHINERY") & x.category_predicate("segment", "equals", "machinery")))
    return t.dirty_customer.where(p).select("c_custkey", "segment")


@query("filter_category_missing", f"""
SELECT l_linestatus, count(*) AS n FROM {DIRTY_LINEITEM} v WHERE l_linestatus IS DISTINCT FROM 'O' GROUP BY 1""")
def _(t):
    return (t.dirty_lineitem.where(x.category_predicate("l_linestatus", "not_equals", "O"))
            .groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n")))


@query("filter_datetime", """
SELECT 'before' AS op, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'after', count(*) FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-30'
UNION ALL SELECT 'between', count(*) FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
UNION ALL SELECT 'equals', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-05-05'""")
def _(t):
    cases = [("before", "1996-01-01"), ("after", "2000-06-30"), ("between", ("1997-01-01", "1997-12-31")),
             ("equals", "1998-05-05")]
    counts = t.orders.agg(*[F.count_if(x.datetime_predicate("o_orderdate", op, v)).alias(op) for op, v in cases])
    return counts.unpivot([], [op for op, _ in cases], "op", "n")


@query("filter_text", """
SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, 'licen[cs]e|password', 'i')""")
def _(t):
    return t.documents.where(x.text_predicate("text", "licen[cs]e|password")).select("doc_id", "lang", "n_chars")


FILTERS = {
    "l_quantity": {"type": "numeric", "operator": "greater", "value": 20},
    "l_returnflag": {"type": "categorical", "operator": "in", "value": ["A", "R"]},
    "l_shipdate": {"type": "datetime", "operator": "before", "value": "1998-01-01"},
    "not_a_column": {"type": "numeric", "operator": "greater", "value": 0},
}
FILTERS_SQL = "l_quantity > 20 AND l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1998-01-01'"


@query("filter_multi", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {FILTERS_SQL}")
def _(t):
    return x.filter_multi(t.lineitem, FILTERS).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_retained", f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE {FILTERS_SQL}) AS rows_after,
       100.0 * count(*) FILTER (WHERE {FILTERS_SQL}) / count(*) AS retained_pct FROM lineitem""", "retained_pct")
def _(t):
    return x.retained(t.lineitem, FILTERS)


# --- projections and scalar functions --------------------------------------------------------

@query("computed_column", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem
WHERE l_extendedprice * (1 - l_discount) * (1 + l_tax) > 90000""", "charge", 6)
def _(t):
    return (x.computed_column(t.lineitem, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
            .where("charge > 90000").select(*FIVE_KEYS, "charge"))


@query("select_columns", "SELECT l_extendedprice, l_shipdate::DATE AS l_shipdate FROM lineitem")
def _(t):
    d = x.select_like(t.lineitem, "PRICE").columns + x.select_like(t.lineitem, "ShipDate").columns
    return t.lineitem.select(*d).withColumn("l_shipdate", F.to_date("l_shipdate"))


@query("str_case", f"""
SELECT c_custkey, lower(segment) AS low, upper(segment) AS up,
       concat(regexp_extract(segment, '^\\s*'), upper(substr(trim(segment), 1, 1)), lower(substr(trim(segment), 2)),
              regexp_extract(segment, '\\s*$')) AS titled
FROM {DIRTY_CUSTOMER} v""")
def _(t):
    return t.dirty_customer.select("c_custkey", text.lower("segment").alias("low"), text.upper("segment").alias("up"),
                                   text.title("segment").alias("titled"))


@query("str_strip", f"SELECT c_custkey, trim(segment) AS stripped FROM {DIRTY_CUSTOMER} v")
def _(t):
    return t.dirty_customer.select("c_custkey", text.strip("segment").alias("stripped"))


@query("str_remove_special", f"""
SELECT c_custkey, regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g') AS plain FROM {DIRTY_CUSTOMER} v""")
def _(t):
    return t.dirty_customer.select("c_custkey", text.remove_special("name").alias("plain"))


@query("str_length", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", text.length("text").cast("long").alias("n"))


@query("date_parts", """
SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour,
       (isodow(ts) - 1)::INT AS weekday, dayofyear(ts)::INT AS day_of_year, week(ts)::INT AS week,
       quarter(ts)::INT AS quarter FROM events""")
def _(t):
    return t.events.select("event_id", *[fn(F.col("ts")).alias(name) for name, fn in dates.PARTS.items()])


@query("math_scalars", """
SELECT c_custkey, abs(c_acctbal) AS absolute, ln(abs(c_acctbal) + 1) AS logged, sqrt(abs(c_acctbal)) AS root,
       sign(c_acctbal)::DOUBLE AS sgn, greatest(0.0, least(5000.0, c_acctbal)) AS clipped,
       exp(c_acctbal / 10000) AS grown, round(c_acctbal, 0) AS whole FROM customer""",
       "absolute logged root clipped grown whole")
def _(t):
    c = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.abs(c).alias("absolute"), F.log(F.abs(c) + 1).alias("logged"), F.sqrt(F.abs(c)).alias("root"),
        F.signum(c).alias("sgn"), text.clip(c, F.lit(0.0), F.lit(5000.0)).alias("clipped"),
        F.exp(c / 10000).alias("grown"), F.round(c, 0).alias("whole"))


@query("case_bands", """
SELECT CASE WHEN l_discount >= 0.08 THEN 'very strong' WHEN l_discount >= 0.06 THEN 'strong'
            WHEN l_discount >= 0.04 THEN 'moderate' WHEN l_discount >= 0.02 THEN 'weak' ELSE 'very weak' END AS band,
       count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    steps = [(0.08, "very strong"), (0.06, "strong"), (0.04, "moderate"), (0.02, "weak")]
    return (t.lineitem.groupBy(text.bands(F.col("l_discount"), steps, "very weak").alias("band"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- order and top-k -------------------------------------------------------------------------

@query("sort_by", f"""
SELECT l_orderkey, l_linenumber, dup, l_quantity FROM {DIRTY_LINEITEM} v ORDER BY l_quantity DESC NULLS LAST""")
def _(t):
    return x.sort_by(t.dirty_lineitem.select("l_orderkey", "l_linenumber", "dup", "l_quantity"), "l_quantity", False)


@query("head_tail", """
(SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10)
UNION ALL (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10)""")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    return union_all([
        x.head(o, 10, ["o_orderkey"]).select(F.lit("head").alias("part"), "*"),
        x.tail(o, 10, ["o_orderkey"]).select(F.lit("tail").alias("part"), "*")])


@query("nlargest_nsmallest", """
(SELECT 'largest' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL (SELECT 'smallest', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)""")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    return union_all([x.n_extreme(c, "c_acctbal", 5, side == "largest", ["c_custkey"])
                      .select(F.lit(side).alias("side"), "*") for side in ("largest", "smallest")])


@query("top_n_groups", """
SELECT o_custkey, sum(o_totalprice) AS o_totalprice_sum FROM orders GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""", "o_totalprice_sum", 2)
def _(t):
    return x.top_groups(t.orders, "o_custkey", "o_totalprice", "sum", 10)


@query("top_categories_filter", """
SELECT source, lang, count(*) AS n FROM documents WHERE source IN
 (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) GROUP BY 1, 2""")
def _(t):
    return (x.top_categories(t.documents, "source", 5).groupBy("source", "lang")
            .agg(F.count(F.lit(1)).alias("n")))


# --- joins -----------------------------------------------------------------------------------

@query("join_inner_equi", """
SELECT l_orderkey, l_linenumber, o_orderpriority, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    return (t.lineitem.select(*FIVE_KEYS, "l_quantity")
            .join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
            .select("l_orderkey", "l_linenumber", "o_orderpriority", "l_quantity"))


@query("semi_join_isin", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN
 (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def _(t):
    big = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return x.semi_join(t.customer.select("c_custkey", "c_mktsegment"), big, "c_custkey")


@query("map_lookup_join", """
SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS code, count(*) AS n
FROM orders GROUP BY 1, 2""")
def _(t):
    return (x.lookup(t.orders, "o_orderstatus", {"F": 1, "O": 0}, "code").groupBy("o_orderstatus", "code")
            .agg(F.count(F.lit(1)).alias("n")))


@query("lookup_join_nation", """
SELECT n_name, r_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def _(t):
    nations = x.lookup_join(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    named = x.lookup_join(t.customer, nations.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return named.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("broadcast_scalar_join", """
SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS deviation FROM orders""", "deviation", 4)
def _(t):
    mean = t.orders.agg(F.avg("o_totalprice").alias("_mean"))
    return attach_row(t.orders, mean).select("o_orderkey", (F.col("o_totalprice") - F.col("_mean")).alias("deviation"))


@query("distribution_ratio_join", """
WITH a AS (SELECT o_orderpriority, count(*) AS n_all, count(*) FILTER (WHERE o_totalprice > 250000) AS n_sub
           FROM orders GROUP BY 1),
     s AS (SELECT o_orderpriority, 100.0 * n_all / sum(n_all) OVER () AS overall_pct,
                  100.0 * n_sub / sum(n_sub) OVER () AS subset_pct, n_sub FROM a)
SELECT o_orderpriority, overall_pct, subset_pct, subset_pct / overall_pct AS ratio,
       subset_pct / overall_pct > 2 AS over_represented FROM s WHERE n_sub > 0""", "overall_pct subset_pct ratio")
def _(t):
    return x.share_ratio(t.orders, "o_orderpriority", F.col("o_totalprice") > 250000)


@query("union_append", """
SELECT 'customer' AS dataset, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def _(t):
    return union_all([
        t.customer.select(F.lit("customer").alias("dataset"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.lit("supplier").alias("dataset"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))])


# --- grouping --------------------------------------------------------------------------------

@query("group_agg", f"""
SELECT l_returnflag, l_linestatus, coalesce(sum(l_quantity), 0) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean,
       median(l_quantity) AS l_quantity_median, count(l_quantity) AS l_quantity_count,
       coalesce(sum(l_extendedprice), 0) AS l_extendedprice_sum, avg(l_extendedprice) AS l_extendedprice_mean,
       median(l_extendedprice) AS l_extendedprice_median, count(l_extendedprice) AS l_extendedprice_count
FROM {DIRTY_LINEITEM} v WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""",
       "l_quantity_sum l_quantity_mean l_quantity_median l_extendedprice_sum l_extendedprice_mean l_extendedprice_median", 2)
def _(t):
    return x.group_agg(t.dirty_lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"],
                       ["sum", "mean", "median", "count"])


@query("group_summary", """
SELECT l_returnflag, count(l_quantity) AS count, avg(l_quantity) AS mean, median(l_quantity) AS median,
       stddev_samp(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max,
       quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3
FROM lineitem GROUP BY 1""", "mean median std q1 q3")
def _(t):
    return x.group_summary(t.lineitem, "l_returnflag", "l_quantity")


@query("scalar_stat", f"""
SELECT avg(l_quantity) AS mean, sum(l_quantity) AS sum, count(l_quantity) AS count, max(l_quantity) AS max,
       min(l_quantity) AS min, median(l_quantity) AS median, stddev_samp(l_quantity) AS std
FROM {DIRTY_LINEITEM} v""", "mean sum median std", 4)
def _(t):
    return x.scalar_stat(t.dirty_lineitem, "l_quantity", ["mean", "sum", "count", "max", "min", "median", "std"])


@query("group_agg_sorted", """
WITH g AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT (SELECT g FROM g ORDER BY v DESC, g DESC LIMIT 1) AS highest_group, max(v) AS highest,
       (SELECT g FROM g ORDER BY v, g LIMIT 1) AS lowest_group, min(v) AS lowest, max(v) - min(v) AS difference,
       100 * (max(v) - min(v)) / min(v) AS difference_pct, count(*) AS n_groups FROM g""",
       "highest lowest difference difference_pct")
def _(t):
    return x.group_extremes(t.customer, "c_mktsegment", "c_acctbal")


@query("compare_categories", """
SELECT event_type, avg(value) AS value_mean, median(value) AS value_median, stddev_samp(value) AS value_std,
       count(value) AS value_count FROM events GROUP BY 1""", "value_mean value_median value_std")
def _(t):
    return x.compare_categories(t.events, "event_type", "value")


@query("distribution_compare", """
SELECT o_orderpriority, count(o_totalprice) AS o_totalprice_count, avg(o_totalprice) AS o_totalprice_mean,
       median(o_totalprice) AS o_totalprice_median, stddev_samp(o_totalprice) AS o_totalprice_std,
       min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1""",
       "o_totalprice_mean o_totalprice_median o_totalprice_std o_totalprice_min o_totalprice_max", 4)
def _(t):
    return x.compare_selected(t.orders, "o_orderpriority", "o_totalprice", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("value_counts", f"""
SELECT l_linestatus, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct
FROM {DIRTY_LINEITEM} v WHERE l_linestatus IS NOT NULL GROUP BY 1""", "pct")
def _(t):
    return x.value_counts_pct(t.dirty_lineitem, "l_linestatus")


@query("distinct_count", f"""
SELECT count(DISTINCT l_quantity) AS l_quantity, count(DISTINCT l_linestatus) AS l_linestatus,
       count(DISTINCT l_orderkey) AS l_orderkey FROM {DIRTY_LINEITEM} v""")
def _(t):
    return x.distinct_count(t.dirty_lineitem, ["l_quantity", "l_linestatus", "l_orderkey"])


@query("pivot_table", """
SELECT o_orderpriority, coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F",
       coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O",
       coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY 1""", "F O P", 4)
def _(t):
    return x.pivot_table(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "mean", ["F", "O", "P"])


@query("pivot_median", """
SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2""", "value", 4)
def _(t):
    return x.pivot_long(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice", "median")


@query("pivot_totals", """
(SELECT 'row' AS side, p_brand AS label, sum(p_retailprice) AS total FROM part GROUP BY 2)
UNION ALL
(SELECT 'column', p_type, sum(p_retailprice) FROM part GROUP BY 2)""", "total", 2)
def _(t):
    return x.pivot_totals(t.part, "p_brand", "p_type", "p_retailprice")


WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query("crosstab", """
SELECT event_type, """ + ", ".join(f"count(*) FILTER (WHERE weekday = '{d}') AS \"{d}\"" for d in WEEKDAYS) + """
FROM (SELECT event_type, dayname(ts) AS weekday FROM events) e GROUP BY 1""")
def _(t):
    tagged = t.events.withColumn("weekday", dates.weekday_name("ts"))
    return x.crosstab(tagged, "event_type", "weekday", WEEKDAYS)


@query("melt", """
SELECT s_suppkey, 's_nationkey' AS variable, s_nationkey::DOUBLE AS value FROM supplier
UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier""")
def _(t):
    s = t.supplier.withColumn("s_nationkey", F.col("s_nationkey").cast("double"))
    return x.melt(s, ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
     b AS (SELECT least(30, floor((l_extendedprice - lo) / ((hi - lo) / 30))::INT + 1) AS bin FROM lineitem, s)
SELECT i::INT AS bin, lo + (i - 1) * (hi - lo) / 30 AS left, lo + i * (hi - lo) / 30 AS right,
       count(b.bin) AS n FROM range(1, 31) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i GROUP BY i, lo, hi""",
       '"left" "right"', 4)
def _(t):
    return x.histogram(t.lineitem, "l_extendedprice", 30)
