"""Filters, computed columns, sorting, top-k, joins, grouping, pivots and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions.moments import percent
from prismal.plans.quantiles import quantile_name, summarize
from prismal.plans.scalars import attach_row
from prismal.plans.sizing import may_broadcast

# --- filters ---------------------------------------------------------------------------------


def numeric_predicate(column: str, operator: str, value) -> Column:
    c = F.col(column)
    if operator == "between":
        return c.between(value[0], value[1])
    return {"equals": c == value, "not_equals": ~c.eqNullSafe(value), "greater": c > value, "less": c < value}[operator]


def category_predicate(column: str, operator: str, value) -> Column:
    """``not_equals`` keeps missing rows; ``contains`` takes a regular expression."""
    c = F.col(column)
    if operator == "in":
        return c.isin(list(value))
    if operator == "contains":
        return c.rlike(value)
    return {"equals": c == value, "not_equals": ~c.eqNullSafe(value)}[operator]


def datetime_predicate(column: str, operator: str, value) -> Column:
    """``equals`` compares calendar dates; text arguments are read as timestamps without zone."""
    c = F.col(column)
    when = lambda v: F.lit(v).cast("timestamp_ntz")
    if operator == "between":
        return c.between(when(value[0]), when(value[1]))
    if operator == "equals":
        return F.to_date(c) == F.to_date(when(value))
    return {"before": c < when(value), "after": c > when(value)}[operator]


def text_predicate(column: str, pattern: str) -> Column:
    return F.col(column).rlike("(?i)" + pattern)


def _all_tests(df: DataFrame, filters: Mapping[str, Mapping]) -> Column:
    """Whether a row passes every filter; unknown columns are skipped."""
    kinds = {"numeric": numeric_predicate, "categorical": category_predicate, "datetime": datetime_predicate,
             "text": lambda c, _op, v: text_predicate(c, v)}
    tests = [kinds[spec["type"]](c, spec.get("operator", "equals"), spec["value"])
             for c, spec in filters.items() if c in df.columns]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_multi(df: DataFrame, filters: Mapping[str, Mapping]) -> DataFrame:
    """Keep rows that pass every ``{column: {type, operator, value}}``; unknown columns are skipped."""
    return df.where(_all_tests(df, filters))


def retained(df: DataFrame, filters: Mapping[str, Mapping]) -> DataFrame:
    """Rows before and after a filter and the kept share, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(_all_tests(df, filters)).alias("rows_after"))
    return row.withColumn("retained_pct", percent(F.col("rows_after"), F.col("rows_before")))


# --- projections -----------------------------------------------------------------------------


def computed_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A column from a SQL expression over the other columns."""
    return df.withColumn(name, F.expr(expression))


def select_like(df: DataFrame, part: str) -> DataFrame:
    """Columns whose name holds ``part``, ignoring case."""
    return df.select(*[c for c in df.columns if part.lower() in c.lower()])


# --- order and top-k -------------------------------------------------------------------------


def sort_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Missing values last in both directions."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)


def n_extreme(df: DataFrame, column: str, n: int, largest: bool, ties: Sequence[str]) -> DataFrame:
    """The n largest or smallest non-missing values, ties resolved by the given key."""
    c = F.col(column)
    return df.where(c.isNotNull()).orderBy(c.desc() if largest else c.asc(), *ties).limit(n)


def top_groups(df: DataFrame, by: str, value: str, how: str, n: int, largest: bool = True) -> DataFrame:
    grouped = group_agg(df, [by], [value], [how])
    measure = f"{value}_{how}"
    c = F.col(measure)
    return grouped.orderBy(c.desc() if largest else c.asc(), by).limit(n)


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with counts (k bounds the rows)."""
    return value_counts_of(df, column).orderBy(F.col("n").desc(), F.col(column)).limit(k)


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows of the k most frequent categories."""
    return df.join(F.broadcast(most_frequent(df, column, k).select(column)), column, "left_semi")


# --- joins -----------------------------------------------------------------------------------


def lookup(df: DataFrame, column: str, mapping: Mapping, out: str) -> DataFrame:
    """Map codes through a literal dictionary; unknown codes become missing."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(column)))


def lookup_join(df: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join to a lookup table, broadcast only while its estimated size allows it."""
    return df.join(F.broadcast(table) if may_broadcast(table) else table, on, how)


def semi_join(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    return df.join(members, on, "left_semi")


def share_ratio(df: DataFrame, column: str, subset: Column) -> DataFrame:
    """Category shares over all rows and over a subset, their ratio and an over-representation flag."""
    both = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(subset).alias("n_subset"))
    totals = both.agg(F.sum("n_all").alias("_all"), F.sum("n_subset").alias("_sub"))
    shares = attach_row(both, totals).where(F.col("n_subset") > 0)
    return shares.select(
        column, percent(F.col("n_all"), F.col("_all")).alias("overall_pct"),
        percent(F.col("n_subset"), F.col("_sub")).alias("subset_pct"),
    ).withColumn("ratio", F.try_divide("subset_pct", "overall_pct")).withColumn("over_represented", F.col("ratio") > 2)


# --- grouping --------------------------------------------------------------------------------

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "min": F.min, "max": F.max,
    "count": F.count, "std": F.stddev_samp,
}


def _known(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")


def group_agg(df: DataFrame, by: Sequence[str], values: Sequence[str], how: Sequence[str]) -> DataFrame:
    """Aggregate values by groups into ``<value>_<how>``; rows with a missing key are left out."""
    _known(df, [*by, *values])
    unknown = set(how) - set(AGGREGATES) - {"median"}
    if unknown:
        raise ValueError(f"unknown aggregates: {sorted(unknown)}")
    rows = df.dropna(subset=list(by))
    plain = [AGGREGATES[h](v).alias(f"{v}_{h}") for v in values for h in how if h != "median"]
    if "median" not in how:
        return rows.groupBy(*by).agg(*plain)
    out = summarize(rows, plain, values, [0.5], by)
    return out.select(*by, *[
        F.col(quantile_name(v))[0].alias(f"{v}_{h}") if h == "median" else F.col(f"{v}_{h}") for v in values for h in how])


def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, median, std, min, max, q1 and q3 of a value by group."""
    _known(df, [by, value])
    rows = df.dropna(subset=[by])
    moments = [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
               F.min(value).alias("min"), F.max(value).alias("max")]
    q = F.col(quantile_name(value))
    return summarize(rows, moments, [value], [0.25, 0.5, 0.75], [by]).select(
        by, "count", "mean", q[1].alias("median"), "std", "min", "max", q[0].alias("q1"), q[2].alias("q3"))


def scalar_stat(df: DataFrame, column: str, how: Sequence[str]) -> DataFrame:
    """One row of statistics of a column."""
    plain = [AGGREGATES[h](column).alias(h) for h in how if h != "median"]
    if "median" not in how:
        return df.agg(*plain)
    return summarize(df, plain, [column], [0.5]).select(
        *[F.col(quantile_name(column))[0].alias(h) if h == "median" else F.col(h) for h in how])


def group_extremes(df: DataFrame, by: str, value: str, how: str = "mean") -> DataFrame:
    """Highest and lowest group of an aggregate, with absolute and relative difference."""
    measure = f"{value}_{how}"
    grouped = group_agg(df, [by], [value], [how]).where(F.col(measure).isNotNull())
    best = F.max(F.struct(F.col(measure).alias("v"), F.col(by).alias("g")))
    worst = F.min(F.struct(F.col(measure).alias("v"), F.col(by).alias("g")))
    row = grouped.agg(best.alias("hi"), worst.alias("lo"), F.count(F.lit(1)).alias("n_groups"))
    gap = F.col("hi.v") - F.col("lo.v")
    return row.select(
        F.col("hi.g").alias("highest_group"), F.col("hi.v").alias("highest"), F.col("lo.g").alias("lowest_group"),
        F.col("lo.v").alias("lowest"), gap.alias("difference"),
        F.try_divide(gap * 100, F.col("lo.v")).alias("difference_pct"), "n_groups")


def compare_categories(df: DataFrame, by: str, value: str) -> DataFrame:
    return group_agg(df, [by], [value], ["mean", "median", "std", "count"])


def compare_selected(df: DataFrame, by: str, value: str, chosen: Sequence[str]) -> DataFrame:
    return group_agg(df.where(F.col(by).isin(list(chosen))), [by], [value],
                     ["count", "mean", "median", "std", "min", "max"])


def value_counts_of(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, missing values left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_counts_pct(df: DataFrame, column: str) -> DataFrame:
    counts = value_counts_of(df, column)
    total = df.agg(F.count(column).alias("_total"))
    return attach_row(counts, total).select(column, "n", percent(F.col("n"), F.col("_total")).alias("pct"))


def distinct_count(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


# --- pivots ----------------------------------------------------------------------------------


def pivot_long(df: DataFrame, index: str, columns: str, value: str, how: str) -> DataFrame:
    """Pivot table in long form: index, column value, aggregate."""
    return group_agg(df, [index, columns], [value], [how]).withColumnRenamed(f"{value}_{how}", "value")


def pivot_table(df: DataFrame, index: str, columns: str, value: str, how: str, labels: Sequence) -> DataFrame:
    """Wide pivot table over given labels, empty cells 0. Two steps: aggregate, then turn."""
    long = pivot_long(df, index, columns, value, how)
    return long.groupBy(index).pivot(columns, list(labels)).agg(F.first("value")).fillna(0)


def pivot_totals(df: DataFrame, index: str, columns: str, value: str, k: int | None = None) -> DataFrame:
    """Row totals and column totals of a sum pivot, largest first; with k the largest k of each."""
    long = pivot_long(df, index, columns, value, "sum")
    sides = [
        long.groupBy(F.lit(side).alias("side"), F.col(c).cast("string").alias("label"))
        .agg(F.sum("value").alias("total")).orderBy(F.col("total").desc(), "label")
        for side, c in (("row", index), ("column", columns))
    ]
    sides = sides if k is None else [s.limit(k) for s in sides]
    return sides[0].unionByName(sides[1])


def crosstab(df: DataFrame, a: str, b: str, labels: Sequence) -> DataFrame:
    """Contingency counts over given labels of ``b``, empty cells 0."""
    counts = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(a).pivot(b, list(labels)).agg(F.first("n")).fillna(0)


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts of the label pairs that occur."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "variable", "value")


# --- histograms ------------------------------------------------------------------------------


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins, left-closed with the last bin closed on both sides."""
    width = (high - low) / bins
    return F.when(width > 0, F.least(F.lit(bins), F.floor((value - low) / width).cast("int") + 1)).when(
        value.isNotNull(), F.lit(1))


def histogram(df: DataFrame, column: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin over the whole range, empty bins included."""
    keys = list(keys)
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
    span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    counted = (attach_row(rows, span)
               .groupBy(*keys, bin_number(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    steps = F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    if keys:
        grid = attach_row(counted.select(*keys).distinct(), span).select("*", steps)
    else:
        grid = span.select("*", steps)
    width = (F.col("high") - F.col("low")) / bins
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("low") + (F.col("bin") - 1) * width).alias("left"),
        (F.col("low") + F.col("bin") * width).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))
