"""Profiles: one row per column (or per column and item), from a few fused aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions import dates, text
from prismal.functions.moments import percent, sample_kurtosis, sample_skew
from prismal.operators.explore import histogram
from prismal.plans.counts import value_counts
from prismal.plans.quantiles import quantile_name, quantiles
from prismal.plans.scalars import attach_row, rows_from_row, union_all
from prismal.plans.sizing import fits_value_map
from prismal.session import materialize
from prismal.sources.tables import roles

# Text forms read as dates (fixed values).
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy",
                "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]
# Patterns that mark a column as date-like, matched at the start of the text (fixed values).
DATE_PATTERNS = [r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{1,2}-\d{1,2}-\d{2,4}",
                 r"\d{1,2}\s+[A-Za-z]{3,}\s+\d{2,4}"]
# Words in a column name that hint at a model target (fixed values).
TARGET_WORDS = ["target", "class", "label", "outcome", "result", "status", "response", "dependent", "output",
                "category", "diagnos", "risk", "fraud", "default", "churn", "conversion", "click", "purchase",
                "revenue", "sales", "income", "profit", "rating", "score", "satisfaction", "sentiment"]
ID_NAMES = ["id", "user_id", "customer_id"]
PROFILE_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def parsed_date(c: Column | str, formats: Sequence[str] = tuple(DATE_FORMATS)) -> Column:
    """First timestamp any of the formats reads from the text, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


# --- whole table -----------------------------------------------------------------------------


def table_info(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows and column roles in one row.

    Equal rows collapse once (with a map-side combine); everything else is a sum over the groups.
    """
    by_role = roles(df)
    cells = len(df.columns)
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.select("_n", (missing * F.col("_n")).alias("_m")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(
        "n_rows", F.lit(cells).alias("n_cols"), "missing_cells",
        percent(F.col("missing_cells"), F.col("n_rows") * cells).alias("missing_pct"), "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("n_rows")).alias("duplicate_pct"),
        *[F.lit(len(by_role[r])).alias(f"{r}_cols") for r in ("numeric", "categorical", "datetime")])


def missing_profile(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """Missing count and percentage per column, largest first; complete columns left out."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = rows_from_row(counts, [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing"),
                 percent(F.col(f"`{c}`"), F.col("_rows")).alias("missing_pct")) for c in df.columns])
    kept = rows if all_columns else rows.where("missing > 0")
    return kept.orderBy(F.col("missing").desc(), "column")


def missing_of(counts: DataFrame) -> DataFrame:
    """``missing_profile`` of the columns with missing values, from their value counts."""
    gaps = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    rows = counts.groupBy("column").agg(gaps.alias("missing"), F.sum("n").alias("_rows")).where("missing > 0")
    return rows.select("column", "missing", percent(F.col("missing"), F.col("_rows")).alias("missing_pct"))


def missing_indicator(df: DataFrame, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """1.0 where a cell is missing, for all columns or the first ``most``."""
    columns = [c for c in df.columns if c not in keys][:most]
    return df.select(*keys, *[F.col(c).isNull().cast("double").alias(c) for c in columns])


# --- numeric columns -------------------------------------------------------------------------


def counts_of(df: DataFrame, columns: Sequence[str] | None = None, kind: str = "string") -> DataFrame:
    """The one pass over distinct values that the rules about a table share: written rows of ``column``, ``value`` (as text, or of ``kind``) and ``n``."""
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if kind == "float" else F.col(f"`{c}`") for c, kind in df.dtypes])
    return materialize(value_counts(wide, list(columns or df.columns), kind=kind), "value-counts")


def _of(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return counts.where(F.col("column").isin(list(columns)))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, fence: float = 1.5, counts: DataFrame | None = None) -> DataFrame:
    """Moments, quantiles, zero and negative counts and fence outliers, one row per numeric column.

    One aggregate gives the moments. Quantiles and outliers come from ``counts`` (see ``counts_of``) where it is at hand, else from passes of their
    own; large inputs order just what a sketch brackets, see ``plans.quantiles``. Moments and fences are written as one row per column.
    """
    columns = list(columns or roles(df)["numeric"])
    slim = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    places = [f"c{i}" for i in range(len(columns))]
    moments = [F.count(F.lit(1)).alias("n_rows"), *[
        F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.var_samp(c).alias("variance"), F.min(c).alias("min"), F.max(c).alias("max"),
            sample_skew(c).alias("skew"), sample_kurtosis(c).alias("kurtosis"),
            F.count_if(F.col(c) == 0).alias("zeros"), F.count_if(F.col(c) < 0).alias("negatives")).alias(f"s_{c}")
        for c in places]]
    row = slim.agg(*moments)
    stats = rows_from_row(row, [F.struct(
        F.lit(name).alias("column"), F.col("n_rows"), F.col(f"s_{c}.count").alias("count"),
        *[F.col(f"s_{c}.{m}").alias(m) for m in ("mean", "std", "variance", "min", "max", "skew", "kurtosis", "zeros", "negatives")]) for name, c in zip(columns, places)])
    if counts is not None:
        counts = _of(counts, columns).select("column", F.col("value").try_cast("double").alias("v"), "n")
    if counts is not None and fits_value_map(slim):
        wanted = F.array(*[F.lit(p) for p in PROFILE_PROBS])
        cuts = counts.groupBy("column").agg(F.percentile("v", wanted, F.col("n")).alias("q"))
    else:
        cut = quantiles(slim, places, PROFILE_PROBS)
        cuts = rows_from_row(cut, [F.struct(F.lit(name).alias("column"), F.col(quantile_name(c)).alias("q")) for name, c in zip(columns, places)])
    q = F.col("q")
    edge = lambda sign: (q[1] if sign < 0 else q[3]) + sign * fence * (q[3] - q[1])
    rows = materialize(stats.join(F.broadcast(cuts), "column", "left").withColumn("lower", edge(-1)).withColumn("upper", edge(1)), "moments")  # one row per column
    outside = lambda v, low, high: (v < low) | (v > high)
    if counts is None:
        fences = rows.agg(*[F.max(F.when(F.col("column") == name, F.struct("lower", "upper"))).alias(f"f_{c}") for name, c in zip(columns, places)])
        found = attach_row(slim, fences).agg(*[F.count_if(outside(F.col(c), F.col(f"f_{c}.lower"), F.col(f"f_{c}.upper"))).alias(c) for c in places])
        found = rows_from_row(found, [F.struct(F.lit(name).alias("column"), F.col(c).alias("outliers")) for name, c in zip(columns, places)])
    else:
        values = counts.join(F.broadcast(rows.select("column", "lower", "upper")), "column")  # one row per column
        found = values.groupBy("column").agg(F.sum(F.when(outside(F.col("v"), F.col("lower"), F.col("upper")), F.col("n"))).alias("outliers"))
    missing = F.col("n_rows") - F.col("count")
    out = rows.join(F.broadcast(found), "column", "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)))
    return out.select(
        "column", "n_rows", "count", missing.alias("missing"), percent(missing, F.col("n_rows")).alias("missing_pct"), "mean", "std", "variance", "min",
        q[0].alias("q05"), q[1].alias("q25"), q[2].alias("median"), q[3].alias("q75"), q[4].alias("q95"), "max", "skew", "kurtosis", "zeros", "negatives",
        "lower", "upper", "outliers", percent(F.col("outliers"), F.col("n_rows")).alias("outlier_pct"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or roles(df)["numeric"])
    counts = counts_of(df, columns, "double")
    stats = numeric_profile(df, columns, counts=counts)
    held = counts.where("value IS NOT NULL").select("column", "n", F.col("value").try_cast("double").alias("v"))
    best = held.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("best"))
    return stats.join(F.broadcast(best), "column", "left").select(  # one row per column
        "column", "count", "missing", "missing_pct", "mean", "std", "variance", "min", "q25", "median", "q75", "max",
        "skew", "kurtosis", F.col("best.v").alias("mode"))


def outlier_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return numeric_profile(df, columns).select("column", "q25", "q75", "lower", "upper", "outliers", "outlier_pct")


def column_stats_numeric(df: DataFrame, column: str) -> DataFrame:
    """Long statistics of one column: moments, quantiles, counts, and the five largest and smallest values."""
    stats = numeric_profile(df, [column]).drop("column")
    stats = stats.select(*[F.col(c).cast("double").alias(c) for c in stats.columns])
    long = stats.unpivot([], stats.columns, "stat", "value")
    extremes = []
    for name, order in (("top", F.desc), ("bottom", F.asc)):
        five = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")).orderBy(order("value")).limit(5)
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order("value")))  # five rows
        extremes.append(five.select(F.concat(F.lit(f"{name}_"), place.cast("string")).alias("stat"), "value"))
    return union_all([long, *extremes])


# --- categorical columns ---------------------------------------------------------------------


def text_profile(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Counts, top value, convertibility and formatting facts, one row per text column.

    Works on distinct values with their counts, so every test runs once per distinct value.
    """
    columns = list(columns or roles(df)["categorical"])
    v, n = F.col("value"), F.col("n")
    per_value = (value_counts(df, columns) if counts is None else _of(counts, columns)).withColumn("low", F.lower("value"))

    def rows_with(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    flag = F.lower(v).isin("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")
    facts = per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"), rows_with(v.isNotNull()).alias("non_null"), F.count("value").alias("unique"),
        F.min(F.when(v.isNotNull(), F.struct((-n).alias("neg"), v.alias("value")))).alias("best"),
        rows_with(v.try_cast("double").isNotNull()).alias("numeric_rows"),
        rows_with(parsed_date(v).isNotNull()).alias("date_rows"), rows_with(flag).alias("flag_rows"),
        rows_with(v.rlike("^(" + "|".join(DATE_PATTERNS) + ")")).alias("pattern_rows"),
        rows_with(text.has_edge_space(v)).alias("space_rows"), rows_with(text.has_special(v)).alias("special_rows"),
        F.coalesce(F.max(v != F.lower(v)), F.lit(False)).alias("any_upper"),
        F.min(F.length(v)).cast("long").alias("len_min"), F.max(F.length(v)).cast("long").alias("len_max"),
        F.try_divide(F.sum(F.length(v) * n), F.sum(F.when(v.isNotNull(), n))).alias("len_mean"))
    folded = (per_value.where(v.isNotNull()).groupBy("column", "low").agg(F.lit(1).alias("_one"))
              .groupBy("column").agg(F.count("_one").alias("unique_lower")))
    return facts.join(F.broadcast(folded), "column", "left").select(  # one row per column
        "column", "n_rows", "non_null", (F.col("n_rows") - F.col("non_null")).alias("missing"),
        percent(F.col("n_rows") - F.col("non_null"), F.col("n_rows")).alias("missing_pct"), "unique",
        F.coalesce("unique_lower", F.lit(0)).alias("unique_lower"), F.col("best.value").alias("top"),
        (-F.col("best.neg")).alias("freq"), percent(-F.col("best.neg"), F.col("non_null")).alias("freq_pct"),
        "numeric_rows", "date_rows", "flag_rows", "pattern_rows", "space_rows", "special_rows", "any_upper",
        "len_min", "len_max", "len_mean")


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return text_profile(df, columns).select(
        "column", "unique", "missing", "missing_pct", "top", "freq", "freq_pct")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values with count and share of non-missing rows, then an ``Others`` row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(n)
    kept = top.agg(F.sum("n").alias("_kept"))
    others = attach_row(total, kept).select(F.lit("Others").alias("value"), (F.col("_all") - F.col("_kept")).alias("n")).where("n > 0")
    return attach_row(union_all([top, others]), total).select("value", "n", percent(F.col("n"), F.col("_all")).alias("pct"))


def column_stats_categorical(df: DataFrame, column: str) -> DataFrame:
    """Ten most frequent values, with the length range and the distinct count beside them."""
    facts = text_profile(df, [column]).select("unique", "missing", "len_min", "len_max", "len_mean", "non_null")
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(10)
    return attach_row(top, facts).select(
        "value", "n", percent(F.col("n"), F.col("non_null")).alias("pct"), "unique", "missing", "len_min", "len_max", "len_mean")


def text_length_stats(df: DataFrame, column: str) -> DataFrame:
    lengths = df.select(F.length(column).cast("double").alias("len"))
    cuts = quantiles(lengths, ["len"], [0.5])
    row = lengths.agg(F.avg("len").alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"))
    return attach_row(row, cuts).select("mean", F.col("q_len")[0].alias("median"), "min", "max")


def text_length_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    return histogram(df.select(F.length(column).alias("len")), "len", bins)


def column_sample(df: DataFrame, column: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Up to n non-missing values, chosen by a hash of the key (the same rows on every run)."""
    return (df.where(F.col(column).isNotNull()).select(*keys, column)
            .orderBy(F.md5(F.concat_ws("|", *keys, F.lit(seed))), *keys, column).limit(n))


# --- dates -----------------------------------------------------------------------------------


def date_stats(df: DataFrame, column: str) -> DataFrame:
    row = df.agg(F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last"),
                 F.date_diff(F.max(column), F.min(column)).cast("long").alias("range_days"), F.count(column).alias("count"))
    return row


def date_counts(df: DataFrame, column: str, parts: Sequence[str], top_years: int | None = None) -> DataFrame:
    """Row counts per calendar part, long form (part, key, label, n), in one aggregate."""
    stamp = F.col(column)

    def entry(part: str) -> Column:
        number = dates.PARTS[part](stamp)
        label = {"weekday": dates.weekday_name(stamp), "month": dates.month_name(stamp)}.get(part, number.cast("string"))
        return F.struct(F.lit(part).alias("part"), number.cast("int").alias("key"), label.alias("label"))

    entries = df.where(stamp.isNotNull()).select(F.inline(F.array(*[entry(p) for p in parts])))
    counts = entries.groupBy("part", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    if top_years is None:
        return counts
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "key"))  # few calendar keys
    return counts.withColumn("_place", place).where((F.col("part") != "year") | (F.col("_place") <= top_years)).drop("_place")


def date_coverage(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """Span, distinct days, staleness against ``as_of``, months and years present, gap flag."""
    days = df.where(F.col(column).isNotNull()).groupBy(F.to_date(column).alias("d")).agg(F.lit(1).alias("_one"))
    row = days.agg(
        F.date_diff(F.max("d"), F.min("d")).cast("long").alias("span_days"), F.count("d").alias("distinct_days"),
        F.date_diff(F.lit(as_of).cast("date"), F.max("d")).cast("long").alias("stale_days"),
        F.count_distinct(F.year("d"), F.month("d")).alias("months"), F.count_distinct(F.year("d")).alias("years"))
    return row.withColumn("has_gaps", F.col("distinct_days") < 0.7 * F.col("span_days"))


# --- type hints ------------------------------------------------------------------------------


def potential_datetime_columns(df: DataFrame) -> DataFrame:
    """Text columns that are dates: every value parses, or >75 % look like dates with <100 distinct."""
    facts = text_profile(df)
    kind = F.when(F.col("date_rows") == F.col("non_null"), "parsed").when(
        (F.col("unique") < 100) & (F.col("pattern_rows") > 0.75 * F.col("non_null")), "pattern")
    return facts.where(F.col("non_null") > 0).select("column", kind.alias("evidence"), "date_rows", "pattern_rows").where(
        F.col("evidence").isNotNull())


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Distinct and missing counts of any columns, one row per column."""
    columns = list(columns or df.columns)
    return (value_counts(df, columns) if counts is None else _of(counts, columns)).groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("value").try_cast("double").isin(0.0, 1.0), F.col("n"))), F.lit(0)).alias("zero_one"))


def suggest_type(df: DataFrame) -> DataFrame:
    """Suggested type per column: datetime, boolean, category, int64 / float64, or the current type."""
    by_role = roles(df)
    kinds = dict(df.dtypes)
    facts = distinct_profile(df)
    texts = by_role["categorical"]
    if texts:
        whole = value_counts(df, texts).groupBy("column").agg(F.coalesce(F.max(
            F.col("value").try_cast("double") != F.floor(F.col("value").try_cast("double"))), F.lit(False)).alias("fractional"))
        facts = facts.join(F.broadcast(text_profile(df, texts).select("column", "numeric_rows", "date_rows")), "column", "left")
        facts = facts.join(F.broadcast(whole), "column", "left")
    else:
        facts = facts.selectExpr("*", "0L AS numeric_rows", "0L AS date_rows", "false AS fractional")
    current = F.create_map(*[F.lit(p) for item in kinds.items() for p in item])[F.col("column")]
    role = F.create_map(*[F.lit(p) for r, cs in by_role.items() for c in cs for p in (c, r)])[F.col("column")]
    text_role = role == "categorical"
    enough = lambda c: text_role & (F.col(c) > 0.8 * F.col("non_null"))
    verdict = (F.when(F.col("non_null") == 0, current).when(role == "datetime", "datetime64")
               .when((F.col("zero_one") == F.col("non_null")) & ~text_role, "boolean")
               .when(text_role & (F.col("unique") <= 20), "category")
               .when(enough("date_rows"), "datetime64")
               .when(enough("numeric_rows") & F.col("fractional"), "float64")
               .when(enough("numeric_rows"), "int64").otherwise(current))
    return facts.select("column", current.alias("current_type"), verdict.alias("suggested_type"))


# --- combined profile and rules --------------------------------------------------------------


def full_profile(df: DataFrame) -> DataFrame:
    """One record per column: role, missing, distinct, moments and quartiles, text lengths, date range."""
    by_role = roles(df)
    kinds = dict(df.dtypes)
    counts = counts_of(df)
    base = distinct_profile(df, counts=counts).select("column", "n_rows", "non_null", "unique")
    numeric = numeric_profile(df, by_role["numeric"], counts=counts).select(
        "column", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis", "zeros", "outliers", "lower", "upper")
    out = base.join(F.broadcast(numeric), "column", "left")  # one row per column
    if by_role["categorical"]:
        out = out.join(F.broadcast(text_profile(df, by_role["categorical"], counts).select(
            "column", "top", "freq", "len_min", "len_max", "len_mean")), "column", "left")
    if by_role["datetime"]:
        spans = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in by_role["datetime"]])
        rows = rows_from_row(spans, [F.struct(
            F.lit(c).alias("column"), F.to_date(F.col(f"{c}.lo")).alias("first_date"), F.to_date(F.col(f"{c}.hi")).alias("last_date"))
            for c in by_role["datetime"]])
        out = out.join(F.broadcast(rows), "column", "left")
    dtype = F.create_map(*[F.lit(p) for item in kinds.items() for p in item])[F.col("column")]
    return out.select(
        "column", dtype.alias("dtype"), "n_rows", (F.col("n_rows") - F.col("non_null")).alias("missing"),
        percent(F.col("n_rows") - F.col("non_null"), F.col("n_rows")).alias("missing_pct"), "unique",
        percent(F.col("unique"), F.col("n_rows")).alias("unique_pct"),
        *[c for c in out.columns if c not in ("column", "n_rows", "non_null", "unique")])


def _explode_rules(facts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda r: r.isNotNull())
    return facts.select("column", F.explode(found).alias("insight"))


def numeric_insights(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rule hits per numeric column: skew, mean against median, outliers, zeros, distinct share."""
    columns = list(columns or roles(df)["numeric"])
    counts = counts_of(df, columns)
    facts = numeric_profile(df, columns, counts=counts).join(
        F.broadcast(distinct_profile(df, columns, counts).select("column", "unique")), "column")
    gap = F.abs(F.col("mean") - F.col("median")) * 100
    share = percent(F.col("unique"), F.col("n_rows"))
    return _explode_rules(facts, [
        ("skewed_right", F.col("skew") > 1), ("skewed_left", F.col("skew") < -1),
        ("moderate_skew", F.abs("skew").between(0.5, 1)),
        ("mean_above_median", (F.try_divide(gap, F.col("median")) > 10) & (F.col("mean") > F.col("median"))),
        ("median_above_mean", (F.try_divide(gap, F.col("median")) > 10) & (F.col("mean") < F.col("median"))),
        ("many_outliers", F.col("outlier_pct") > 10),
        ("some_outliers", (F.col("outlier_pct") > 0) & (F.col("outlier_pct") <= 10)),
        ("many_zeros", percent(F.col("zeros"), F.col("n_rows")) > 10),
        ("few_distinct", share < 1), ("mostly_distinct", share > 90),
        ("heavy_tails", F.col("kurtosis") >= 0.5), ("light_tails", F.col("kurtosis") <= -0.5)])


def categorical_insights(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rule hits per text column: dominance, cardinality, missing values, identifiers."""
    facts = text_profile(df, columns)
    low = F.col("unique") < 20
    share = percent(F.col("unique"), F.col("n_rows"))
    return _explode_rules(facts, [
        ("extreme_imbalance", low & (F.col("freq_pct") > 80)),
        ("moderate_imbalance", low & (F.col("freq_pct") > 50) & (F.col("freq_pct") <= 80)),
        ("binary", low & (F.col("unique") == 2)),
        ("low_cardinality", low & (F.col("unique") != 2) & (F.col("unique") <= 10)),
        ("higher_cardinality", low & (F.col("unique") > 10)),
        ("has_missing", low & (F.col("missing") > 0)),
        ("identifier", ~low & (share > 90)), ("mostly_missing", ~low & (F.col("missing_pct") > 20))])


def suggest_targets(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Candidate model targets with kind and likelihood; name hints first, distinct counts as fallback."""
    by_role = roles(df)
    place = {c: i for i, c in enumerate(df.columns)}
    words = {c: next((w for w in TARGET_WORDS if w in c.lower()), None) for c in df.columns}
    facts = distinct_profile(df, counts=counts).withColumn("place", F.create_map(*[F.lit(p) for i in place.items() for p in i])[F.col("column")])
    hint = F.create_map(*[F.lit(p) for i in words.items() for p in i])[F.col("column")]
    in_role = lambda r: F.col("column").isin(by_role[r]) if by_role[r] else F.lit(False)
    unique = F.col("unique")
    verdict = lambda kind, likelihood: F.struct(F.lit(kind).alias("kind"), F.lit(likelihood).alias("likelihood"))
    hit = (F.when(unique == 2, verdict("classification", "high"))
           .when((unique < 10) & in_role("categorical"), verdict("classification", "medium"))
           .when(in_role("numeric") & (unique > 10), verdict("regression", "medium")))
    named = facts.where(hint.isNotNull()).select("column", "place", hint.alias("keyword"), hit.alias("hit"))
    named = named.where("hit IS NOT NULL").select("column", "place", "keyword", "hit.kind", "hit.likelihood")
    plain_name = ~F.lower("column").isin(ID_NAMES)
    group = (F.when(unique == 2, 1).when((unique < 10) & (unique > 2) & in_role("categorical"), 2)
             .when((unique > 10) & in_role("numeric"), 3))
    order = Window.partitionBy("grp").orderBy("place")  # one row per column
    weak = (facts.where(plain_name).withColumn("grp", group).where("grp IS NOT NULL")
            .withColumn("at", F.row_number().over(order)).where("grp = 1 OR at <= 2")
            .select("column", (F.col("grp") * 10_000 + F.col("place")).alias("place"), F.lit(None).cast("string").alias("keyword"),
                    F.when(F.col("grp") == 3, "regression").otherwise("classification").alias("kind"), F.lit("low").alias("likelihood")))
    found = named.agg(F.count(F.lit(1)).alias("_named"))
    return union_all([named, attach_row(weak, found).where("_named = 0").drop("_named")])


def suggest_features(df: DataFrame) -> DataFrame:
    """Feature ideas per column: date parts, skew transforms, cardinality encodings, text, interactions.

    A later rule replaces an earlier one for the same column, as in text over cardinality.
    """
    by_role = roles(df)
    named_dates = [c for c in df.columns if c in by_role["datetime"] or "date" in c.lower() or "time" in c.lower()]
    parts = []
    spark = df.sparkSession
    if named_dates:
        one = spark.range(1)
        parts.append(one.select(F.explode(F.array(*[F.lit(c) for c in named_dates])).alias("column"),
                                F.lit("datetime").alias("kind"), F.lit(1).alias("rank")))
    if by_role["numeric"]:
        skew = numeric_profile(df, by_role["numeric"]).select("column", "skew")
        parts.append(skew.where(F.abs("skew") > 1.5).select(
            "column", F.when(F.col("skew") > 0, "reduce_right_skew").otherwise("reduce_left_skew").alias("kind"), F.lit(2).alias("rank")))
    if by_role["categorical"]:
        facts = text_profile(df, by_role["categorical"])
        parts.append(facts.where("unique > 10").select("column", F.lit("high_cardinality").alias("kind"), F.lit(3).alias("rank")))
        parts.append(facts.where("len_mean > 20").select("column", F.lit("text").alias("kind"), F.lit(4).alias("rank")))
    if len(by_role["numeric"]) >= 2:
        parts.append(spark.range(1).select(F.lit("interactions").alias("column"), F.lit("interaction").alias("kind"), F.lit(5).alias("rank")))
    return union_all(parts).groupBy("column").agg(F.max_by("kind", "rank").alias("kind"))
