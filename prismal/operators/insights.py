"""Ordered findings about a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.operators.corr import pearson_pairs
from prismal.operators.profile import counts_of, distinct_profile, missing_of, numeric_profile, suggest_targets, text_profile
from prismal.plans.scalars import union_all
from prismal.session import materialize
from prismal.sources.tables import roles

KINDS = ("overview", "missing", "distribution", "breakdown", "correlation", "outliers", "time_trend", "group_comparison", "predictive")


def _rows(frame: DataFrame, kind: str, order: Sequence[Column], column: Column | str | None = None, other: Column | str | None = None,
          value: Column | str | None = None, second: Column | str | None = None, detail: Column | str | None = None, most: int | None = None) -> DataFrame:
    """Findings of one kind, numbered in their order (a row for each column or pair of columns at most)."""

    def part(x: Column | str | None, to: str) -> Column:
        return (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(to)

    placed = frame.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(*order)))
    placed = placed if most is None else placed.where(F.col("_place") <= most)
    return placed.select(F.lit(KINDS.index(kind) + 1).alias("section"), F.lit(kind).alias("insight_type"), F.col("_place").alias("place"),
                         part(column, "string").alias("column"), part(other, "string").alias("other"), part(value, "double").alias("value"),
                         part(second, "double").alias("second"), part(detail, "string").alias("detail"))


def dataset_insights(df: DataFrame, most: int | None = None) -> DataFrame:
    """Overview, missing values, distributions, breakdowns, strong correlations, outliers, a time trend, a group comparison and a target.

    Each finding is a row with its ``insight_type`` and ``place`` among its like; ``most`` limits the rows of a kind. One aggregate of
    moments, one pass over distinct values and one of correlations read the table; all findings come from what these wrote.
    """
    by_role = roles(df)
    numeric, texts, dates = by_role["numeric"], by_role["categorical"], by_role["datetime"]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])[F.col("column")]
    found = []
    counts = counts_of(df)
    size = counts.where(F.col("column") == df.columns[0]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    found.append(_rows(size, "overview", ["n"], value="n", second=F.lit(len(df.columns)),
                       detail=F.lit(f"numeric={len(numeric)} categorical={len(texts)} datetime={len(dates)}")))
    found.append(_rows(missing_of(counts), "missing", [F.desc("missing"), place], "column", value="missing", second="missing_pct", most=most))
    if numeric:
        stats = materialize(numeric_profile(df, numeric, counts=counts), "numeric-profile")
        gap = F.abs(F.col("mean") - F.col("median")) * 100 / F.abs("median")
        notes = F.array_compact(F.array(F.when(F.col("skew") > 1, "skewed_right"), F.when(F.col("skew") < -1, "skewed_left"),
                                        F.when((F.col("median") != 0) & (gap > 10), "mean_off_median")))
        found.append(_rows(stats, "distribution", [place], "column", value="mean", second="median", detail=F.array_join(notes, ","), most=most))
        found.append(_rows(stats.where("outlier_pct > 5"), "outliers", [F.desc("outlier_pct"), place], "column", value="outlier_pct", most=most))
    if len(numeric) > 1:
        strong = pearson_pairs(df, numeric).where("abs(corr) > 0.6")
        words = F.concat(F.when(F.abs("corr") > 0.8, "strong ").otherwise("moderate "), F.when(F.col("corr") > 0, "positive").otherwise("negative"))
        found.append(_rows(strong, "correlation", [F.abs("corr").desc(), "var_1", "var_2"], "var_1", "var_2", "corr", detail=words, most=most))
    if texts:
        facts = materialize(text_profile(df, texts, counts), "text-profile")
        found.append(_rows(facts, "breakdown", [place], "column", value="freq_pct", second="unique", detail="top", most=most))
        if numeric:
            few = facts.where((F.col("column") == texts[0]) & (F.col("unique") <= 10))
            found.append(_rows(few, "group_comparison", ["column"], F.lit(numeric[0]), "column"))
    if numeric and dates:
        distinct = distinct_profile(df, numeric, counts)
        varied = distinct.where("unique > 10").agg(F.min_by("column", place).alias("column")).where("column IS NOT NULL")
        found.append(_rows(varied, "time_trend", ["column"], "column", F.lit(dates[0])))
    target = suggest_targets(df, counts).orderBy("place", "column").limit(1)
    found.append(_rows(target, "predictive", ["place"], "column", detail="kind"))
    return union_all(found)
