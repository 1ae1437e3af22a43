"""Long value frames and value counts, the base of every categorical operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.plans.scalars import attach_row


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """One row per (row, column): keys, ``column``, ``value`` cast to one type."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keys, F.inline(cells))


def value_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), kind: str = "string") -> DataFrame:
    """Counts per keys, column and value (missing values form their own row)."""
    return long_values(df, columns, keys, kind).groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """Most frequent value per column; equal counts resolve to the lowest value."""
    counts = value_counts(df, columns, kind=kind).where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("best"),
        F.count(F.lit(1)).alias("unique"), F.sum("n").alias("non_null"),
    ).select("column", F.col("best.value").alias("mode"), (-F.col("best.neg")).alias("freq"), "unique", "non_null")


def mode_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``m_<column>``: the most frequent value of each column in its own type."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] not in ("string", "boolean", "date", "timestamp", "timestamp_ntz")]
    others = [c for c in columns if c not in numeric]
    rows = None
    for group, kind in ((numeric, "double"), (others, "string")):
        if not group:
            continue
        row = modes(df, group, kind).agg(*[
            F.max(F.when(F.col("column") == c, F.col("mode"))).cast(kinds[c]).alias(f"m_{c}") for c in group])
        rows = row if rows is None else attach_row(rows, row)
    return rows
