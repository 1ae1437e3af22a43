"""Missing values, duplicates, outliers, replacement, renaming and a replayable cleaning plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions import text
from prismal.operators import features, types
from prismal.operators.profile import missing_profile
from prismal.plans.counts import mode_row
from prismal.plans.quantiles import fence_row, quantile_name, quantiles
from prismal.plans.scalars import attach_row
from prismal.sources.tables import roles

# --- missing values --------------------------------------------------------------------------


def _fill_from_row(df: DataFrame, row: DataFrame, values: dict[str, Column]) -> DataFrame:
    kinds = dict(df.dtypes)
    tagged = attach_row(df, row)
    return tagged.select(*[
        F.coalesce(F.col(c), values[c].cast(kinds[c])).alias(c) if c in values else F.col(c) for c in df.columns])


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the column mean (the column becomes double)."""
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    row = doubles.agg(*[F.avg(c).alias(f"a_{c}") for c in columns])
    return _fill_from_row(doubles, row, {c: F.col(f"a_{c}") for c in columns})


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the exact median (the column becomes double)."""
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return _fill_from_row(doubles, quantiles(doubles, columns, [0.5]), {c: F.col(quantile_name(c))[0] for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the most frequent value, the lowest on ties; text without any value becomes ``Unknown``."""
    kinds = dict(df.dtypes)
    values = {c: F.coalesce(F.col(f"m_{c}"), F.lit("Unknown")) if kinds[c] == "string" else F.col(f"m_{c}") for c in columns}
    return _fill_from_row(df, mode_row(df, columns), values)


def impute_constant(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    return df.fillna(values)


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns)) if columns else df.dropna()


def impute_all(df: DataFrame) -> DataFrame:
    """Median for every numeric column, mode for every other column."""
    by_role = roles(df)
    out = impute_median(df, by_role["numeric"]) if by_role["numeric"] else df
    others = [c for c in df.columns if c not in by_role["numeric"]]
    return impute_mode(out, others) if others else out


def auto_impute(df: DataFrame, drop_above: float = 50.0) -> DataFrame:
    """Drop columns missing in more than half of the rows, fill the rest by median or mode.

    Reads one profile row per column first, because the result schema depends on it.
    """
    share = {r["column"]: r["missing_pct"] for r in missing_profile(df).collect()}
    kept = df.drop(*[c for c, pct in share.items() if pct > drop_above])
    gaps = [c for c, pct in share.items() if pct <= drop_above]
    numeric = [c for c in gaps if c in roles(kept)["numeric"]]
    others = [c for c in gaps if c not in numeric]
    out = impute_median(kept, numeric) if numeric else kept
    return impute_mode(out, others) if others else out


# --- duplicates ------------------------------------------------------------------------------


def _one_per_group(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], last: bool, only_single: bool) -> DataFrame:
    """Pick one row per group with an aggregate, so a group of any size combines before the shuffle."""
    order = [c for c in order_by]
    rest = [c for c in df.columns if c not in subset]
    fields = [*order, *[c for c in rest if c not in order]]
    packed = F.struct(*[F.col(c).alias(c) for c in fields])
    pick = F.max(packed) if last else F.min(packed)
    groups = df.groupBy(*subset).agg(pick.alias("_row"), F.count(F.lit(1)).alias("_n"))
    if only_single:
        groups = groups.where("_n = 1")
    return groups.select(*[F.col(c) if c in subset else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedupe_first(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct row, or the first row per subset along a unique order key."""
    if not subset:
        return df.dropDuplicates()
    _needs_order(order_by)
    return _one_per_group(df, subset, order_by, last=False, only_single=False)


def dedupe_last(df: DataFrame, subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    _needs_order(order_by)
    return _one_per_group(df, subset, order_by, last=True, only_single=False)


def dedupe_none(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop every member of a duplicate set."""
    subset = list(subset or df.columns)
    if len(subset) == len(df.columns):
        return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return _one_per_group(df, subset, (), last=False, only_single=True)


def duplicate_rows(df: DataFrame, subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier row of the same subset.

    Only groups with more than one row enter the join, with one first key each.
    """
    _needs_order(order_by)
    key = F.struct(*[F.col(c).alias(c) for c in order_by])
    first = (df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in subset])
             .agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    match = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in subset]
    return df.withColumn("_key", key).join(first, match).where(F.col("_key") > F.col("_first")).select(*df.columns)


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("duplicates")).withColumn(
        "duplicate_pct", F.try_divide(F.col("duplicates") * 100.0, F.col("n_rows")))


def _needs_order(order_by: Sequence[str]) -> None:
    if not order_by:
        raise ValueError("rows have no natural order: name a unique order key")


# --- outliers --------------------------------------------------------------------------------


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    row = fence_row(df, columns, k)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"f_{c}.{m}").alias(m) for m in ("q1", "q3", "iqr", "lower", "upper")])
        for c in columns])))


def cap_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    tagged = attach_row(df, fence_row(df, columns, k))
    return tagged.select(*[
        text.clip(F.col(c).cast("double"), F.col(f"f_{c}.lower"), F.col(f"f_{c}.upper")).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def remove_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows inside the fences of every column; rows with a missing value go too."""
    tagged = attach_row(df, fence_row(df, columns, k))
    inside = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"f_{c}.lower"), F.col(f"f_{c}.upper")) for c in columns])
    return tagged.where(inside).select(*df.columns)


def outlier_mask(df: DataFrame, column: str, method: str = "iqr", out: str = "is_outlier") -> DataFrame:
    """Flag by fences (1.5) or by absolute z-score above 3; missing is not an outlier."""
    if method == "iqr":
        tagged = attach_row(df, fence_row(df, [column]))
        test = (F.col(column) < F.col(f"f_{column}.lower")) | (F.col(column) > F.col(f"f_{column}.upper"))
    elif method == "zscore":
        tagged = attach_row(df, df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s")))
        test = F.abs(F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))) > 3
    else:
        raise ValueError(f"unknown method {method!r}")
    return tagged.select(*df.columns, F.coalesce(test, F.lit(False)).alias(out))


# --- values and names ------------------------------------------------------------------------


def replace_values(df: DataFrame, column: str, old, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(F.col(column)))


def count_value(df: DataFrame, column: str, value) -> DataFrame:
    return df.agg(F.count_if(F.col(column) == F.lit(value)).alias("occurrences"))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    return df.drop(column)


def cleaned_names(names: Sequence[str]) -> list[str]:
    """Lower-case names of word characters and underscores, made unique by a number."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for raw in names:
        words = re.sub(r"[^\w\s]", "", raw).split()
        name = "_".join(words).lower().strip("_") or "column"
        name = f"col_{name}" if name[0].isdigit() else name
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*cleaned_names(df.columns))


# --- actions and the replayable plan ---------------------------------------------------------


def _on(column: str, make: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(column, make(F.col(column)))


# One entry per cleaning action; every entry takes (df, column, parameters) and returns a frame.
ACTIONS: dict[str, Callable[[DataFrame, str | None, dict[str, Any]], DataFrame]] = {
    "remove_duplicates": lambda df, c, p: dedupe_first(df, p.get("subset"), p.get("order_by", ())),
    "keep_last_duplicates": lambda df, c, p: dedupe_last(df, p["subset"], p["order_by"]),
    "drop_all_duplicates": lambda df, c, p: dedupe_none(df, p.get("subset")),
    "drop_column": lambda df, c, p: drop_column(df, c),
    "drop_missing": lambda df, c, p: drop_missing(df, [c] if c else None),
    "fill_mean": lambda df, c, p: impute_mean(df, [c]),
    "fill_median": lambda df, c, p: impute_median(df, [c]),
    "fill_mode": lambda df, c, p: impute_mode(df, [c]),
    "fill_value": lambda df, c, p: impute_constant(df, {c: p["value"]}),
    "to_numeric": lambda df, c, p: df.transform(_on(c, types.to_numeric)),
    "to_int": lambda df, c, p: df.transform(_on(c, types.to_int)),
    "to_string": lambda df, c, p: df.transform(_on(c, types.to_string)),
    "to_datetime": lambda df, c, p: df.transform(_on(c, lambda col: types.to_datetime(col, p.get("format")))),
    "to_boolean": lambda df, c, p: df.transform(_on(c, types.to_boolean)),
    "to_binary": lambda df, c, p: df.transform(_on(c, types.to_binary)),
    "lowercase": lambda df, c, p: df.transform(_on(c, text.lower)),
    "uppercase": lambda df, c, p: df.transform(_on(c, text.upper)),
    "titlecase": lambda df, c, p: df.transform(_on(c, text.title)),
    "strip": lambda df, c, p: df.transform(_on(c, text.strip)),
    "remove_special": lambda df, c, p: df.transform(_on(c, text.remove_special)),
    "cap_outliers": lambda df, c, p: cap_outliers(df, [c], p.get("k", 1.5)),
    "remove_outliers": lambda df, c, p: remove_outliers(df, [c], p.get("k", 1.5)),
    "replace": lambda df, c, p: replace_values(df, c, p["old"], p["new"]),
    "log": lambda df, c, p: features.log_transform(df, c),
    "sqrt": lambda df, c, p: features.sqrt_transform(df, c),
    "bin": lambda df, c, p: features.bin_equal_width(df, c, p.get("bins", 5)),
    "one_hot": lambda df, c, p: features.one_hot(df, c, drop_first=p.get("drop_first", False)),
    "minmax": lambda df, c, p: features.minmax_scale(df, [c]),
    "standardize": lambda df, c, p: features.standard_scale(df, [c]),
    "robust": lambda df, c, p: features.robust_scale(df, [c]),
    "rename_all": lambda df, c, p: clean_column_names(df),
}


@dataclass(frozen=True)
class Step:
    """One cleaning action with its column and parameters."""

    action: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")
        if self.column is not None and self.column not in df.columns:
            raise ValueError(f"unknown column {self.column!r}")
        return ACTIONS[self.action](df, self.column, self.params)


def clean(df: DataFrame, action: str, column: str | None = None, **params: Any) -> DataFrame:
    return Step(action, column, params).apply(df)


@dataclass(frozen=True)
class CleaningPlan:
    """An ordered list of steps over a source frame. Undo drops a step; the plan is rebuilt, nothing is copied."""

    source: DataFrame
    steps: tuple[Step, ...] = ()

    def add(self, action: str, column: str | None = None, **params: Any) -> CleaningPlan:
        return CleaningPlan(self.source, (*self.steps, Step(action, column, params)))

    def undo(self) -> CleaningPlan:
        return CleaningPlan(self.source, self.steps[:-1])

    def without(self, position: int) -> CleaningPlan:
        return CleaningPlan(self.source, self.steps[:position] + self.steps[position + 1:])

    def reset(self) -> CleaningPlan:
        return CleaningPlan(self.source)

    def result(self) -> DataFrame:
        return reduce(lambda df, step: df.transform(step.apply), self.steps, self.source)
