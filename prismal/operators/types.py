"""Type conversion and type inference. Bad values become missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.operators.profile import DATE_FORMATS, parsed_date, text_profile
from prismal.sources.tables import roles

# Text read as true and false by the converters (fixed values).
TRUE_TEXT = ["True", "true", "1", "yes", "Y"]
FALSE_TEXT = ["False", "false", "0", "no", "N"]
# Text read as true and false by type inference, after lower-casing (fixed values).
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def to_int(c: Column | str) -> Column:
    """Truncated integer; missing and bad values become 0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0)).try_cast("bigint")


def to_string(c: Column | str) -> Column:
    return _col(c).cast("string")


def to_datetime(c: Column | str, fmt: str | None = None) -> Column:
    """Timestamp from text by one format, or by the first known format that fits."""
    return F.try_to_timestamp(_col(c), F.lit(fmt)) if fmt else parsed_date(_col(c))


def to_boolean(c: Column | str) -> Column:
    text = _col(c).cast("string")
    return F.when(text.isin(TRUE_TEXT), True).when(text.isin(FALSE_TEXT), False)


def to_binary(c: Column | str) -> Column:
    return to_boolean(c).cast("tinyint")


def category_columns(df: DataFrame, rule: str = "profile") -> DataFrame:
    """Flag text columns of low cardinality under one of the three rules in use."""
    limits = {
        "profile": F.least(0.2 * F.col("n_rows"), F.lit(50)), "strict": F.lit(20.0),
        "enhanced": F.least(0.05 * F.col("n_rows"), F.lit(20)),
    }
    return text_profile(df).select("column", "unique", (F.col("unique") < limits[rule]).alias("is_category"))


def inference_plan(df: DataFrame, strict: bool = False) -> DataFrame:
    """Target type per text column from the success rates over all values.

    Lenient: numeric, then datetime, above 80 % success, unless there are more
    distinct values than min(half of the rows, 100). Strict: datetime, then
    numeric, only when every value converts; below 20 distinct is a category.
    """
    facts = text_profile(df)
    c = F.col
    if strict:
        verdict = (F.when(c("non_null") == 0, "string").when(c("date_rows") == c("non_null"), "timestamp")
                   .when(c("numeric_rows") == c("non_null"), "double").when(c("unique") < 20, "category").otherwise("string"))
    else:
        narrow = c("unique") <= F.least(0.5 * c("n_rows"), F.lit(100))
        verdict = (F.when(narrow & (c("numeric_rows") > 0.8 * c("non_null")), "double")
                   .when(narrow & (c("date_rows") > 0.8 * c("non_null")), "timestamp")
                   .when(c("unique") < F.least(0.2 * c("n_rows"), F.lit(50)), "category").otherwise("string"))
    return facts.select("column", verdict.alias("new_type"), "numeric_rows", "date_rows", "non_null")


def infer_types(df: DataFrame, strict: bool = False) -> DataFrame:
    """Cast text columns as planned. Reads one plan row per column first, as the schema depends on it."""
    plan = {r["column"]: r["new_type"] for r in inference_plan(df, strict).select("column", "new_type").collect()}
    make = {"double": to_numeric, "timestamp": to_datetime}
    return df.select(*[make[plan[c]](c).alias(c) if plan.get(c) in make else F.col(c) for c in df.columns])


def inference_log(df: DataFrame, order_by: Sequence[str], threshold: float = 0.8, sample: int | None = None) -> DataFrame:
    """Staged inference on all values, or the first ``sample`` along an order key: boolean, number, date format, category.

    One row per changed column with the new type, format and confidence.
    """
    columns = [c for c in roles(df)["categorical"] if c not in order_by]
    rows = None
    for c in columns:
        first = df.where(F.col(c).isNotNull()).select(*order_by, F.col(c).alias("v"))
        first = first if sample is None else first.orderBy(*order_by).limit(sample)
        low = F.lower("v")
        number = F.col("v").try_cast("double")
        facts = first.agg(
            F.count("v").alias("n"), F.count_if(low.isin(TRUE_WORDS + FALSE_WORDS)).alias("flags"),
            F.count(number).alias("numbers"), F.count_if(number == F.floor(number)).alias("wholes"),
            *[F.count(F.try_to_timestamp("v", F.lit(f))).alias(f"d{i}") for i, f in enumerate(DATE_FORMATS)])
        named = facts.select(F.lit(c).alias("column"), "*")
        rows = named if rows is None else rows.unionByName(named)
    distinct = text_profile(df, columns).select("column", "unique", "n_rows")
    whole = F.col("n") > 0
    fmt = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, f in enumerate(DATE_FORMATS):
        fmt = fmt.when(whole & (F.col(f"d{i}") == F.col("n")), f)
    staged = rows.join(F.broadcast(distinct), "column").withColumn("format", fmt).withColumn("flag_rate", F.try_divide("flags", "n"))
    kind = (F.when(F.col("flag_rate") >= threshold, "boolean").when(whole & (F.col("wholes") == F.col("n")), "bigint")
            .when(whole & (F.col("numbers") == F.col("n")), "double").when(F.col("format").isNotNull(), "timestamp")
            .when(whole & (F.col("unique") < F.least(F.lit(20), 0.05 * F.col("n_rows"))), "category"))
    confidence = (F.when(kind == "boolean", F.col("flag_rate")).when(kind.isin("bigint", "double"), 0.9)
                  .when(kind == "timestamp", 0.85).when(kind == "category", 0.7))
    return staged.select(
        "column", F.lit("string").alias("original_type"), kind.alias("new_type"),
        F.when(kind == "timestamp", F.col("format")).alias("format"), confidence.cast("double").alias("confidence"),
    ).where("new_type IS NOT NULL")


def infer_types_enhanced(df: DataFrame, order_by: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Cast by the change log (one row per column is read first)."""
    log = {r["column"]: r for r in inference_log(df, order_by, threshold).collect()}

    def cast(c: str) -> Column:
        entry = log.get(c)
        if entry is None or entry["new_type"] == "category":
            return F.col(c)
        if entry["new_type"] == "boolean":
            low = F.lower(c)
            return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False).alias(c)
        if entry["new_type"] == "timestamp":
            return to_datetime(c, entry["format"]).alias(c)
        return F.col(c).try_cast("double").try_cast(entry["new_type"]).alias(c)

    return df.select(*[cast(c) for c in df.columns])
