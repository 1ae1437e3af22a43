"""Quality score, issue lists, recommendations and before / after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions.moments import percent
from prismal.operators.profile import counts_of, distinct_profile, missing_of, missing_profile, numeric_profile, table_info, text_profile
from prismal.plans.scalars import attach_row, union_all
from prismal.session import materialize
from prismal.sources.tables import roles


def quality_parts(df: DataFrame) -> DataFrame:
    """The counts behind the score, in one row."""
    by_role, counts = roles(df), counts_of(df)
    row = table_info(df).select("n_rows", "missing_pct", "duplicate_pct")
    if by_role["numeric"]:
        row = attach_row(row, numeric_profile(df, by_role["numeric"], counts=counts).agg(
            F.count_if(F.col("outlier_pct") > 10).alias("outlier_cols"), F.count_if(F.abs("skew") > 3).alias("skewed_cols")))
    else:
        row = row.selectExpr("*", "0L AS outlier_cols", "0L AS skewed_cols")
    if by_role["categorical"]:
        c = F.col
        few = c("unique") < 10
        row = attach_row(row, text_profile(df, by_role["categorical"], counts).agg(
            F.count_if((c("unique") > 100) & (c("unique") > 0.5 * c("n_rows"))).alias("high_card_cols"),
            (F.count_if(c("numeric_rows") > 0.8 * c("non_null")) + F.count_if(c("date_rows") > 0.8 * c("non_null"))).alias("dtype_issues"),
            (F.count_if(few & c("any_upper")) + F.count_if(few & (c("space_rows") > 0))).alias("text_issues")))
    else:
        row = row.selectExpr("*", "0L AS high_card_cols", "0L AS dtype_issues", "0L AS text_issues")
    return row


def quality_score(df: DataFrame) -> DataFrame:
    """Score 0..100 from capped penalties; rounded half-even after the first and the second group. Empty -> 0."""
    def penalty(most: float, c: Column) -> Column:
        return F.least(F.lit(float(most)), c.cast("double"))

    def settle(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(c, 0)))

    c = F.col
    first = settle(100 - penalty(30, 3 * c("missing_pct")) - penalty(15, 3 * c("duplicate_pct"))
                   - penalty(10, 2 * c("high_card_cols")) - penalty(15, 3 * c("outlier_cols")))
    second = settle(first - penalty(15, 3 * c("dtype_issues")) - penalty(5, c("skewed_cols")) - penalty(10, 2 * c("text_issues")))
    return quality_parts(df).select("*", F.when(c("n_rows") == 0, 0).otherwise(second).cast("int").alias("score"))


def quality_issues(df: DataFrame) -> DataFrame:
    """Issue rows (issue, column, amount); table-wide issues carry no column."""
    by_role, counts = roles(df), counts_of(df)
    none = F.lit(None).cast("string")
    parts = [
        missing_of(counts).select(F.lit("missing").alias("issue"), "column", F.col("missing").cast("double").alias("amount")),
        table_info(df).where("duplicate_rows > 0").select(
            F.lit("duplicates").alias("issue"), none.alias("column"), F.col("duplicate_rows").cast("double").alias("amount"))]
    if by_role["numeric"]:
        numeric = materialize(numeric_profile(df, by_role["numeric"], counts=counts), "numeric-profile")  # one row per column, read twice
        parts.append(numeric.where("outliers > 0").select(F.lit("outliers").alias("issue"), "column", F.col("outlier_pct").alias("amount")))
        parts.append(numeric.where(F.abs("skew") > 3).select(F.lit("skewed").alias("issue"), "column", F.col("skew").alias("amount")))
    if by_role["categorical"]:
        facts = materialize(text_profile(df, by_role["categorical"], counts), "text-profile")  # one row per column, read by every test
        tests = [
            ("likely_numeric", "numeric_rows > 0.8 * non_null", "numeric_rows"),
            ("likely_datetime", "date_rows > 0.8 * non_null", "date_rows"),
            ("high_cardinality", "unique > 100 AND unique > 0.5 * n_rows", "unique"),
            ("text_format", "unique < 15 AND (unique_lower < unique OR space_rows > 0)", "unique"),
        ]
        parts += [facts.where(test).select(F.lit(name).alias("issue"), "column", F.col(amount).cast("double").alias("amount"))
                  for name, test, amount in tests]
    return union_all(parts)


def cleaning_issues(df: DataFrame) -> DataFrame:
    """Issue rows (column, issue, count, pct). Duplicates are listed under the column ``global``."""
    by_role, counts = roles(df), counts_of(df)
    info = materialize(table_info(df), "table-info")  # one row
    parts = [
        missing_of(counts).select("column", F.lit("missing_values").alias("issue"), F.col("missing").alias("count"), F.col("missing_pct").alias("pct")),
        info.where("duplicate_rows > 0").select(
            F.lit("global").alias("column"), F.lit("duplicate_rows").alias("issue"), F.col("duplicate_rows").alias("count"),
            F.col("duplicate_pct").alias("pct"))]
    issue = lambda name, count, base: F.struct(
        F.lit(name).alias("issue"), count.cast("long").alias("count"), percent(count, base).alias("pct"))
    c = F.col

    def listed(facts: DataFrame, tests: list[tuple[str, Column, Column, Column]]) -> DataFrame:
        found = F.filter(F.array(*[F.when(test, issue(name, n, base)) for name, test, n, base in tests]), lambda e: e.isNotNull())
        return facts.select("column", F.inline(found))

    if by_role["numeric"]:
        parts.append(listed(numeric_profile(df, by_role["numeric"], counts=counts), [
            (name, c(count) > 0, c(count), c("n_rows"))
            for name, count in (("outliers", "outliers"), ("zeros", "zeros"), ("negatives", "negatives"))]))
    if by_role["categorical"]:
        parts.append(listed(text_profile(df, by_role["categorical"], counts), [
            ("possible_numeric", c("numeric_rows") > 0.8 * c("non_null"), c("numeric_rows"), c("non_null")),
            ("possible_datetime", c("date_rows") > 0.8 * c("non_null"), c("date_rows"), c("non_null")),
            ("inconsistent_case", c("unique_lower") < c("unique"), c("unique") - c("unique_lower"), c("unique")),
            ("whitespace", c("space_rows") > 0, c("space_rows"), c("n_rows")),
            ("special_characters", c("special_rows") > 0, c("special_rows"), c("n_rows")),
            ("high_cardinality", (c("unique") > 50) & (c("unique") > 0.5 * c("n_rows")), c("unique"), c("n_rows"))]))
    return union_all(parts)


def cleaning_suggestions(df: DataFrame) -> DataFrame:
    """One action per cleaning issue."""
    pct, issue = F.col("pct"), F.col("issue")
    action = (
        F.when(issue == "missing_values", F.when(pct > 80, "drop column").when(pct > 30, "drop or impute with median or mode")
               .otherwise("impute with mean, median or mode"))
        .when(issue == "outliers", F.when(pct > 10, "investigate outliers").when(pct > 2, "cap or transform").otherwise("remove or cap"))
        .when(issue == "zeros", "check whether zeros mean missing").when(issue == "negatives", "verify negative values")
        .when(issue == "possible_numeric", "convert to numeric").when(issue == "possible_datetime", "convert to datetime")
        .when(issue == "inconsistent_case", "standardize case").when(issue == "whitespace", "strip whitespace")
        .when(issue == "special_characters", "remove special characters").when(issue == "high_cardinality", "group or encode categories")
        .when(issue == "duplicate_rows", "remove duplicate rows"))
    return cleaning_issues(df).select("column", "issue", action.alias("action"))


def impute_recommendation(df: DataFrame) -> DataFrame:
    """Fill method per column: median for outliers or skew, else mean; mode below 10 distinct; else constant."""
    by_role = roles(df)
    parts = []
    if by_role["numeric"]:
        share = percent(F.col("outliers"), F.col("count"))
        parts.append(numeric_profile(df, by_role["numeric"]).select(
            "column", F.when(share > 5, "median").when(F.abs("skew") > 1, "median").otherwise("mean").alias("method")))
    others = by_role["categorical"] + by_role["datetime"]
    if others:
        parts.append(distinct_profile(df, others).select(
            "column", F.when(F.col("unique") < 10, "mode").otherwise("constant").alias("method")))
    return union_all(parts)


def outlier_recommendation(df: DataFrame) -> DataFrame:
    """Treatment per numeric column by the outlier share of its non-missing values."""
    share = percent(F.col("outliers"), F.col("count"))
    method = F.when(share < 1, "remove").when(share < 5, "cap").otherwise("transform")
    return numeric_profile(df).select("column", share.alias("outlier_pct"), method.alias("method"))


def cleaning_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column: status (kept, new, removed), type change and missing counts before and after."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        kinds = F.create_map(*[F.lit(p) for item in df.dtypes for p in item])
        return missing_profile(df, all_columns=True).select("column", kinds[F.col("column")].alias(f"type_{tag}"),
                                                            F.col("missing").alias(f"missing_{tag}"))

    both = facts(before, "before").join(facts(after, "after"), "column", "full_outer")
    sizes = attach_row(before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("rows_after")))
    status = F.when(F.col("type_before").isNull(), "new").when(F.col("type_after").isNull(), "removed").otherwise("kept")
    return attach_row(both, sizes).select(
        "column", status.alias("status"), (F.col("type_before") != F.col("type_after")).alias("type_changed"),
        "missing_before", "missing_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))
