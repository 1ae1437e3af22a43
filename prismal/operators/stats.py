"""Hypothesis tests and regressions. Statistics are Spark aggregates; p-values are computed on the one-row results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions.dist import (chi2_p_value, f_p_value, normal_p_value, normal_quantile, t_p_value, tukey_p_value)
from prismal.functions.moments import percent
from prismal.functions.text import bands
from prismal.operators.corr import kendall_parts, pearson_pairs, spearman_pairs
from prismal.operators.explore import crosstab_long, most_frequent
from prismal.operators.profile import distinct_profile
from prismal.plans.quantiles import quantile_name, quantiles
from prismal.plans.scalars import attach_row

ALPHA = 0.05


def decided(test: DataFrame) -> DataFrame:
    """Add the 5 % decision to a test with a ``p_value``."""
    return test.withColumn("significant", F.col("p_value") < ALPHA)


# --- distribution ----------------------------------------------------------------------------


def normality_test(df: DataFrame, column: str) -> DataFrame:
    """Jarque-Bera on population skewness and excess kurtosis."""
    row = df.agg(F.count(column).alias("n"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return row.select("n", "skew", "kurtosis", jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def qq_quantiles(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """Sample quantiles beside normal quantiles at even probabilities, and the fitted line."""
    probs = [i / (points + 1) for i in range(1, points + 1)]
    pairs = quantiles(df, [column], probs).select(F.posexplode(quantile_name(column)).alias("i", "sample"))
    tagged = pairs.select("i", ((F.col("i") + 1) / (points + 1.0)).alias("p"), "sample").withColumn("theoretical", normal_quantile("p"))
    fit = tagged.agg(F.regr_slope("sample", "theoretical").alias("_b"), F.regr_intercept("sample", "theoretical").alias("_a"))
    return attach_row(tagged, fit).select("p", "sample", "theoretical", (F.col("_a") + F.col("_b") * F.col("theoretical")).alias("line"))


# --- means -----------------------------------------------------------------------------------


def _one_sample(row: DataFrame, mu: float) -> DataFrame:
    t = F.try_divide(F.col("mean") - mu, F.try_divide(F.col("std"), F.sqrt(F.col("n").cast("double"))))
    dof = (F.col("n") - 1).cast("double")
    return row.select("n", "mean", "std", t.alias("statistic"), dof.alias("dof"), t_p_value(t, dof).alias("p_value"))


def ttest_one_sample(df: DataFrame, column: str, mu: float) -> DataFrame:
    return _one_sample(df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")), mu)


def ttest_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    return ttest_one_sample(df.select((F.col(a) - F.col(b)).alias("d")), "d", 0.0)


def group_moments(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean and variance per group, groups of at least two values."""
    rows = df.dropna(subset=[by, value])
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).where("n >= 2")


def _anova_from(groups: DataFrame) -> DataFrame:
    """F from group moments; the between sum of squares uses the pooled mean."""
    n, mean, var = F.col("n").cast("double"), F.col("mean"), F.col("var")
    total = groups.agg(F.sum(n).alias("_n"), F.try_divide(F.sum(n * mean), F.sum(n)).alias("_grand"))
    row = attach_row(groups, total).agg(
        F.count(F.lit(1)).alias("k"), F.first("_n").alias("total"), F.sum(n * F.pow(mean - F.col("_grand"), 2)).alias("between"),
        F.sum((n - 1) * var).alias("within"))
    d1, d2 = (F.col("k") - 1).cast("double"), F.col("total") - F.col("k")
    stat = F.try_divide(F.try_divide("between", d1), F.try_divide("within", d2))
    return row.where("k >= 2").select(
        "k", F.col("total").cast("long").alias("n"), "between", "within", d1.alias("df_between"), d2.alias("df_within"),
        stat.alias("statistic"), f_p_value(stat, d1, d2).alias("p_value"))


def anova_oneway(df: DataFrame, by: str, value: str, most: int | None = None) -> DataFrame:
    """One-way analysis of variance over all groups, or the ``most`` most frequent."""
    return _anova_from(group_moments(_frequent(df, by, value, most), by, value))


def _frequent(df: DataFrame, by: str, value: str, most: int | None) -> DataFrame:
    rows = df.dropna(subset=[by, value])
    if most is None:
        return rows
    return rows.join(F.broadcast(most_frequent(rows, by, most).select(by)), by, "left_semi")  # at most ``most`` rows


def levene_test(df: DataFrame, by: str, value: str, most: int | None = None) -> DataFrame:
    """Equality of variances: analysis of variance of the distances from the group medians."""
    rows = _frequent(df, by, value, most).select(by, F.col(value).cast("double").alias("v"))
    medians = quantiles(rows, ["v"], [0.5], [by]).select(by, F.col(quantile_name("v"))[0].alias("_mid"))
    apart = rows.join(medians, by).select(by, F.abs(F.col("v") - F.col("_mid")).alias("d"))
    return _anova_from(group_moments(apart, by, "d"))


def ttest_two_sample(df: DataFrame, by: str, value: str, first, second) -> DataFrame:
    """Pooled test when Levene's p is at least 5 %, else Welch's."""
    rows = df.where(F.col(by).isin(first, second)).dropna(subset=[by, value])
    side = lambda g: F.when(F.col(by) == g, F.col(value))
    row = rows.agg(*[fn(side(g)).alias(f"{name}{i}") for i, g in ((1, first), (2, second))
                     for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    row = attach_row(row, levene_test(rows, by, value).select(F.col("p_value").alias("levene_p")))
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "var1", "var2"))
    pooled = F.col("levene_p") >= ALPHA
    div, one = F.try_divide, F.lit(1.0)
    sp = div((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    e1, e2 = div(v1, n1), div(v2, n2)
    se = F.when(pooled, F.sqrt(sp * (div(one, n1) + div(one, n2)))).otherwise(F.sqrt(e1 + e2))
    welch = div((e1 + e2) * (e1 + e2), div(e1 * e1, n1 - 1) + div(e2 * e2, n2 - 1))
    t = F.try_divide(F.col("mean1") - F.col("mean2"), se)
    dof = F.when(pooled, n1 + n2 - 2).otherwise(welch)
    return row.select("n1", "n2", "mean1", "mean2", F.when(pooled, "pooled").otherwise("welch").alias("method"), "levene_p",
                      t.alias("statistic"), dof.alias("dof"), t_p_value(t, dof).alias("p_value"))


def tukey_hsd(df: DataFrame, by: str, value: str, most: int | None = None) -> DataFrame:
    """Pairwise mean differences over all groups, or the ``most`` most frequent: one row for each pair of groups."""
    groups = group_moments(_frequent(df, by, value, most), by, value)
    every = groups.agg(
        F.sort_array(F.collect_list(F.struct(F.col(by).alias("g"), F.col("n").cast("double").alias("n"), "mean"))).alias("gs"),
        F.count(F.lit(1)).cast("double").alias("k"), (F.sum("n") - F.count(F.lit(1))).cast("double").alias("dof"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"))  # one entry per group
    first = every.select("*", F.posexplode("gs").alias("i", "a"))
    both = first.select("*", F.explode(F.expr("slice(gs, i + 2, size(gs))")).alias("b"))
    gap = F.col("b.mean") - F.col("a.mean")
    q = F.try_divide(F.abs(gap), F.sqrt(F.try_divide("within", "dof") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n"))))
    p = tukey_p_value(q, F.col("k"), F.col("dof"))
    return both.select(F.col("a.g").alias("group_1"), F.col("b.g").alias("group_2"), gap.alias("mean_diff"), q.alias("q"),
                       p.alias("p_value"), (p < ALPHA).alias("reject"))


# --- association -----------------------------------------------------------------------------


def _observed(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed cells with their margins and the total; label pairs that never occur have no row."""
    cells = crosstab_long(df, a, b).withColumnRenamed("n", "observed")
    rows = cells.groupBy(a).agg(F.sum("observed").alias("_ra"))
    cols = cells.groupBy(b).agg(F.sum("observed").alias("_cb"))
    joined = attach_row(cells.join(rows, a).join(cols, b), cells.agg(F.sum("observed").alias("_n")))
    return joined.withColumn("expected", F.col("_ra") * F.col("_cb") / F.col("_n").cast("double"))


def _statistic(cells: DataFrame) -> DataFrame:
    """One row: sum of o^2 / e over observed cells less n, which is chi-square over the full grid."""
    return cells.agg((F.sum(F.col("observed") * F.col("observed") / F.col("expected")) - F.max("_n")).alias("plain"), F.sum("observed").alias("n"))


def chi2_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of the label pairs that occur, with each cell's share of chi-square over the full grid.

    A pair that doesn't occur would add its expected count.
    """
    cells = _observed(df, a, b)
    part = F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected")
    return attach_row(cells, _statistic(cells).select(F.col("plain").alias("_chi2"))).select(
        a, b, "observed", "expected", percent(part, F.col("_chi2")).alias("contribution_pct"))


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test; Yates' correction at one degree of freedom. Work and rows follow the observed cells."""
    cells = _observed(df, a, b)
    inverse = lambda c, margin: cells.select(c, margin).distinct().agg(
        F.count(F.lit(1)).alias(f"_k{margin}"), F.sum(1 / F.col(margin)).alias(f"_i{margin}"))
    # Two by two, all four cells are equally far from expectation; any observed one tells how far.
    gap = cells.agg(F.max(F.abs(F.col("observed") - F.col("expected"))).alias("_gap"))
    row = attach_row(attach_row(attach_row(_statistic(cells), inverse(a, "_ra")), inverse(b, "_cb")), gap)
    shrunk = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    row = row.withColumn("yates", shrunk * shrunk * F.col("n") * F.col("_i_ra") * F.col("_i_cb")).withColumnsRenamed({"_k_ra": "_r", "_k_cb": "_c"})
    dof = ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("double")
    stat = F.when(dof == 1, F.col("yates")).otherwise(F.col("plain"))
    return row.select("n", stat.alias("statistic"), dof.alias("dof"), chi2_p_value(stat, dof).alias("p_value"))


def corr_test(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Coefficient with p-value (t for Pearson and Spearman, normal with ties for Kendall), direction and strength."""
    both = df.select(x, y).dropna()
    if method == "kendall":
        c = F.col
        parts = kendall_parts(both, [(x, y)])
        n = c("total")
        score = c("pairs") - c("ties_x") - c("ties_y") + c("ties_xy") - 2 * c("discordant")
        r = F.try_divide(score, F.sqrt((c("pairs") - c("ties_x")) * (c("pairs") - c("ties_y"))))
        m = n * (n - 1)
        spread = ((m * (2 * n + 5) - c("ties_x_v") - c("ties_y_v")) / 18 + F.try_divide(2 * c("ties_x") * c("ties_y"), m)
                  + F.try_divide(c("ties_x_3") * c("ties_y_3"), 9 * m * (n - 2)))
        out = parts.select(n.cast("long").alias("n"), r.alias("r"), normal_p_value(F.try_divide(score, F.sqrt(spread))).alias("p_value"))
    else:
        pairs = {"pearson": pearson_pairs, "spearman": spearman_pairs}[method](both, [x, y]).select(F.col("corr").alias("r"))
        row = attach_row(pairs, both.agg(F.count(F.lit(1)).alias("n")))
        dof = (F.col("n") - 2).cast("double")
        t = F.col("r") * F.sqrt(F.try_divide(dof, 1 - F.col("r") * F.col("r")))
        out = row.select("n", "r", t_p_value(t, dof).alias("p_value"))
    return out.select(F.lit(method).alias("method"), "*", F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none").alias("direction"),
                      bands(F.abs("r"), [(0.7, "strong"), (0.3, "moderate")], "weak").alias("strength"))


# --- regression ------------------------------------------------------------------------------


def ols_simple(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line: intercept, slope, r2, adjusted r2, rmse, slope t and p."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    row = df.where(cx.isNotNull() & cy.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r2"), F.regr_sxx(cy, cx).alias("sxx"), F.regr_syy(cy, cx).alias("syy"))
    n = F.col("n").cast("double")
    rss = F.col("syy") * (1 - F.col("r2"))
    t = F.try_divide(F.col("slope"), F.sqrt(F.try_divide(F.try_divide(rss, n - 2), F.col("sxx"))))
    return row.select("n", "intercept", "slope", "r2", (1 - F.try_divide((1 - F.col("r2")) * (n - 1), n - 2)).alias("adj_r2"),
                      F.sqrt(rss / n).alias("rmse"), t.alias("t"), t_p_value(t, n - 2).alias("p_value"))


def ols_residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    fit = ols_simple(df, x, y).select(F.col("intercept").alias("_a"), F.col("slope").alias("_b"))
    predicted = F.col("_a") + F.col("_b") * F.col(x)
    return attach_row(df.dropna(subset=[x, y]), fit).select(*df.columns, predicted.alias("predicted"), (F.col(y) - predicted).alias("residual"))


def _design(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Dummy-coded design matrix; the first level in lexical order is the base."""
    formula = RFormula(formula=f"{y} ~ {' + '.join([*numeric, *categorical])}", stringIndexerOrderType="alphabetDesc",
                       featuresCol="_x", labelCol="_y")
    rows = df.select(y, *numeric, *categorical).dropna()
    shaped = formula.fit(rows).transform(rows)
    attrs = shaped.schema["_x"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])]
    return shaped.select("_x", F.col("_y").cast("double").alias("_y")), names


def ols_multiple(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Multiple regression: one row per term with coefficient, error, t and p, plus r2 and adjusted r2."""
    design, names = _design(df, y, numeric, categorical)
    summary = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(design)
    s = summary.summary
    coefs = [*summary.coefficients.toArray().tolist(), summary.intercept]
    rows = [(n, float(c), float(e), float(t), float(p), float(s.r2), float(s.r2adj)) for n, c, e, t, p in zip(
        [*names, "intercept"], coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    frame = df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p_value double, r2 double, adj_r2 double")
    return frame.orderBy(F.abs("coefficient").desc())


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation: diagonal of the inverse correlation matrix (k * k numbers), bands at 5 and 10."""
    columns = list(columns)
    pairs = pearson_pairs(df.select(*columns).dropna(), columns)

    def invert(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.eye(len(columns))
        for a, b, r in zip(frame["var_1"], frame["var_2"], frame["corr"]):
            i, j = columns.index(a), columns.index(b)
            m[i, j] = m[j, i] = 0.0 if pd.isna(r) else r
        return pd.DataFrame({"column": columns, "vif": np.diag(np.linalg.pinv(m))})

    found = pairs.groupBy(F.lit(0).alias("_g")).applyInPandas(invert, "column string, vif double")
    return found.select("*", bands(F.col("vif"), [(10, "high"), (5, "moderate")], "low").alias("band"))


def binary_columns(df: DataFrame, most: int = 2) -> DataFrame:
    """Columns usable as an outcome: exactly two values (or 2..most classes)."""
    return distinct_profile(df).where((F.col("unique") >= 2) & (F.col("unique") <= most)).select("column", "unique")


def logit_regression(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = (), intercept: bool = True) -> DataFrame:
    """Binary logit: odds ratio with 95 % interval and p per term, and the pseudo r2. The higher value is the event."""
    rows = df.select(y, *numeric, *categorical).dropna()
    ends = rows.agg(F.max(y).alias("_event"), F.count_distinct(y).alias("_kinds"))
    coded = attach_row(rows, ends).where("_kinds = 2").withColumn("outcome", (F.col(y) == F.col("_event")).cast("double"))
    design, names = _design(coded.select("outcome", *numeric, *categorical), "outcome", numeric, categorical)
    fit = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y", fitIntercept=intercept).fit(design)
    s = fit.summary
    coefs = [*fit.coefficients.toArray().tolist()] + ([fit.intercept] if intercept else [])
    terms = names + (["intercept"] if intercept else [])
    pseudo = 1.0 - s.deviance / s.nullDeviance
    out = [(n, float(c), float(e), float(p), float(pseudo)) for n, c, e, p in zip(terms, coefs, s.coefficientStandardErrors, s.pValues)]
    frame = df.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, p_value double, pseudo_r2 double")
    half = 1.959963984540054 * F.col("std_error")
    return frame.select("*", F.exp("coefficient").alias("odds_ratio"), F.exp(F.col("coefficient") - half).alias("low"),
                        F.exp(F.col("coefficient") + half).alias("high"))


def confusion_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Binary counts and rates (0 where undefined)."""
    a, p = F.col(actual).cast("int") == 1, F.col(predicted).cast("int") == 1
    row = df.dropna(subset=[actual, predicted]).agg(
        F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(a & p).alias("tp"))
    safe = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    return row.select("tn", "fp", "fn", "tp", safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"),
                      recall.alias("recall"), safe(2 * precision * recall, precision + recall).alias("f1"))
