"""Series by calendar period and what is read from them.

``resample`` turns rows of any number into one row per period (and series key);
the operators after it take that frame, whose length is bounded by the calendar.
Operators on raw rows (``diff``, ``first_last_change``) avoid a global window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions import dates
from prismal.functions.dist import ADF_CRITICAL, adf_critical_value, adf_p_value, t_p_value
from prismal.functions.text import bands
from prismal.plans.ordered import with_previous
from prismal.plans.scalars import attach_row

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _series(keys: Sequence[str]) -> Window:
    """Window over one period series (calendar-bounded rows per key)."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("period")


def resample(df: DataFrame, ts: str, value: str, freq: str = "M", how: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """One row per calendar period from the first to the last, labelled by its last day.

    Empty periods appear with a missing value (0 for sum and count).
    """
    keys = list(keys)
    rows = df.where(F.col(ts).isNotNull()).select(*keys, dates.period_end(ts, freq).alias("period"), F.col(value).alias("v"))
    found = rows.groupBy(*keys, "period").agg(AGGREGATES[how]("v").cast("double").alias("value"))
    span = found.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    steps = F.sequence(F.date_trunc("month", "lo").cast("date") if freq in "MQY" else F.col("lo"), F.col("hi"), dates.period_step(freq))
    label = F.last_day("step") if freq in "MQY" else F.col("step")
    spine = span.select(*keys, F.explode(steps).alias("step")).select(*keys, label.cast("date").alias("period"))
    filled = F.coalesce("value", F.lit(0.0)) if how in ("sum", "count") else F.col("value")
    return spine.join(found, [*keys, "period"], "left").select(*keys, "period", filled.alias("value"))


def rolling_mean(series: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the last k periods, missing until k values are present."""
    w = _series(keys).rowsBetween(-(k - 1), 0)
    return series.withColumn("rolling", F.when(F.count("value").over(w) == k, F.avg("value").over(w)))


def _indexed(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.where("value IS NOT NULL").withColumn("i", (F.row_number().over(_series(keys)) - 1).cast("double"))


def linear_trend(series: DataFrame) -> DataFrame:
    """Least-squares line over the position: slope, intercept, r2, p-value of the slope, direction."""
    i, v = F.col("i"), F.col("value")
    row = _indexed(series, ()).agg(
        F.count("i").alias("n"), F.regr_slope(v, i).alias("slope"), F.regr_intercept(v, i).alias("intercept"), F.regr_r2(v, i).alias("r2"))
    dof = (F.col("n") - 2).cast("double")
    t = F.sqrt(F.try_divide(F.col("r2") * dof, 1 - F.col("r2")))
    return row.select(
        "n", "slope", "intercept", "r2", F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat").alias("direction"),
        t_p_value(t, dof).alias("p_value"))


def trend_line(series: DataFrame) -> DataFrame:
    fit = linear_trend(series).select("slope", "intercept")
    return attach_row(_indexed(series, ()), fit).select("period", "value", (F.col("intercept") + F.col("slope") * F.col("i")).alias("trend"))


def year_over_year(df: DataFrame, ts: str, value: str, part: str) -> DataFrame:
    """Mean value per calendar part and year, long form."""
    p = dates.PARTS[part](F.col(ts)).cast("int")
    return df.groupBy(p.alias("part"), F.year(ts).alias("year")).agg(F.avg(value).alias("value"))


def year_over_year_wide(df: DataFrame, ts: str, value: str, part: str, years: Sequence[int]) -> DataFrame:
    return year_over_year(df, ts, value, part).groupBy("part").pivot("year", list(years)).agg(F.first("value"))


def first_last_change(df: DataFrame, ts: str, value: str, ties: Sequence[str]) -> DataFrame:
    """First and last value in time, change, change in percent, and a trend label beyond 5 %."""
    at = F.struct(F.col(ts), *[F.col(c) for c in ties])
    row = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    change = F.col("last_value") - F.col("first_value")
    pct = F.try_divide(change * 100, F.col("first_value"))
    label = F.when(pct > 5, "upward").when(pct < -5, "downward").otherwise("stable")
    return row.select("first_value", "last_value", change.alias("change"), pct.alias("change_pct"), label.alias("trend"))


def diff(df: DataFrame, order: str, value: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """First difference along a unique order column; blocks replace a single global window."""
    return with_previous(df, order, [value], keys, blocks=blocks).withColumn("diff", F.col(value) - F.col(f"prev_{value}"))


def infer_frequency(df: DataFrame, ts: str) -> DataFrame:
    """Modal gap between neighbouring dates, its share, and the calendar frequency it stands for."""
    days = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("d")).agg(F.lit(1).alias("_one"))
    w = Window.partitionBy(F.lit(0)).orderBy("d")  # one row per calendar day
    gaps = days.select(F.date_diff("d", F.lag("d").over(w)).alias("gap")).where("gap IS NOT NULL")
    counts = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("gap").alias("gap"))).alias("best"),
                     F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    gap, share = F.col("best.gap"), -F.col("best.neg") / F.col("total")
    freq = (F.when(gap == 1, "D").when(gap == 7, "W").when(gap.between(28, 31), "M").when(gap.between(90, 92), "Q")
            .when(gap.between(365, 366), "Y").otherwise(F.concat(gap.cast("string"), F.lit("D"))))
    return row.select(gap.alias("modal_gap"), freq.alias("frequency"), share.alias("share"), ((F.col("kinds") == 1) | (share > 0.8)).alias("regular"))


# --- seasonality -----------------------------------------------------------------------------


def seasonal_decompose(series: DataFrame, period: int, model: str = "additive", keys: Sequence[str] = ()) -> DataFrame:
    """Centred moving-average trend, period-mean seasonal and residual; the edges have no trend."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    times = model == "multiplicative"
    w, half = _series(keys), period // 2
    rows = _indexed(series, keys)
    if period % 2:
        frame = w.rowsBetween(-half, half)
        trend = F.when(F.count("value").over(frame) == period, F.avg("value").over(frame))
    else:
        inner = w.rowsBetween(-(half - 1), half - 1)
        ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
        trend = (ends / 2 + F.sum("value").over(inner)) / period
    rows = rows.withColumn("trend", trend).withColumn("slot", (F.col("i") % period).cast("int"))
    detrended = F.try_divide("value", "trend") if times else F.col("value") - F.col("trend")
    slots = rows.groupBy(*keys, "slot").agg(F.avg(detrended).alias("raw"))
    every = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per slot
    centre = F.avg("raw").over(every)
    slots = slots.select(*keys, "slot", (F.try_divide(F.col("raw"), centre) if times else F.col("raw") - centre).alias("seasonal"))
    joined = rows.join(slots, [*keys, "slot"])
    resid = F.try_divide(F.try_divide("value", "trend"), F.col("seasonal")) if times else F.col("value") - F.col("trend") - F.col("seasonal")
    return joined.select(*keys, "period", "value", "i", "slot", "trend", "seasonal", resid.alias("resid"))


def seasonal_strength(parts: DataFrame, model: str = "additive") -> DataFrame:
    """max(0, 1 - var(resid) / (var(seasonal) + var(resid))) with a label; logs for multiplicative parts."""
    part = (lambda c: F.log(c)) if model == "multiplicative" else F.col
    row = parts.where("resid IS NOT NULL").agg(F.var_samp(part("resid")).alias("r"), F.var_samp(part("seasonal")).alias("s"))
    strength = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("r"), F.col("s") + F.col("r")))
    return row.select(strength.alias("strength"), bands(strength, [(0.7, "strong"), (0.3, "moderate")], "weak").alias("label"))


def seasonal_pattern(parts: DataFrame, part: str) -> DataFrame:
    """Mean seasonal component by month, quarter, weekday or position."""
    by = F.col("slot") if part == "position" else dates.PARTS[part](F.col("period")).cast("int")
    return parts.groupBy(by.alias("part")).agg(F.avg("seasonal").alias("seasonal"))


# --- autocorrelation -------------------------------------------------------------------------


def acf(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """Autocorrelation (biased, full-sample mean) per lag, flagged beyond 1.96 / sqrt(n). All lags in one pass."""
    rows = series.where("value IS NOT NULL")
    centred = attach_row(rows, rows.agg(F.avg("value").alias("_m"))).select("period", (F.col("value") - F.col("_m")).alias("d"))
    w = _series(())
    lagged = centred.select("d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, max_lag + 1)])
    sums = lagged.agg(F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("d0"),
                      *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    entries = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[
        F.struct(F.lit(k).alias("lag"), F.try_divide(f"s{k}", "d0").alias("acf")) for k in range(1, max_lag + 1)])
    out = sums.select("n", F.inline(entries)).where("acf IS NOT NULL AND lag < n")
    return out.select("lag", "acf", ((F.col("lag") > 0) & (F.abs("acf") > 1.96 / F.sqrt("n"))).alias("significant"), "n")


def pacf(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """Partial autocorrelation from the autocorrelations by the Durbin-Levinson recursion (one short row set)."""

    def recurse(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.sort_values("lag")["acf"].to_numpy()
        out, phi, spread = [1.0], np.zeros(0), 1.0
        for k in range(1, len(r)):
            last = (r[k] - phi @ r[k - 1:0:-1]) / spread if k > 1 else r[1]
            phi = np.append(phi - last * phi[::-1], last)
            spread *= 1.0 - last * last
            out.append(float(last))
        n = float(frame["n"].iloc[0])
        return pd.DataFrame({"lag": range(len(out)), "pacf": out, "significant": [k > 0 and abs(v) > 1.96 / n**0.5 for k, v in enumerate(out)]})

    return acf(series, max_lag).groupBy(F.lit(0).alias("_g")).applyInPandas(recurse, "lag int, pacf double, significant boolean")


def seasonal_lag_hint(series: DataFrame, max_lag: int = 40) -> DataFrame:
    """Modal spacing of the significant lags (the smallest on ties)."""
    w = Window.partitionBy(F.lit(0)).orderBy("lag")  # at most max_lag rows
    spaces = acf(series, max_lag).where("significant").select((F.col("lag") - F.lag("lag").over(w)).alias("space")).where("space IS NOT NULL")
    return spaces.groupBy("space").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "space").limit(1).select("space")


# --- stationarity ----------------------------------------------------------------------------


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    rss = float(resid @ resid)
    cov = np.linalg.pinv(x.T @ x) * rss / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(cov)), rss


def dickey_fuller(values: np.ndarray, max_lag: int | None = None) -> tuple[float, int, int]:
    """Augmented Dickey-Fuller statistic with a constant, lag order by AIC on a common sample."""
    n = len(values)
    most = int(np.ceil(12.0 * (n / 100.0) ** 0.25)) if max_lag is None else max_lag
    most = max(0, min(most, n // 2 - 2))
    step = np.diff(values)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        y = step[skip:]
        parts = [values[skip:-1], np.ones(len(y))] + [step[skip - j:len(step) - j] for j in range(1, lags + 1)]
        return y, np.column_stack(parts)

    def aic(lags: int) -> float:
        y, x = design(lags, most)
        rss = max(_ols(y, x)[2], 1e-300)
        return len(y) * (np.log(2 * np.pi * rss / len(y)) + 1) + 2 * x.shape[1]

    lags = min(range(most + 1), key=aic)
    y, x = design(lags, lags)
    beta, err, _ = _ols(y, x)
    return float(beta[0] / err[0]), lags, len(y)


def adf_test(series: DataFrame, keys: Sequence[str] = (), difference: int = 0) -> DataFrame:
    """Unit-root test per series: statistic, p-value, critical values. One calendar-bounded series per group."""
    keys = list(keys)

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("period")["value"].dropna().to_numpy(dtype="float64")
        values = np.diff(values, difference) if difference else values
        tau, lags, n = dickey_fuller(values)
        row = {**{k: frame[k].iloc[0] for k in keys}, "statistic": tau, "p_value": adf_p_value(tau), "lags": lags, "n": n,
               **{f"critical_{lv[:-1]}": adf_critical_value(lv, n) for lv in ADF_CRITICAL}}
        return pd.DataFrame([row]).assign(stationary=row["p_value"] < 0.05)

    kinds = dict(series.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [
        "statistic double", "p_value double", "lags int", "n int", "critical_1 double", "critical_5 double", "critical_10 double", "stationary boolean"])
    grouped = series.groupBy(*keys) if keys else series.groupBy(F.lit(0).alias("_g"))
    return grouped.applyInPandas(test, schema)


def adf_levels(series: DataFrame) -> DataFrame:
    """The test on the series and, where it stays above 5 %, on its first difference."""
    level = adf_test(series).withColumn("difference", F.lit(0))
    first = adf_test(series, difference=1).withColumn("difference", F.lit(1))
    needed = level.select(F.col("p_value").alias("_p"))
    return level.unionByName(attach_row(first, needed).where("_p >= 0.05").drop("_p"))


# --- forecast --------------------------------------------------------------------------------


def _next_period(last: Column, i: Column, freq: str) -> Column:
    if freq == "D":
        return F.date_add(last, i)
    if freq == "W":
        return F.date_add(last, i * 7)
    return F.last_day(F.add_months(last, i * {"M": 1, "Q": 3, "Y": 12}[freq]))


def forecast_drift(series: DataFrame, horizon: int, freq: str) -> DataFrame:
    """Last value plus i times the mean step of the last five periods, with a band of 15 %.

    Fewer than ten values give no rows.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    known = series.where("value IS NOT NULL")
    last5 = known.orderBy(F.col("period").desc()).limit(5)
    row = last5.agg(F.max("period").alias("last"), F.max_by("value", "period").alias("v1"), F.min_by("value", "period").alias("v5"))
    row = attach_row(row, known.agg(F.count(F.lit(1)).alias("n"))).where("n >= 10")
    value = F.col("v1") + F.col("i") * (F.col("v1") - F.col("v5")) / 4
    return row.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i")).select(
        "i", _next_period(F.col("last"), F.col("i"), freq).alias("period"), value.alias("forecast"),
        (value - F.abs(value) * 0.15).alias("lower"), (value + F.abs(value) * 0.15).alias("upper"), F.col("v1").alias("last_value"))


def forecast_summary(forecast: DataFrame) -> DataFrame:
    row = forecast.agg(F.max("last_value").alias("last_value"), F.max_by("forecast", "i").alias("end_value"), F.max("forecast").alias("max_value"))
    share = lambda c: F.try_divide((F.col(c) - F.col("last_value")) * 100, F.col("last_value"))
    return row.select("last_value", "end_value", share("end_value").alias("end_pct"), "max_value", share("max_value").alias("max_pct"))


def time_sorted(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.select(ts, value).dropna().orderBy(ts)
