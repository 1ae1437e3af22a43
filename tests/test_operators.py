"""Edge cases: missing values, ties, constant columns, empty tables, order, replay, inference and periods."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismal.functions import dist, text
from prismal.operators import anomaly, clean, explore, features, frames, profile, quality, stats, timeseries, types
from prismal.sources import tables


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", None), (None, 9.0)], "k string, v double")


@pytest.fixture(scope="module")
def constant(spark):
    return spark.createDataFrame([(5.0, "x")] * 6, "v double, s string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "v double, s string, t timestamp_ntz")


# --- distributions ---------------------------------------------------------------------------

@pytest.mark.parametrize("got,want", [
    (dist.t_two_sided(2.228138852, 10), 0.05), (dist.t_two_sided(12.70620474, 1), 0.05), (dist.f_upper(4.964602744, 1, 10), 0.05),
    (dist.f_upper(3.354130829, 2, 27), 0.05), (dist.chi2_upper(3.841458821, 1), 0.05), (dist.chi2_upper(18.30703805, 10), 0.05),
    (dist.normal_two_sided(1.959963985), 0.05), (dist.chi2_upper(200.0, 3), 4.2149e-43)])
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("q,k,dof", [(3.877, 3, 10), (3.486, 3, 30), (4.232, 5, 20), (2.772, 2, 1e6), (4.339, 4, 9 + 0.0)])
def test_studentized_range_five_percent_points(q, k, dof):
    want = 0.05 if dof != 9 else 0.0555
    assert dist.studentized_range_upper(q, k, dof) == pytest.approx(want, abs=0.006 if dof == 9 else 0.0006)


def test_adf_surface():
    assert dist.adf_p_value(-2.86154) == pytest.approx(0.05, abs=0.002)
    assert dist.adf_critical_value("5%", 100) == pytest.approx(-2.8909, abs=0.001)


def test_textbook_t_and_f(spark):
    one = spark.createDataFrame([(v,) for v in (5.1, 4.9, 5.6, 5.8, 6.0)], "x double")
    row = stats.ttest_one_sample(one, "x", 5.0).first()
    x = np.array([5.1, 4.9, 5.6, 5.8, 6.0])
    assert row["statistic"] == pytest.approx((x.mean() - 5) / (x.std(ddof=1) / 5**0.5))
    three = spark.createDataFrame([("a", float(v)) for v in (6, 8, 4, 5, 3, 4)] + [("b", float(v)) for v in (8, 12, 9, 11, 6, 8)]
                                  + [("c", float(v)) for v in (13, 9, 11, 8, 7, 12)], "g string, v double")
    row = stats.anova_oneway(three, "g", "v").first()
    assert row["statistic"] == pytest.approx(9.264705882) and row["p_value"] == pytest.approx(0.0023987, abs=1e-6)


def test_chi_square_uses_yates_for_two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 15
    row = stats.chi2_independence(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    assert row["dof"] == 1 and row["statistic"] == pytest.approx(5.5**2 * (1 / 16 + 1 / 14 + 1 / 24 + 1 / 21))


# --- profiles --------------------------------------------------------------------------------

def test_profiles_of_constant_and_empty_tables(constant, empty):
    row = profile.numeric_profile(constant).first()
    assert (row["std"], row["skew"], row["kurtosis"], row["outliers"], row["lower"]) == (0.0, 0.0, 0.0, 0, 5.0)
    row = profile.numeric_profile(empty).first()
    assert row["n_rows"] == 0 and row["mean"] is None and row["missing_pct"] is None
    assert profile.text_profile(empty).count() == 0
    assert profile.table_info(empty).first()["duplicate_rows"] == 0
    assert quality.quality_score(empty).first()["score"] == 0
    assert profile.missing_profile(empty).count() == 0
    assert profile.table_info(constant).first()["duplicate_rows"] == 5


def test_moments_match_pandas(spark):
    v = pd.Series(np.random.default_rng(2).gamma(2, 3, 200))
    row = profile.numeric_profile(spark.createDataFrame(v.to_frame("v"))).first()
    assert row["skew"] == pytest.approx(v.skew()) and row["kurtosis"] == pytest.approx(v.kurt()) and row["q95"] == pytest.approx(v.quantile(0.95))


def test_value_counts_skip_missing_and_top_value_breaks_ties(ties):
    assert {r["k"]: r["n"] for r in explore.value_counts_of(ties, "k").collect()} == {"a": 2, "b": 2}
    assert profile.text_profile(ties, ["k"]).first()["top"] == "a"
    assert profile.top_values(ties, "k", 1).collect()[-1]["value"] in ("a", "Others")


def test_group_rules(ties):
    rows = {r["k"]: r for r in explore.group_agg(ties, ["k"], ["v"], ["sum", "count", "median", "std"]).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["v_median"] == 1.5 and rows["b"]["v_std"] is None
    with pytest.raises(ValueError):
        explore.group_agg(ties, ["nope"], ["v"], ["sum"])
    with pytest.raises(ValueError):
        explore.group_agg(ties, ["k"], ["v"], ["geometric"])


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert explore.group_agg(df, ["k"], ["v"], ["sum"]).first()["v_sum"] == 0


def test_histogram_has_every_bin_and_keeps_the_maximum(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    assert [r["n"] for r in explore.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]


# --- cleaning --------------------------------------------------------------------------------

def test_duplicates_need_an_order_key(ties):
    for call in (clean.dedupe_first, clean.dedupe_last, clean.duplicate_rows):
        with pytest.raises(ValueError):
            call(ties, ["k"], [])


def test_dedupe_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 3, "y"), (None, 4, "z"), (None, 5, "w")], "k string, i int, s string")
    first = {r["k"]: (r["i"], r["s"]) for r in clean.dedupe_first(df, ["k"], ["i"]).collect()}
    last = {r["k"]: (r["i"], r["s"]) for r in clean.dedupe_last(df, ["k"], ["i"]).collect()}
    assert first == {"a": (1, None), "b": (3, "y"), None: (4, "z")} and last == {"a": (2, "x"), "b": (3, "y"), None: (5, "w")}
    assert [r["k"] for r in clean.dedupe_none(df, ["k"]).collect()] == ["b"]
    assert {r["i"] for r in clean.duplicate_rows(df, ["k"], ["i"]).collect()} == {2, 5}


def test_imputation_rules(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (4.0, None), (7.0, "b"), (None, "a")], "v double, s string")
    assert [r["v"] for r in clean.impute_median(df, ["v"]).collect()] == [1.0, 4.0, 4.0, 7.0, 4.0]
    assert clean.impute_mode(df, ["s"]).collect()[2]["s"] == "a"
    nothing = spark.createDataFrame([(None, 1.0)], "s string, v double")
    assert clean.impute_mode(nothing, ["s"]).first()["s"] == "Unknown"
    mostly = spark.createDataFrame([(None, 1.0), (None, None), ("x", 3.0)], "s string, v double")
    assert clean.auto_impute(mostly).columns == ["v"]


def test_capping_keeps_missing_and_removing_drops_them(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(500.0,), (None,)], "v double")
    capped = [r["v"] for r in clean.cap_outliers(df, ["v"]).collect()]
    assert capped.count(None) == 1 and max(v for v in capped if v is not None) < 500
    assert clean.remove_outliers(df, ["v"]).count() == 10
    assert clean.outlier_mask(df, "v").where("is_outlier").count() == 1
    with pytest.raises(ValueError):
        clean.outlier_mask(df, "v", "other")


def test_plan_replay_and_undo(spark):
    df = spark.createDataFrame([(" A ", 1.0), ("b", None)], "s string, v double")
    plan = clean.CleaningPlan(df).add("strip", "s").add("lowercase", "s").add("fill_mean", "v")
    assert [tuple(r) for r in plan.result().collect()] == [("a", 1.0), ("b", 1.0)]
    assert [r["s"] for r in plan.without(1).result().collect()] == ["A", "b"]
    assert plan.undo().result().collect()[1]["v"] is None and plan.reset().result().first()["s"] == " A "
    with pytest.raises(ValueError):
        plan.add("strip", "missing").result()
    with pytest.raises(ValueError):
        plan.add("explode everything").result()


@pytest.mark.parametrize("raw,want", [
    ([" A b!", "a_b", "1x", "", "__"], ["a_b", "a_b_1", "col_1x", "column", "column_1"]), (["Ünit (kg)"], ["ünit_kg"])])
def test_column_names(raw, want):
    assert clean.cleaned_names(raw) == want


# --- text, types, features -------------------------------------------------------------------

def test_text_rules(spark):
    df = spark.createDataFrame([("\t o'neil bob-smith \n",), ("a#1 b",), (None,)], "s string")
    got = df.select(text.title(text.strip("s")), text.remove_special("s"), text.clip(F.length("s"), F.lit(6), F.lit(8))).collect()
    assert got[0][0] == "O'Neil Bob-Smith" and got[1][1] == "a1 b" and got[1][2] == 6 and got[2][2] is None


def test_conversions(spark):
    df = spark.createDataFrame([(" 12.9 ", "yes"), ("12abc", "N"), ("1,000", "True"), ("", "maybe"), (None, None)], "s string, b string")
    got = df.select(types.to_numeric("s"), types.to_int("s"), types.to_boolean("b"), types.to_binary("b")).collect()
    assert [r[0] for r in got] == [12.9, None, None, None, None] and [r[1] for r in got] == [12, 0, 0, 0, 0]
    assert [r[2] for r in got] == [True, False, True, None, None] and [r[3] for r in got] == [1, 0, 1, None, None]


def test_inference(spark):
    rows = [(i, str(i % 3), "2024-01-%02d" % (i % 28 + 1), "yes" if i % 2 else "no", "free text %d" % i) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, n string, d string, b string, f string")
    log = {r["column"]: (r["new_type"], r["confidence"]) for r in types.inference_log(df, ["k"]).collect()}
    assert log == {"n": ("bigint", 0.9), "d": ("timestamp", 0.85), "b": ("boolean", 1.0)}
    assert dict(types.infer_types_enhanced(df, ["k"]).dtypes) == {"k": "int", "n": "bigint", "d": "timestamp", "b": "boolean", "f": "string"}
    assert dict(types.infer_types(df).dtypes)["n"] == "double" and dict(types.infer_types(df, strict=True).dtypes)["d"] == "timestamp"


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a.b",)], "s string")
    assert features.one_hot(df, "s", drop_first=True).columns == ["s", "s_a_b", "s_b"]
    codes = {r["s"]: r["s_encoded"] for r in features.label_encode(df, "s").collect()}
    assert codes == {None: 0, "a": 1, "a.b": 2, "b": 3}
    assert features.categories_of(df, "s") == ["a", "a.b", "b"]


def test_bins_match_pandas(spark):
    v = pd.Series([0.0, 1, 1, 2, 2, 2, 3, 7, 8, 10])
    df = spark.createDataFrame(v.to_frame("v"))
    width = pd.cut(v, np.linspace(0, 10, 6), labels=False, include_lowest=True) + 1
    got = features.bin_equal_width(df, "v", 5).toPandas()
    assert list(got["v_binned"]) == [f"Bin {i}" for i in width]
    freq = pd.qcut(v, 5, labels=False, duplicates="drop") + 1
    assert list(features.bin_equal_freq(df, "v", 5).toPandas()["v_binned"]) == [f"Bin {i}" for i in freq]
    with pytest.raises(ValueError):
        features.bin_custom(df, "v", [0, 0], ["x"])


def test_scaling_of_constant_column_is_missing(constant):
    for frame, c in ((features.minmax_scale(constant, ["v"]), "v_minmax"), (features.standard_scale(constant, ["v"]), "v_std"),
                     (features.robust_scale(constant, ["v"]), "v_robust")):
        assert frame.first()[c] is None


def test_boxcox_lambda_of_lognormal_data_is_near_zero(spark):
    v = np.random.default_rng(4).lognormal(0, 1, 3000)
    lam = features.boxcox_lambda(spark.createDataFrame(pd.DataFrame({"v": v})), "v")
    assert abs(lam) < 0.05


# --- series ----------------------------------------------------------------------------------

def daily(spark, values, start="2024-01-01"):
    days = pd.date_range(start, periods=len(values))
    return spark.createDataFrame([(d.date(), None if v is None else float(v)) for d, v in zip(days, values)], "period date, value double")


@pytest.mark.parametrize("freq,alias", [("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("Y", "YE")])
@pytest.mark.parametrize("how", ["mean", "sum", "count"])
def test_resample_matches_pandas(spark, freq, alias, how):
    rng = np.random.default_rng(6)
    stamps = pd.to_datetime("2022-11-30") + pd.to_timedelta(np.sort(rng.choice(500, 60, replace=False)), unit="D") + pd.Timedelta(hours=5)
    frame = pd.DataFrame({"ts": stamps, "v": rng.normal(0, 1, 60)})
    df = spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = timeseries.resample(df, "ts", "v", freq, how).toPandas().sort_values("period")
    want = getattr(frame.set_index("ts")["v"].resample(alias), how)()
    assert [str(p) for p in got["period"]] == [str(p.date()) for p in want.index]
    np.testing.assert_allclose(got["value"].astype(float), want.to_numpy(float), equal_nan=True)


def test_rolling_and_decomposition(spark):
    season = [0, 2, 4, 1]
    series = daily(spark, [10 + i + season[i % 4] for i in range(24)])
    roll = timeseries.rolling_mean(series, 3).orderBy("period").collect()
    assert roll[1]["rolling"] is None and roll[2]["rolling"] == pytest.approx(13.0)
    parts = timeseries.seasonal_decompose(series, 4)
    rows = parts.orderBy("period").collect()
    assert rows[0]["trend"] is None and rows[10]["resid"] == pytest.approx(0, abs=1e-9)
    assert timeseries.seasonal_strength(parts).first()["label"] == "strong"
    assert timeseries.seasonal_lag_hint(series, 10).count() <= 1


def test_autocorrelations(spark):
    rng = np.random.default_rng(8)
    x = np.zeros(400)
    for i in range(1, 400):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    series = daily(spark, x)
    r = {a["lag"]: a["acf"] for a in timeseries.acf(series, 10).collect()}
    c = x - x.mean()
    assert r[3] == pytest.approx((c[3:] @ c[:-3]) / (c @ c))
    p = {a["lag"]: a["pacf"] for a in timeseries.pacf(series, 10).collect()}
    assert p[1] == pytest.approx(r[1]) and p[2] == pytest.approx((r[2] - r[1] ** 2) / (1 - r[1] ** 2))
    assert timeseries.adf_test(series).first()["stationary"]
    walk = timeseries.adf_levels(daily(spark, np.cumsum(rng.normal(0, 1, 400)))).collect()
    assert walk[0]["p_value"] > 0.05 and walk[1]["difference"] == 1 and walk[1]["stationary"]


def test_frequency_trend_and_forecast(spark):
    weekly = spark.createDataFrame([(dt.date(2024, 1, 7) + dt.timedelta(7 * i), float(i)) for i in range(12)], "period date, value double")
    assert timeseries.infer_frequency(weekly, "period").first()["frequency"] == "W"
    out = timeseries.forecast_drift(weekly, 3, "W").orderBy("i").collect()
    assert [r["forecast"] for r in out] == [12.0, 13.0, 14.0] and out[0]["period"] == dt.date(2024, 3, 31)
    assert timeseries.forecast_drift(weekly.limit(5), 3, "W").count() == 0
    assert timeseries.forecast_drift(weekly, 99, "W").count() == 99
    with pytest.raises(ValueError):
        timeseries.forecast_drift(weekly, 0, "W")
    line = timeseries.linear_trend(weekly).first()
    assert line["slope"] == pytest.approx(1.0) and line["direction"] == "increasing"


# --- others ----------------------------------------------------------------------------------

def test_anomalies_of_constant_data_are_none(constant):
    assert anomaly.anomalies_iqr(constant, "v").count() == 0 and anomaly.anomalies_zscore(constant, "v").count() == 0


def test_not_equals_keeps_missing_and_unknown_filters_are_skipped(ties):
    kept = explore.filter_multi(ties, {"k": {"type": "categorical", "operator": "not_equals", "value": "a"}, "zzz": {"type": "numeric", "value": 1}})
    assert {r["k"] for r in kept.collect()} == {"b", None}


def test_box_and_facets(ties):
    row = frames.box(ties, "v").first()
    assert row["n"] == 4 and row["outliers"] == 1 and row["whisker_high"] == 3.0
    assert frames.facets(ties, "k", "v", 4).count() == 8


def test_scan_rules(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,NA,\n2,,3.5\n")
    rows = tables.scan_csv(spark, str(path)).collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [(1, "NA", None), (2, None, 3.5)]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert tables.normalize_missing(nan).where("v IS NULL").count() == 1
    array = tmp_path / "x.json"
    array.write_text('[{"a": 1}, {"a": null}]')
    assert tables.scan_json(spark, str(array), multi_line=True).count() == 2
    with pytest.raises(ValueError):
        tables.export(nan, str(tmp_path / "y"), "xlsx")
