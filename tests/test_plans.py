"""The shared plan shapes, each checked against pandas on data with ties, gaps and one hot value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismal.plans import quantiles as qt
from prismal.plans.counts import mode_row, modes
from prismal.plans.graph import components
from prismal.plans.ordered import positions, running_totals, value_ranks, with_previous
from prismal.plans.sizing import estimated_bytes, fits_value_map, inputs_fit_one_task


def skewed(n=6000, seed=3):
    """A third of the rows share one key, a third of the values are equal, some are missing."""
    rng = np.random.default_rng(seed)
    v = rng.lognormal(3, 1.5, n).round(2)
    v[rng.random(n) < 0.33] = 7.5
    v[rng.random(n) < 0.1] = np.nan
    k = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdefgh"), n))
    return pd.DataFrame({"id": np.arange(n), "k": k, "v": v, "w": rng.normal(0, 1, n)})


def to_spark(spark, frame):
    df = spark.createDataFrame(frame)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [50_000, 400])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_spread_quantiles_equal_pandas(spark, monkeypatch, accuracy, keys):
    monkeypatch.setattr(qt, "SKETCH_ACCURACY", accuracy)
    frame = skewed()
    got = qt.quantiles(to_spark(spark, frame), ["v", "w"], PROBS, keys, spread=True).toPandas()
    groups = frame.groupby(keys) if keys else [((), frame)]
    assert len(got) == len(groups)
    for name, part in groups:
        row = got[got["k"] == name[0]].iloc[0] if keys else got.iloc[0]
        for c in ("v", "w"):
            np.testing.assert_allclose(row[f"q_{c}"], part[c].quantile(PROBS).to_numpy(), rtol=1e-12)


def test_quantiles_keep_order_of_probabilities_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    for spread in (False, True):
        rows = {r["k"]: r["q_v"] for r in qt.quantiles(df, ["v"], [0.5, 0.0], ["k"], spread=spread).collect()}
        assert rows["a"] == [2.0, 1.0]
        assert rows["b"] in (None, [None, None])


def test_quantile_keys_may_use_inner_names(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 5.0)], "column string, i int, v double")
    assert qt.quantiles(df, ["v"], [0.5], ["column", "i"], spread=True).first()["q_v"] == [3.0]


@pytest.mark.parametrize("blocks", [1, 2, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, blocks, descending):
    frame = skewed(800).dropna().groupby(["k", "v"], as_index=False).agg(n=("id", "size"))
    got = running_totals(to_spark(spark, frame), "v", {"upto": "n"}, ["k"], descending, blocks).toPandas()
    want = frame.sort_values("v", ascending=not descending)
    want["upto"] = want.groupby("k")["n"].cumsum()
    both = got.merge(want, on=["k", "v", "n"], suffixes=("", "_want"))
    assert len(both) == len(frame) and (both["upto"] == both["upto_want"]).all()


@pytest.mark.parametrize("blocks", [1, 4])
def test_previous_row(spark, blocks):
    frame = skewed(500)
    got = with_previous(to_spark(spark, frame), "id", ["w"], blocks=blocks).toPandas().sort_values("id")
    np.testing.assert_allclose(got["prev_w"], frame["w"].shift(), equal_nan=True)


@pytest.mark.parametrize("blocks", [1, 6])
def test_value_ranks_match_pandas(spark, blocks):
    frame = skewed(900).dropna()
    counts = to_spark(spark, frame).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = value_ranks(counts, "v", blocks=blocks).toPandas().set_index("v")
    for method, column in (("average", "avg_rank"), ("dense", "dense_rank")):
        want = pd.Series(frame["v"].rank(method=method).to_numpy(), index=frame["v"].to_numpy()).groupby(level=0).first()
        np.testing.assert_allclose(got[column].sort_index(), want.sort_index())


def test_joins_are_not_estimated(spark, tmp_path):
    """Catalyst multiplies sizes at a join; what decides is the size of the files, so a 100 times larger estimate changes nothing."""
    spark.range(2000).select("id", (F.col("id") % 3).alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    both = df.join(df.withColumnRenamed("id", "other").hint("merge"), "k").join(df.withColumnRenamed("id", "third").hint("merge"), "k")
    spark.conf.set("spark.prismal.oneTaskBytes", str(1 << 20))
    try:
        assert estimated_bytes(both) > 100 * (1 << 20) and inputs_fit_one_task(both)
    finally:
        spark.conf.unset("spark.prismal.oneTaskBytes")


def test_positions_follow_the_order(spread):
    rows = [(None if i % 11 == 0 else f"s{i % 3}", i * 7919 % 1000) for i in range(3000)]
    got = positions(spread.createDataFrame(rows, "s string, i long").repartition(5), ["s", "i"], "at").orderBy("at").collect()
    assert [r.at for r in got] == list(range(3000))
    assert [(r.s, r.i) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert positions(spread.createDataFrame([], "s string, i long"), ["s"], "at").count() == 0


def test_ranks_over_text_and_dates(spark):
    words = [f"Customer#{i:05d}" for i in range(300)] + ["éa", "zz"]
    counts = spark.createDataFrame([(w, 1) for w in words], "v string, n long")
    got = value_ranks(counts, "v", blocks=5).toPandas().sort_values("dense_rank")
    assert list(got["v"]) == sorted(words, key=lambda w: w.encode())
    days = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("v"), F.lit(1).cast("long").alias("n"))
    got = value_ranks(days, "v", blocks=3).toPandas().sort_values("v")
    assert list(got["dense_rank"]) == list(range(1, 101))


def test_mode_ties_take_the_lowest_value(spark):
    df = spark.createDataFrame([(10.0, "b"), (10.0, "a"), (9.0, "a"), (9.0, "b"), (None, None)], "x double, s string")
    assert mode_row(df, ["x", "s"]).first().asDict() == {"m_x": 9.0, "m_s": "a"}
    assert {r["column"]: r["unique"] for r in modes(df, ["s"]).collect()} == {"s": 2}


def test_components_on_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    hub = [(100, i) for i in range(101, 160)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 500]], "node long")
    got = {r["node"]: r["root"] for r in components(nodes, spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[500] == 500


def test_size_checks(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < estimated_bytes(df) < 1_000_000 and fits_value_map(df) and inputs_fit_one_task(df)
    spark.conf.set("spark.prismal.oneTaskBytes", "1000")
    try:
        assert not inputs_fit_one_task(df)
        spark.conf.set("spark.prismal.quantileBytes", "1000")
        assert not fits_value_map(df)
    finally:
        spark.conf.unset("spark.prismal.oneTaskBytes")
        spark.conf.unset("spark.prismal.quantileBytes")


def test_profiles_read_the_table_three_times_at_most(spark):
    """Counts how often the rows of the source are really read, over all jobs of an operator."""
    from prismal.operators import insights, profile, quality

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    frame = skewed(600).assign(t=lambda f: f["k"] + "x")
    source = to_spark(spark, frame).coalesce(1)
    df = source.mapInPandas(seen, source.schema)
    for run in (profile.describe_numeric, profile.full_profile, quality.quality_score, quality.quality_issues, quality.cleaning_issues,
                quality.cleaning_suggestions, insights.dataset_insights):
        before = reads.value
        run(df).collect()
        assert 1 <= reads.value - before <= 3, run.__name__


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_settled_quantiles_take_no_further_pass(spark, capsys, monkeypatch, keys):
    """Where both ends of a bracket are one value no row is spread; groups meet their brackets without being ordered by key."""
    monkeypatch.setattr(qt, "SKETCH_ACCURACY", 400)
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(4.0).alias("v"))
    found = qt.quantiles(df, ["v"], [0.1, 0.25, 0.75], keys, spread=True)
    assert found.first()["q_v"] == [1.0, 1.0, 4.0]
    found.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan if not keys else "BroadcastHashJoin" in plan
