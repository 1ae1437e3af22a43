"""The block number, sizes and sessions must not change what an operator returns."""

import math

import pytest
from pyspark.sql import functions as F

from prismal import session
from prismal.operators import corr, features, frames, ml, stats, types
from prismal.operators.timeseries import diff
from prismal.plans.ordered import running_totals, value_ranks, with_blocks, with_previous


def plain(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.fixture()
def odd(spark):
    """Values with missing ones and NaN, and a unique text key with a long shared start and one outlier."""
    rows = [(i, None if i % 50 == 0 else float("nan") if i % 50 == 1 else float(i % 37), f"customer-number-{i:06d}" if i else "a") for i in range(1000)]
    return spark.createDataFrame(rows, "id long, v double, name string").repartition(6)


@pytest.mark.parametrize("blocks", [4, 50])
def test_blocks_lose_no_row(odd, blocks):
    counts = odd.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for run in (lambda b: running_totals(counts, "v", {"t": "n"}, blocks=b), lambda b: running_totals(counts, "v", {"t": "n"}, descending=True, blocks=b),
                lambda b: value_ranks(counts, "v", blocks=b), lambda b: with_previous(odd, "id", ["v"], blocks=b),
                lambda b: diff(odd.select(F.when(F.col("id") != 7, F.col("id")).alias("id"), "v"), "id", "v", blocks=b),
                lambda b: value_ranks(odd.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", blocks=b)):
        assert plain(run(blocks).collect()) == plain(run(1).collect())


def test_text_blocks_are_even_behind_a_shared_start(odd):
    placed, several = with_blocks(odd, "name", blocks=8)
    sizes = sorted(r["count"] for r in placed.groupBy("_block").count().collect())
    assert several and len(sizes) > 6 and sizes[-1] < 400


@pytest.mark.parametrize("blocks", [5])
def test_rank_correlations_are_the_same_in_blocks(spark, blocks):
    rows = [(float(i % 17), float((i * 7) % 23) if i % 9 else None, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for pairs in (corr.spearman_pairs, corr.kendall_pairs):
        one, many = ({(r.var_1, r.var_2): r["corr"] for r in pairs(df, blocks=b).collect()} for b in (1, blocks))
        assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_all_groups_values_and_points_count(spark):
    df = spark.createDataFrame([(f"g{i % 30}", float(i % 30) + (i % 7) / 10) for i in range(3000)], "g string, v double")
    assert stats.anova_oneway(df, "g", "v").first()["k"] == 30 and stats.tukey_hsd(df, "g", "v").count() == 30 * 29 // 2
    assert stats.levene_test(df, "g", "v").first()["k"] == 30 and stats.anova_oneway(df, "g", "v", most=5).first()["k"] == 5
    assert frames.point_sample(df.withColumn("k", F.monotonically_increasing_id()), ["v"], ["k"]).count() == 3000
    late = spark.createDataFrame([(i, "12" if i < 150 else "word") for i in range(200)], "i long, t string")
    assert types.inference_log(late, ["i"]).where("new_type = 'bigint'").count() == 0
    assert types.inference_log(late, ["i"], sample=100).where("new_type = 'bigint'").count() == 1


def test_sparse_labels_need_no_grid(spark):
    n = 5000
    df = spark.range(n).select(F.concat(F.lit("a"), "id").alias("a"), F.concat(F.lit("b"), (F.col("id") * 7 % n)).alias("b"))
    assert stats.chi2_cells(df, "a", "b").count() == n
    row = stats.chi2_independence(df, "a", "b").first()
    assert abs(row["statistic"] - n * (n - 1)) < 1e-3 * n and row["dof"] == (n - 1) ** 2


def test_two_by_two_with_an_empty_cell(spark):
    def yates(a, b, c, d):
        n, base = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
        return n * (abs(a * d - b * c) - n / 2) ** 2 / base

    df = spark.createDataFrame([("x", "p")] * 8 + [("x", "q")] * 3 + [("y", "q")] * 9, "a string, b string")
    assert abs(stats.chi2_independence(df, "a", "b").first()["statistic"] - yates(8, 3, 0, 9)) < 1e-9


def test_many_classes_split_and_encode(spark):
    df = spark.range(6000).select("id", F.concat(F.lit("c"), F.col("id") % 1500).alias("c"))
    split = ml.stratified_split(df, "c", ["id"], 0.25)
    assert split.count() == 6000 and {r["n"] for r in split.where("is_test").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()} == {1}
    assert features.one_hot_vector(df, "c").select("c_hot").first()[0].size == 1500


def test_ridge_has_the_usual_penalty(spark):
    xs = [((i * 37) % 500) / 100 for i in range(500)]
    df = spark.createDataFrame([(x, 3 * x + ((i * 13) % 7)) for i, x in enumerate(xs)], "x double, y double")
    mean = sum(xs) / 500
    sd = (sum((x - mean) ** 2 for x in xs) / 499) ** 0.5
    z, y = [(x - mean) / sd for x in xs], [r.y for r in df.collect()]
    weight = sum(a * (b - sum(y) / 500) for a, b in zip(z, y)) / (sum(a * a for a in z) + 50)
    model = ml.fit_regressor(df, "y", ["x"], kind="ridge", alpha=50.0)
    assert abs(model.stages[-1].coefficients[0] - weight) < 1e-6


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[3,2,1024]"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())


@pytest.mark.parametrize("blocks", [1, 4, 50])
def test_inversions_equal_brute_force(spark, blocks):
    import random

    rng = random.Random(blocks)
    rows = [(rng.randrange(2), rng.choice([0, 1, 5, 8, 63, 64, 65, 511, 512, 700]), float(rng.randrange(12)), rng.randrange(1, 4)) for _ in range(150)]
    want = {p: sum(a[3] * b[3] for a in rows for b in rows if a[0] == b[0] == p and a[1] < b[1] and a[2] > b[2]) for p in (0, 1)}
    df = spark.createDataFrame(rows, "pair int, r long, y double, n long")
    assert {r.pair: r.discordant for r in corr.discordant_pairs(df, blocks).collect()} == want


def test_rows_of_an_inversion_count_are_bounded(spark):
    """A row takes part once for each round of bits, not for each bit, and no border list enters the plan."""
    ranked = spark.range(1 << 12).select(F.lit(0).alias("pair"), F.col("id").alias("r"), F.col("id").cast("double").alias("y"), F.lit(1).cast("long").alias("n"))
    plan = corr.discordant_pairs(ranked, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Bucketizer" not in plan and "approx" not in plan and plan.count("Generate explode") == 1
    assert corr.discordant_pairs(ranked, 8).first()["discordant"] == 0
