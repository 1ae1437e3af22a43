"""Correlation, neighbours, density clusters and models against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismal.operators import anomaly, cluster, corr, density, explore, frames, ml, neighbours, stats
from prismal.plans import ordered, space
from tests.test_plans import skewed, to_spark


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())


@pytest.mark.parametrize("blocks", [None, 4])
def test_rank_correlations_with_ties_and_gaps(spark, blocks):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 30, 400).astype(float), "b": rng.normal(0, 1, 400).round(1)})
    frame["c"] = frame["a"] + rng.normal(0, 8, 400)
    frame.loc[::7, "b"] = np.nan
    df = to_spark(spark, frame)
    spearman = {(r[0], r[1]): r[2] for r in corr.spearman_pairs(df, ["a", "b", "c"], blocks=blocks).collect()}
    kendall = {(r[0], r[1]): r[2] for r in corr.kendall_pairs(df, ["a", "b", "c"], blocks=blocks).collect()}
    pearson = {(r[0], r[1]): r[2] for r in corr.pearson_pairs(df, ["a", "b", "c"]).collect()}
    for (x, y), got in kendall.items():
        both = frame[[x, y]].dropna()
        assert got == pytest.approx(brute_tau(both[x].to_numpy(), both[y].to_numpy()), abs=1e-12)
        assert spearman[x, y] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-12)
        assert pearson[x, y] == pytest.approx(both[x].corr(both[y]), abs=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    for method in ("pearson", "spearman", "kendall"):
        assert corr.correlation_pairs(df, ["a", "b"], method).first()["corr"] is None
    with pytest.raises(ValueError):
        corr.correlation_pairs(df, ["a", "b"], "other")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_nearest_equals_brute_force_with_a_hot_spot(spark, metric):
    rng = np.random.default_rng(1)
    ref = rng.normal(0, 1, (600, 3))
    ref[:200] = ref[0]
    qs = np.vstack([rng.normal(0, 1.5, (60, 3)), np.repeat(ref[:1], 20, axis=0)])
    names = ["x", "y", "z"]
    r = spark.createDataFrame(pd.DataFrame(ref, columns=names).assign(r=np.arange(600)))
    q = spark.createDataFrame(pd.DataFrame(qs, columns=names).assign(q=np.arange(80)))
    got = neighbours.nearest(q, r, names, 5, "q", "r", metric, slice_rows=40, box_rows=50).toPandas()
    gap = qs[:, None, :] - ref[None, :, :]
    far = np.sqrt((gap**2).sum(axis=2)) if metric == "euclidean" else np.abs(gap).sum(axis=2)
    for i in range(80):
        want = np.lexsort((np.arange(600), far[i]))[:5]
        mine = got[got["q"] == i].sort_values("rank")
        assert list(mine["r"]) == list(want)
        np.testing.assert_allclose(mine["distance"], far[i][want])


@pytest.mark.parametrize("k, rows", [(1, 400), (40, 400), (9, 7), (3, 0)])
def test_nearest_over_uneven_boxes(spark, k, rows):
    """Boxes with fewer rows than k, equal points in crowded boxes, queries far from all boxes, fewer rows than k, no rows."""
    rng = np.random.default_rng(3)
    ref = np.round(np.exp(rng.normal(0, 2, (rows, 2))), 1)
    ref[rows // 2:, 1] = 1.5
    qs = np.vstack([np.round(np.exp(rng.normal(0, 2, (30, 2))), 1), [[-1e6, 4.0], [1e9, -1e9]]])
    r = spark.createDataFrame(pd.DataFrame(ref, columns=["x", "y"]).assign(r=np.arange(rows)), "x double, y double, r long")
    q = spark.createDataFrame(pd.DataFrame(qs, columns=["x", "y"]).assign(q=np.arange(32)))
    found = neighbours.nearest(q, r, ["x", "y"], k, "q", "r", slice_rows=25, box_rows=3)
    assert "map(" not in found._jdf.queryExecution().toString()
    got = sorted((p["q"], p["rank"], p["r"]) for p in found.collect())
    far = np.sqrt(((qs[:, None, :] - ref[None, :, :]) ** 2).sum(axis=2))
    assert got == [(i, n + 1, j) for i in range(32) for n, j in enumerate(np.lexsort((np.arange(rows), far[i]))[:k])]


def test_boxes_hold_few_points_unless_equal(spark):
    rows = [(i, float(i % 7), 2.0, float(i) if i < 500 else 0.0) for i in range(900)] + [(1000 + i, 3.0, 3.0, 3.0) for i in range(60)]
    tree = space.box_tree(spark.createDataFrame(rows, "r long, x double, y double, z double"), ["x", "y", "z"], 20)
    placed = tree.rows.groupBy("_box").agg({"r": "count"}).toDF("_box", "n")
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, tree.leaves.collect()))
    held = tree.rows.toPandas()
    assert len(held) == 960 and len(tree.levels) > 2
    assert all(len(box) <= 20 or len(box.drop(columns=["r", "_box"]).drop_duplicates()) == 1 for _, box in held.groupby("_box"))


def test_knn_vote_and_mean(spark):
    train = spark.createDataFrame([(1, 0.0, "b", 1.0), (2, 1.0, "a", 3.0), (3, 9.0, "a", 5.0)], "t long, x double, c string, v double")
    q = spark.createDataFrame([(7, 0.0), (8, 0.4)], "q long, x double")
    votes = {r["q"]: r["prediction"] for r in neighbours.knn_classify(q, train, ["x"], "c", 2, "q", "t").collect()}
    assert votes == {7: "a", 8: "a"}  # one vote each: the lowest class wins
    means = {r["q"]: r["prediction"] for r in neighbours.knn_regress(q, train, ["x"], "v", 2, "q", "t", weights="distance").collect()}
    assert means[7] == 1.0 and means[8] == pytest.approx((1 / 0.4 * 1 + 1 / 0.6 * 3) / (1 / 0.4 + 1 / 0.6))


def brute_dbscan(p, eps, m):
    near = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= m
    label = np.full(len(p), -1)
    nxt = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo, label[i] = [i], nxt
        while todo:
            j = todo.pop()
            for o in np.flatnonzero(near[j] & core & (label < 0)):
                label[o] = nxt
                todo.append(o)
        nxt += 1
    for i in np.flatnonzero(~core):
        hits = label[near[i] & core]
        label[i] = hits.min() if len(hits) else -1
    return label, core


@pytest.mark.parametrize("d,limit", [(1, 4096), (2, 4096), (2, 16), (3, 64)])
def test_dbscan_equals_brute_force(spark, d, limit):
    rng = np.random.default_rng(d * 10 + limit)
    p = np.vstack([rng.normal(0, 0.15, (150, d)), rng.normal(1.2, 0.2, (120, d)), rng.uniform(-1, 3, (60, d)), np.full((80, d), 0.3)])
    frame = pd.DataFrame(p, columns=[f"x{i}" for i in range(d)]).assign(k=np.arange(len(p)))
    got = density.dbscan(spark.createDataFrame(frame), [f"x{i}" for i in range(d)], "k", 0.18, 5, pair_limit=limit).toPandas().sort_values("k")
    label, core = brute_dbscan(p, 0.18, 5)
    assert list(got["is_core"]) == list(core)
    assert list(got["cluster"]) == list(label)


@pytest.mark.parametrize("d", [5, 8, 64])
def test_dbscan_of_many_columns_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    p = np.vstack([rng.normal(0, 0.15, (110, d)), rng.normal(1.2, 0.2, (90, d)), rng.uniform(-1, 3, (40, d)), np.full((40, d), 0.3)])
    p[:, 1] = 7.0  # a column that tells nothing apart
    apart = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    eps = float(np.quantile(np.sort(apart, axis=1)[:, 6], 0.55))
    frame = pd.DataFrame(p, columns=[f"x{i}" for i in range(d)]).assign(k=np.arange(len(p)))
    rows, names = spark.createDataFrame(frame), [f"x{i}" for i in range(d)]
    got = density.dbscan(rows, names, "k", eps, 6).toPandas().sort_values("k")
    label, core = brute_dbscan(p, eps, 6)
    assert list(got["is_core"]) == list(core) and 0 < core.sum() < len(p)
    assert list(got["cluster"]) == list(label)
    if d == 5:
        assert density.dbscan(rows.limit(0), names, "k", eps, 6).count() == 0


def test_isolation_forest_finds_far_rows(spark):
    frame = skewed(1500)
    frame["x"] = np.random.default_rng(0).normal(0, 1, 1500)
    frame.loc[frame["id"] < 10, ["x", "w"]] = 12.0
    df = to_spark(spark, frame[["id", "x", "w"]])
    found = anomaly.anomalies_iforest(df, ["x", "w"], "x", ["id"], sensitivity=1.0).toPandas()
    assert set(range(10)) <= set(found["id"]) and 0.03 * 1500 <= len(found) <= 0.06 * 1500
    assert found["score"].between(0, 1).all()


def test_stratified_split_sizes_and_determinism(spark):
    df = to_spark(spark, skewed(3000)[["id", "k"]])
    one = ml.stratified_split(df, "k", ["id"], 0.25)
    sizes = one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r["t"] == int(r["n"] * 0.25 + 0.5) for r in sizes)
    spread = ml.stratified_split(df, "k", ["id"], 0.25, blocks=6).where("is_test").select("id")
    assert spread.exceptAll(one.where("is_test").select("id")).count() == 0


def test_models_learn_a_clear_rule(spark):
    frame = skewed(1200).fillna({"v": 7.5})
    frame["y"] = np.where(frame["w"] > 0, "yes", "no")
    df = to_spark(spark, frame)
    for kind in ("logistic", "tree", "linear_svm"):
        model = ml.fit_classifier(df, "y", ["v", "w"], ["k"], kind)
        assert ml.classification_metrics(ml.predict(model, df)).first()["accuracy"] > 0.95
    unseen = to_spark(spark, frame.head(20).assign(k="never seen", v=np.nan))
    assert ml.predict(model, unseen).count() == 20
    names = {r["feature"] for r in ml.feature_importance(model, df).collect()}
    assert len(names) == 11


def test_roc_against_ranks_with_tied_scores(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 12, 400).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    rank = pd.Series(s).rank().to_numpy()
    pos, neg = (y == 1).sum(), (y == 0).sum()
    want = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    for blocks in (1, 3):
        assert ml.roc_auc(df, "y", "s", blocks).first()["auc"] == pytest.approx(want)
    only = ml.roc_auc(df.where("y = 1"), "y", "s").first()["auc"]
    assert only is None


def test_elbow(spark):
    assert cluster.elbow_of([1, 2], [3.0, 1.0]) == 1
    assert cluster.elbow_of([1, 2, 3, 4, 5], [100.0, 40.0, 10.0, 9.0, 8.0]) == 3


def test_pca_scores_are_centred(spark):
    df = to_spark(spark, skewed(500).fillna({"v": 1.0}))
    row = cluster.pca_2d(df, ["v", "w"], ["id"], standardize=False).agg(F.avg("pc1"), F.avg("pc2"), F.max("explained_1")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1]) < 1e-9 and row[2] > 0.9


def test_kde_integrates_to_one_over_a_wide_range(spark):
    df = to_spark(spark, skewed(2000)[["w"]])
    out = frames.kde(df, "w").toPandas().sort_values("x")
    assert np.trapezoid(out["density"], out["x"]) == pytest.approx(1.0, abs=0.02)
    assert frames.kde(spark.createDataFrame([(1.0,), (1.0,)], "w double"), "w").count() == 0


def test_large_input_plans_agree_with_small_ones(spread):
    frame = skewed(900)
    df = to_spark(spread, frame)
    got = explore.group_summary(df, "k", "v").toPandas().set_index("k").sort_index()
    want = frame.groupby("k")["v"].describe()
    np.testing.assert_allclose(got["median"], want["50%"])
    np.testing.assert_allclose(got["q1"], want["25%"])
    assert stats.levene_test(df, "k", "v").first()["k"] == 9
    water = frames.waterfall(df, "k", "w").toPandas()
    assert water.iloc[-1]["step"] == "Total" or "Total" in set(water["step"])
    run = water[water["step"] != "Total"].sort_values("step")
    np.testing.assert_allclose(run["running"], run["amount"].cumsum())


def test_all_k_advance_as_single_fits_do(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(m, 0.4, (150, 3)) for m in (0, 3, 6, 9)])
    df = spark.createDataFrame(pd.DataFrame(points, columns=list("abc"))).repartition(4)
    rows, _ = cluster.vectors(df, list("abc"), standardize=False)
    first = cluster.starts(rows, 5)
    together = cluster.lloyd(rows, {k: first[:k] for k in range(2, 6)})
    for k in range(2, 6):
        centres = first[:k]
        for _ in range(20):
            own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([points[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(k)])
        cost = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        alone = cluster.lloyd(rows, {k: first[:k]})
        assert abs(alone[1][k] - together[1][k]) < 1e-9 and abs(cost - together[1][k]) < 1e-2 * cost
    got = cluster.kmeans_elbow(df, list("abc"), most=6, standardize=False).toPandas()
    assert list(got["k"]) == [1, 2, 3, 4, 5, 6] and (np.diff(got["cost"]) < 1e-6).all()


def test_fold_moments_equal_fits_of_each_fold(spark):
    frame = skewed(900).fillna({"v": 7.5})
    frame["z"] = 3 * frame["w"] - 0.01 * frame["v"] + np.random.default_rng(1).normal(0, 1, 900)
    df = to_spark(spark, frame)
    for kind, params in (("linear", {}), ("ridge", {"alpha": 40.0})):
        got = ml.cross_validate(df, "z", ["v", "w"], ["id"], kind=kind, task="regression", folds=3, fold=F.col("id") % 3, **params).first()
        scores = []
        for held in range(3):
            model = ml.fit_regressor(df.where(F.col("id") % 3 != held), "z", ["v", "w"], kind=kind, **params)
            scores.append(ml.regression_metrics(ml.predict(model, df.where(F.col("id") % 3 == held))).first()["r2"])
        np.testing.assert_allclose([got["mean"], got["std"]], [np.mean(scores), np.std(scores)], rtol=1e-6)
    holes = df.withColumn("v", F.when(F.col("id") % 7 > 0, F.col("v")))
    assert ml.fold_scores(holes.withColumn("fold", F.col("id") % 3), "z", ["v"], 3, 0.0) is None


def test_trees_grow_apart_and_take_all_they_need(spark):
    frame = skewed(4000)
    df = to_spark(spark, frame[["id", "w"]]).repartition(5)
    forest, size = anomaly.isolation_forest(df, ["w"], ["id"], trees=20, sample=64)
    nodes = forest.toPandas()
    assert size == 64 and nodes["tree"].nunique() == 20
    assert nodes.groupby("tree").size().min() > 10 and len(set(nodes[nodes["node"] == 0]["cut"])) == 20
    few, size = anomaly.isolation_forest(df.limit(10), ["w"], ["id"], trees=5, sample=64)
    assert size == 10 and few.select("tree").distinct().count() == 5


@pytest.mark.parametrize("kind", ["tree", "gbt"])
@pytest.mark.parametrize("target", ["y", "z", "three"])
def test_trees_on_cells_equal_trees_on_rows(spark, kind, target):
    """Cells of equal bins hold every row: the same trees grow from them."""
    rng = np.random.default_rng(4)
    n = 4000
    frame = pd.DataFrame({"v": rng.integers(0, 30, n) * 1.5, "w": rng.integers(-4, 5, n), "k": rng.choice(list("abc"), n)})
    frame["y"] = np.where(frame.v + 3 * frame.w + rng.normal(0, 4, n) > 20, "yes", "no")
    frame["three"] = np.where(frame.w > 2, "high", np.where(frame.v + rng.normal(0, 5, n) > 20, "mid", "low"))
    frame["z"] = frame.v * frame.w + rng.normal(0, 3, n) + (frame.k == "a") * 10
    df = spark.createDataFrame(frame)
    fit = ml.fit_regressor if target == "z" else ml.fit_classifier
    params = {"stages": 5} if kind == "gbt" else {"min_rows": 40}
    found = []
    for limit in ("100000", "100"):
        spark.conf.set("spark.prismal.cellRows", limit)
        model = fit(df, target, ["v", "w"], ["k"], kind, **params)
        found.append(model.transform(df).select("prediction").toPandas()["prediction"].to_numpy())
    spark.conf.unset("spark.prismal.cellRows")
    assert "binned" in model.transform(df).columns
    np.testing.assert_allclose(found[0], found[1], rtol=1e-6, atol=1e-6)


def test_forest_and_quantile_cells_keep_their_worth(spark):
    rng = np.random.default_rng(5)
    n = 5000
    frame = pd.DataFrame({"v": rng.normal(0, 1, n), "w": rng.normal(0, 1, n)})
    frame["y"] = np.where(frame.v + frame.w > 0, "yes", "no")
    df = spark.createDataFrame(frame)
    spark.conf.set("spark.prismal.cellRows", "100")
    try:
        model = ml.fit_classifier(df, "y", ["v", "w"], kind="forest", trees=20)
    finally:
        spark.conf.unset("spark.prismal.cellRows")
    assert "binned" in model.transform(df).columns
    assert ml.classification_metrics(ml.predict(model, df)).first()["accuracy"] > 0.85
    assert len(ml.feature_importance(model, df).collect()) == 2


def test_forest_scores_are_taken_once(spark, capsys):
    """The quantile, the mean and the answer read written scores: none of them runs the trees again."""
    df = spark.range(500).select("id", (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("w"))
    anomaly.anomalies_iforest(df, ["x", "w"], "x", ["id"]).explain()
    assert "MapInPandas" not in capsys.readouterr().out


def test_svm_on_many_rows_reaches_the_least_loss_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    n = 3000
    frame = pd.DataFrame({"a": rng.normal(0, 1, n), "b": rng.normal(5, 3, n), "k": rng.choice(list("pqr"), n)})
    passes = []
    once = ml._hinge_sums
    monkeypatch.setattr(ml, "_hinge_sums", lambda *given: passes.append(1) or once(*given))
    spark.conf.set("spark.prismal.svmRows", "100")
    try:
        for noise, rule in ((0.7, frame.a + 0.3 * frame.b - 1.5), (1.0, -1.5 + 0 * frame.a)):
            hot = rule + rng.normal(0, noise, n) > 0
            df = spark.createDataFrame(frame.assign(y=np.where(hot, "yes", "no"))).repartition(4)
            passes.clear()
            model = ml.fit_classifier(df, "y", ["a", "b"], ["k"], "linear_svm")
            assert 0 < len(passes) < 50
            points = model.transform(df).select("label", ml.vector_to_array("features").alias("x")).toPandas()
            x, sign = np.array(points["x"].tolist()), 2 * points["label"].to_numpy() - 1
            loss = lambda w, b: np.maximum(0, 1 - sign * (x @ w + b)).mean() + w @ w / (2 * n)
            plane, bias = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
            for size in (0.3, 0.03, 0.003):  # the loss is convex: nothing near is less, so nothing is
                for off in rng.normal(0, size, (50, len(plane) + 1)):
                    assert loss(plane, bias) <= loss(plane + off[:-1], bias + off[-1]) + 1e-6
            assert ml.predict(model, df).where((F.col("label") == 1) != (F.col("prediction") == 1)).count() <= (hot != (rule > 0)).sum() * 1.1
        assert loss(plane, bias) == pytest.approx(2 * hot.mean(), rel=1e-5)  # nothing to learn: always the larger class
        monkeypatch.setattr(ml, "SVM_FEATURES", 2)
        passes.clear()
        assert ml.fit_classifier(df, "y", ["a", "b"], ["k"], "linear_svm", max_iter=2).stages[-1].numFeatures == 5 and not passes
    finally:
        spark.conf.unset("spark.prismal.svmRows")


def test_split_of_many_rows_writes_only_limits(spread, monkeypatch):
    frame = pd.DataFrame({"id": np.arange(3000) % 2500, "k": np.where(np.arange(3000) % 7 == 0, None, np.array(list("abc"))[np.arange(3000) % 3])})
    frame.loc[:1, "k"] = "rare"
    df = spread.createDataFrame(frame, "id long, k string")
    written = []
    for module in (ml, ordered):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda rows, label="step", keep=keep: written.append(rows.count()) or keep(rows, label))
    for share in (0.0, 0.2, 0.25, 1.0):
        drawn = df.dropna().withColumn("u", ml._uniform(["id"], ml.SEED)).toPandas()
        size = drawn.groupby("k")["u"].transform("size")
        want = drawn["u"].groupby(drawn["k"]).rank(method="max") <= np.floor(size * share + 0.5)
        written.clear()
        got = ml.stratified_split(df, "k", ["id"], share).toPandas()
        assert list(got.columns) == ["id", "k", "is_test"]
        assert sorted(zip(got["k"], got["id"], got["is_test"])) == sorted(zip(drawn["k"], drawn["id"], want))
        assert sum(written) < 50
