"""Supervised models: split, preprocessing, estimators, metrics, validation and a model registry."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.functions.moments import percent
from prismal.operators.explore import value_counts_of
from prismal.plans.counts import long_values, mode_row
from prismal.plans.ordered import running_totals
from prismal.plans.quantiles import quantile_name, quantiles
from prismal.plans.scalars import attach_row
from prismal.plans.sizing import inputs_fit_one_task, setting
from prismal.session import materialize

SEED = 42
TREES = ("tree", "forest", "gbt")
# Largest number of training rows that trees are grown from row by row; above, they are grown from counted cells.
CELL_ROWS = ("spark.prismal.cellRows", 100_000)
# Bins of a numeric feature, Spark's own number.
BINS = 32
# About how many blocks of equal rows the trees of a forest draw from.
FOREST_BLOCKS = 1 << 20
# Equal spans of the hash that a split's rows are counted by.
SPANS = 4096
# Largest number of training rows that a two-class linear SVM leaves to Spark's estimator, whose line searches pass over them some 500 times.
SVM_ROWS = ("spark.prismal.svmRows", 100_000)
# Most features of such an SVM on more rows: a task adds up a square of their number.
SVM_FEATURES = 200


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = value_counts_of(df, target)
    return attach_row(counts, counts.agg(F.sum("n").alias("_all"))).select(target, "n", percent(F.col("n"), F.col("_all")).alias("pct"))


def _uniform(keys: Sequence[str], seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 12).cast("double") / float(2**52)


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.2, seed: int = SEED,
                     blocks: int | None = None) -> DataFrame:
    """Add ``is_test``: in every class the round(n * share) rows with the lowest key hash.

    Where the files fit one task, the rows are ranked. Otherwise they are counted by class and by equal spans of the hash, and only the span in which a
    class's quota ends is ranked (in ``blocks`` of the hash); all other rows stay where they are.
    """
    # A row for each class: joined by its class, all rows would go to as many tasks as there are classes.
    wanted = value_counts_of(df, label).select(F.col(label).alias("_class"), F.floor(F.col("n") * test_share + 0.5).alias("_wanted"))
    drawn = df.where(F.col(label).isNotNull()).withColumn("_u", _uniform(keys, seed))
    if blocks is not None or not inputs_fit_one_task(df, 1 / 8):
        return _split_by_spans(drawn, label, wanted, blocks)
    ranked = running_totals(drawn.withColumn("_one", F.lit(1).cast("long")), "_u", {"_rank": "_one"}, [label])
    quota = ranked.join(F.broadcast(wanted), F.col(label) == F.col("_class"))
    return quota.withColumn("is_test", F.col("_rank") <= F.col("_wanted")).drop("_u", "_one", "_rank", "_class", "_wanted")


def _split_by_spans(drawn: DataFrame, label: str, wanted: DataFrame, blocks: int | None) -> DataFrame:
    """``is_test`` for rows with ``_u``: every class's limit of it becomes a row of a table that is broadcast."""
    span = F.floor(F.col("_u") * SPANS)
    counts = drawn.groupBy(F.col(label).alias("_class"), span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_class").orderBy("_span")))  # a row for each span
    over = upto.join(F.broadcast(wanted), "_class").where(F.col("_upto") > F.col("_wanted"))
    ends = materialize(over.groupBy("_class").agg(F.min("_span").alias("_end"), F.min_by(F.col("_wanted") - F.col("_upto") + F.col("_n"), "_span").alias("_left")), "ends")
    inside = drawn.select(F.col(label).alias("_class"), "_u", span.alias("_span")).join(F.broadcast(ends), "_class").where(F.col("_span") == F.col("_end"))
    ranked = running_totals(inside.groupBy("_class", "_left", "_u").agg(F.count(F.lit(1)).alias("_n")), "_u", {"_rank": "_n"}, ["_class"], blocks=blocks)
    last = ranked.where(F.col("_rank") <= F.col("_left")).groupBy("_class").agg(F.max("_u").alias("_last"))
    limits = materialize(ends.select("_class", "_end").join(last, "_class", "left"), "limits")
    below = F.when(F.col("_last").isNotNull(), F.col("_u") <= F.col("_last")).otherwise(span < F.col("_end"))
    marked = drawn.join(F.broadcast(limits), F.col(label) == F.col("_class"), "left")
    return marked.withColumn("is_test", F.col("_end").isNull() | below).drop("_u", "_class", "_end", "_last")


def random_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` by a threshold on the key hash (for regression targets)."""
    return df.withColumn("is_test", _uniform(keys, seed) < test_share)


# --- preprocessing ---------------------------------------------------------------------------


def preprocessing(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Stages: median and mode fill learned from the training rows, one-hot, standardized vector ``features``.

    Unknown categories become all zeros.
    """
    fills = []
    if numeric:
        mids = quantiles(train, numeric, [0.5]).first()
        fills += [f"coalesce(CAST(`{c}` AS DOUBLE), {float(mids[quantile_name(c)][0])!r}D) AS `{c}_filled`" for c in numeric]
    if categorical:
        top = mode_row(train, categorical).first()
        quoted = {c: str(top[f"m_{c}"] if top[f"m_{c}"] is not None else "Unknown").replace("\\", "\\\\").replace("'", "\\'") for c in categorical}
        fills += [f"coalesce(CAST(`{c}` AS STRING), '{quoted[c]}') AS `{c}_filled`" for c in categorical]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__")]
    parts = []
    if numeric:
        stages += [VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="_num"),
                   StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)]
        parts.append("_scaled")
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"{c}_filled", outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", handleInvalid="error", dropLast=True))
        parts.append(f"{c}_hot")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def _class_count(train: DataFrame, label: str) -> int:
    return train.where(F.col(label).isNotNull()).select(label).distinct().limit(3).count()


def classifier(kind: str, classes: int = 2, **params):
    """Estimator by name; boosted trees and linear SVM wrap into one-vs-rest beyond two classes."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "logistic":
        c, rows = params.get("C", 1.0), params.get("rows", 1000)
        return LogisticRegression(**common, regParam=1.0 / (c * rows), maxIter=params.get("max_iter", 100), standardization=False)
    if kind == "tree":
        return DecisionTreeClassifier(**common, impurity=params.get("criterion", "gini"), maxDepth=params.get("max_depth", 5),
                                      minInstancesPerNode=params.get("min_rows", 1), minWeightFractionPerNode=params.get("min_share", 0.0), seed=SEED)
    if kind == "forest":
        return RandomForestClassifier(**common, numTrees=params.get("trees", 100), impurity=params.get("criterion", "gini"),
                                      maxDepth=params.get("max_depth", 5), seed=SEED)
    if kind == "gbt":
        base = GBTClassifier(**common, maxIter=params.get("stages", 100), stepSize=params.get("learning_rate", 0.1), maxDepth=params.get("max_depth", 3), seed=SEED)
    elif kind == "linear_svm":
        base = LinearSVC(**common, regParam=1.0 / (params.get("C", 1.0) * params.get("rows", 1000)), maxIter=params.get("max_iter", 100), standardization=False)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return base if classes <= 2 else OneVsRest(classifier=base, parallelism=classes, **common)


def regressor(kind: str, **params):
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind in ("linear", "ridge", "lasso"):
        alpha = 0.0 if kind == "linear" else params.get("alpha", 1.0)
        if kind == "ridge":
            # The penalty stands beside the sum of squares, Spark's beside their mean; and Spark divides it by the label's spread.
            alpha *= params["spread"] / params["rows"]
        return LinearRegression(**common, regParam=alpha, elasticNetParam=1.0 if kind == "lasso" else 0.0, maxIter=params.get("max_iter", 100), standardization=False)
    if kind == "tree":
        return DecisionTreeRegressor(**common, maxDepth=params.get("max_depth", 5), minInstancesPerNode=params.get("min_rows", 1), minWeightFractionPerNode=params.get("min_share", 0.0), seed=SEED)
    if kind == "forest":
        return RandomForestRegressor(**common, numTrees=params.get("trees", 100), maxDepth=params.get("max_depth", 5), seed=SEED)
    if kind == "gbt":
        return GBTRegressor(**common, maxIter=params.get("stages", 100), stepSize=params.get("learning_rate", 0.1), maxDepth=params.get("max_depth", 3), seed=SEED)
    raise ValueError(f"unknown regressor {kind!r}")


def _training_rows(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Only the needed columns, kept in memory or on disk while the passes of one fit run over them."""
    columns = list(dict.fromkeys([target, *numeric, *categorical]))
    return train.where(F.col(target).isNotNull()).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)


def _bin_number(column: str, cuts: Sequence[float]) -> str:
    """SQL for the number of cuts below a value, as a double."""
    tests = [f"CAST(`{column}` > CAST('{cut!r}' AS DOUBLE) AS INT)" for cut in cuts]
    return f"CAST({' + '.join(tests) or '0'} AS DOUBLE)"


def bin_cuts(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Values of each numeric column, the largest left out, that part all its rows into at most ``bins`` bins: every value where there are so few, else quantiles."""
    if not columns:
        return {}
    known = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = known.agg(*[F.struct(F.max(c).alias("top"), F.approx_count_distinct(c).alias("n"), F.percentile_approx(c, shares, 10_000).alias("cuts")).alias(c)
                       for c in columns]).first()
    few = [c for c in columns if seen[c]["n"] <= 2 * bins]
    held: dict[str, list[float]] = {c: [] for c in few}
    if few:  # about 2 * bins values of each column at most
        for r in long_values(known, few).where("value IS NOT NULL").distinct().collect():
            held[r["column"]].append(r["value"])
    return {c: sorted({v for v in (held[c] if c in held and len(held[c]) <= bins else seen[c]["cuts"] or []) if v < seen[c]["top"]}) for c in columns}


def _fit_on_cells(rows: DataFrame, stages: list, numeric: Sequence[str], categorical: Sequence[str], model, forest: bool, total: int) -> PipelineModel:
    """The trees of ``model`` grown from counted cells of equal binned features in place of single rows.

    Trees see numeric features by their bins alone, so rows of one cell are one weighted row; bins are set by quantiles of all rows. A numeric label's
    rows of a cell are two weighted rows that have their number, mean and variance, all that squared error asks for. Cells hold every row; how many
    there are follows the bins, not the rows. A forest draws its bootstraps from blocks of at most about ``total / FOREST_BLOCKS`` rows of a cell.
    """
    head = Pipeline(stages=stages).fit(rows)
    filled = head.stages[1].transform(head.stages[0].transform(rows)).select("label", *[f"{c}_filled" for c in (*numeric, *categorical)])
    cuts = bin_cuts(filled, [f"{c}_filled" for c in numeric])
    places, kinds = [f"{c}_bin" for c in numeric], [f"{c}_filled" for c in categorical]
    by_class = isinstance(head.stages[0], StringIndexerModel)
    label = [] if by_class else [F.avg("label").alias("_mean"), F.stddev_pop("label").alias("_off")]
    binned = filled.where("label IS NOT NULL").selectExpr("*", *[f"{_bin_number(f'{c}_filled', cuts[f'{c}_filled'])} AS `{c}_bin`" for c in numeric])
    keys = [*(["label"] if by_class else []), *places, *kinds]
    ends = [F.struct(F.min(f"{c}_filled").alias("lo"), F.max(f"{c}_filled").alias("hi")).alias(f"_{c}") for c in numeric]
    cells = materialize(binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *label, *ends), "cells")
    # Between two bins, the cut stands in the middle of the nearest values, as Spark places it.
    middles = {}
    for c in numeric:
        sides = cells.groupBy(f"{c}_bin").agg(F.min(f"_{c}.lo").alias("lo"), F.max(f"_{c}.hi").alias("hi")).orderBy(f"{c}_bin").collect()  # a row for each bin
        middles[c] = [(a["hi"] + b["lo"]) / 2 for a, b in zip(sides, sides[1:])]
    points = cells.withColumn("weight", F.col("_n").cast("double"))
    if not by_class:
        points = points.withColumn("weight", F.col("_n") / 2).withColumn("label", F.explode(F.array(F.col("_mean") - F.col("_off"), F.col("_mean") + F.col("_off"))))
    if forest:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("weight") * FOREST_BLOCKS / total)).cast("int")
        points = points.withColumn("weight", F.col("weight") / blocks).withColumn("_block", F.explode(F.sequence(F.lit(1), blocks)))
    points = points.select("label", *places, *kinds, "weight")
    for stage in head.stages[1:]:
        if isinstance(stage, StringIndexerModel | OneHotEncoderModel):
            points = stage.transform(points)
    numbers = [f"{_bin_number(f'{c}_filled', middles[c])} AS `{c}_bin`" for c in numeric]
    bins = SQLTransformer(statement=f"SELECT {', '.join(['*', *numbers])} FROM __THIS__")
    joined = VectorAssembler(inputCols=[*places, *[f"{c}_hot" for c in categorical]], outputCol="binned")
    points = joined.transform(points).select("label", "binned", "weight")
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / 20_000)))
    points = points.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    grown = model.setFeaturesCol("binned").setWeightCol("weight").fit(points)
    points.unpersist()
    return PipelineModel(stages=[*head.stages, bins, joined, grown])


def _hinge_sums(points: DataFrame, at: np.ndarray, width: float) -> np.ndarray:
    """For every plane of ``at`` (weights, intercept): the rows' rounded hinge losses, what these lack to the dual, their slope, its change with the width, and their curvature, added up."""
    planes, size = at.shape

    def add(batches):
        total = np.zeros((planes, 2 + 2 * size + size * size))
        for batch in batches:
            sign = 2.0 * batch.column("label").to_numpy() - 1.0
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(sign), size - 1)
            signed = np.column_stack([x, np.ones(len(sign))]) * sign[:, None]
            for sums, plane in zip(total, at):
                short = 1.0 - signed @ plane
                dual = np.clip((short / width + 1.0) / 2.0, 0.0, 1.0)
                inside = np.abs(short) < width
                bent = signed[inside]
                sums[0] += dual @ short + width * (dual @ (1.0 - dual))
                sums[1] += np.maximum(short, 0.0).sum() - dual @ short
                sums[2:2 + size] -= dual @ signed
                sums[2 + size:2 + 2 * size] += short[inside] @ bent / (2.0 * width * width)
                sums[2 + 2 * size:] += (bent.T @ bent).ravel() / (2.0 * width)
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size, dtype=np.int32), "part": total.ravel()})

    out = np.zeros(planes * (2 + 2 * size + size * size))
    for r in points.mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("whole")).collect():
        out[r["place"]] = r["whole"]
    return out.reshape(planes, -1)


def svm_plane(points: DataFrame, features: int, penalty: float, most: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean hinge loss plus ``penalty`` / 2 times the squared weights, over rows of ``label`` (0 or 1) and ``x``.

    Newton steps on a hinge whose kink is rounded over a width that shrinks. Every pass over the rows measures some step lengths at once. The rounded
    hinge's slopes are a point of the dual problem, so each pass also tells how far the loss is from the least one; the steps end when that is below
    ``tolerance`` of the loss, or after ``most`` passes. Neither the passes nor what the driver holds follow the number of rows.
    """
    size, rows = features + 1, points.count()
    ridge = np.append(np.full(features, penalty), 0.0)

    def measured(at: np.ndarray, width: float):
        sums = _hinge_sums(points, at, width) / rows
        losses = sums[:, 0] + (at * at) @ ridge / 2
        if not np.isfinite(losses).any():
            raise ValueError("features are not finite")
        best = int(np.nanargmin(losses))
        slope, drift, bend = np.split(sums[best, 2:], [size, 2 * size])
        return at[best], losses[best], sums[best, 1], slope + ridge * at[best], drift, bend.reshape(size, size) + np.diag(ridge)

    def step_within(reach: float) -> np.ndarray:
        """The step to the least of the quadratic that slope and curvature describe, among those that move the rows' values by ``reach`` at most (root mean square)."""
        damped = lambda extra: -np.linalg.lstsq(bend + extra * spread, slope, rcond=None)[0]
        far = lambda step: float(np.sqrt(max(0.0, step @ spread @ step)))
        if far(step := damped(0.0)) <= reach:
            return step
        low, high = -20.0, 20.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if far(damped(10.0**middle)) > reach else (low, middle)
        return damped(10.0**high)

    width, reach = 2.0, 1.0
    plane, loss, gap, slope, drift, bend = measured(np.zeros((1, size)), width)
    spread = 2 * width * (bend - np.diag(ridge))  # second moments: the rounded part holds every row
    for _ in range(most - 1):
        step = step_within(np.inf)
        left = -slope @ step / 2
        if left <= 0.1 * max(gap, tolerance * loss) or reach < 1e-12:
            if gap <= tolerance * loss or width < 1e-9:
                break
            ahead = step + np.linalg.lstsq(bend, drift, rcond=None)[0] * (width - width / 6)  # where the least loss moves with the width
            width, reach = width / 6, 1.0
            plane, loss, gap, slope, drift, bend = measured(plane + np.stack([np.zeros(size), step, ahead]), width)
            continue
        tries = [(r, plane + step_within(r)) for r in (reach, reach / 4, reach / 16)]
        found = measured(np.stack([to for _, to in tries]), width)
        if found[1] < loss:
            reach = 4 * next(r for r, to in tries if np.array_equal(to, found[0]))
            plane, loss, gap, slope, drift, bend = found
        else:
            reach /= 64
    return plane[:-1], float(plane[-1])


def _fit_svm(rows: DataFrame, stages: list, model: LinearSVC) -> PipelineModel | None:
    """A two-class linear SVM on many rows; none where there are too many features for curvatures."""
    head = Pipeline(stages=stages).fit(rows)
    ready = head.transform(rows).where("label IS NOT NULL")
    features = ready.schema["features"].metadata["ml_attr"]["num_attrs"]
    if features > SVM_FEATURES:
        return None
    points = ready.select("label", vector_to_array("features").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    weights, intercept = svm_plane(points, features, model.getRegParam(), model.getMaxIter(), model.getTol())
    points.unpersist()
    java = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", model.uid, _py2java(rows.sparkSession.sparkContext, Vectors.dense(weights)), intercept)
    return PipelineModel(stages=[*head.stages, model._copyValues(LinearSVCModel(java))])


def _fit_stages(rows: DataFrame, coded, numeric: Sequence[str], categorical: Sequence[str], kind: str, make: Callable, params: dict) -> PipelineModel:
    """Preprocessing and estimator fitted on the rows; trees on many rows by their cells."""
    stages = [coded, *preprocessing(rows, numeric, categorical)]
    total = rows.count() if kind in (*TREES, "linear_svm") else 0
    if kind == "linear_svm" and total > setting(rows.sparkSession, SVM_ROWS) and isinstance(model := make(**params), LinearSVC):
        if fitted := _fit_svm(rows, stages, model):
            return fitted
    if kind not in TREES or total <= setting(rows.sparkSession, CELL_ROWS):
        return Pipeline(stages=[*stages, make(**params)]).fit(rows)
    if kind == "tree" and params.get("min_rows", 1) > 1:
        params = {**params, "min_rows": 1, "min_share": (params["min_rows"] - 0.5) / total}  # rows are counted by weight
    return _fit_on_cells(rows, stages, numeric, categorical, make(**params), kind == "forest", total)


def fit_classifier(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "logistic", **params) -> PipelineModel:
    rows = _training_rows(train, target, numeric, categorical)
    coded = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    if kind in ("logistic", "linear_svm"):
        params.setdefault("rows", rows.count())
    classes = _class_count(rows, target)
    fitted = _fit_stages(rows, coded, numeric, categorical, kind, lambda **p: classifier(kind, classes, **p), params)
    rows.unpersist()
    return fitted


def fit_regressor(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "linear", **params) -> PipelineModel:
    rows = _training_rows(train, target, numeric, categorical)
    label = SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS label FROM __THIS__")
    if kind == "ridge":
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop(F.col(target).cast("double")).alias("spread")).first()
        params = {**size.asDict(), **params}
    fitted = _fit_stages(rows, label, numeric, categorical, kind, lambda **p: regressor(kind, **p), params)
    rows.unpersist()
    return fitted


def predict(model: PipelineModel, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Label, prediction and, where the model has one, the score of the second class."""
    out = model.transform(rows)
    score = [vector_to_array("probability")[1].alias("score")] if "probability" in out.columns else []
    return out.select(*keep, "label", "prediction", *score)


# --- metrics ---------------------------------------------------------------------------------


def confusion(predictions: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(predictions: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (0 where undefined)."""
    cells = confusion(predictions, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("actual").cast("string").alias("c"), F.col("n").alias("support"), zero.alias("called"), hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").cast("string").alias("c"), zero.alias("support"), F.col("n").alias("called"), zero.alias("hits")))
    by_class = cells.select(F.inline(sides))
    per = by_class.groupBy("c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    safe = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    p, r = safe("hits", "called"), safe("hits", "support")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    total = F.sum("support")
    return per.agg(total.alias("n"), (F.sum("hits") / total).alias("accuracy"), (F.sum(p * F.col("support")) / total).alias("precision"),
                   (F.sum(r * F.col("support")) / total).alias("recall"), (F.sum(f1 * F.col("support")) / total).alias("f1"))


def roc_points(df: DataFrame, label: str, score: str, blocks: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score, from high to low."""
    y = F.col(label).cast("int")
    cells = df.dropna(subset=[label, score]).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    totals = cells.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    run = running_totals(cells, "threshold", {"tp": "pos", "fp": "neg"}, descending=True, blocks=blocks)
    return attach_row(run, totals).select("threshold", "pos", "neg", "tp", "fp", F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"),
                                          "_p", "_n")


def roc_curve(df: DataFrame, label: str, score: str, blocks: int | None = None) -> DataFrame:
    return roc_points(df, label, score, blocks).select("threshold", "fpr", "tpr")


def roc_auc(df: DataFrame, label: str, score: str, blocks: int | None = None) -> DataFrame:
    """Area under the curve by trapezoids, one term per distinct score."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return roc_points(df, label, score, blocks).agg(F.try_divide(area, F.first("_p").cast("double") * F.first("_n")).alias("auc"))


def regression_metrics(predictions: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    a, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted)
    row = predictions.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(a).alias("_v"))
    return row.select("n", (1 - F.try_divide("mse", "_v")).alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse")


def residual_frame(predictions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return predictions.select(*keep, F.col("label").alias("actual"), F.col("prediction").alias("predicted"), (F.col("label") - F.col("prediction")).alias("residual"))


def feature_importance(model: PipelineModel, sample: DataFrame, most: int | None = None) -> DataFrame:
    """All features, or the ``most`` largest: importances of tree models, or coefficients by absolute size (first class of a multinomial model)."""
    meta = model.transform(sample.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    last: Transformer = model.stages[-1]
    if hasattr(last, "models"):
        last = last.models[0]
    if hasattr(last, "featureImportances"):
        values, kind = last.featureImportances.toArray(), "importance"
    elif getattr(last, "numClasses", 2) > 2:
        values, kind = last.coefficientMatrix.toArray()[0], "coefficient"
    else:
        values, kind = last.coefficients.toArray(), "coefficient"
    rows = [(names.get(i, f"feature_{i}"), kind, float(v)) for i, v in enumerate(values)]
    return sample.sparkSession.createDataFrame(rows, "feature string, kind string, value double").orderBy(F.abs("value").desc(), "feature").limit(len(rows) if most is None else most)


def fold_scores(rows: DataFrame, target: str, numeric: Sequence[str], folds: int, alpha: float) -> list[float] | None:
    """r2 of every held-out fold for least squares, with the ridge penalty ``alpha`` on standardized features, from one aggregate.

    Each fold's counts, means and co-moments are taken once; the training moments of a fold are those of all the others together, the model follows
    from them, and its r2 from the held-out moments. None if values are missing, which have to be filled from the training folds.
    """
    columns = [*numeric, target]
    rows = rows.select("fold", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    moments = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.greatest(*[F.col(f"c{i}").isNull() for i in range(len(numeric))], F.lit(False))).alias("gaps"),
        *[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(columns))], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs])
    by_fold = {r["fold"]: r for r in moments.collect()}  # a row for each fold
    if any(r["gaps"] for r in by_fold.values()) or len(by_fold) < folds:
        return None
    n = np.array([by_fold[f]["n"] for f in range(folds)], float)
    mean = np.array([[by_fold[f][f"m{i}"] for i in range(len(columns))] for f in range(folds)])
    spread = np.zeros((folds, len(columns), len(columns)))
    for i, j in pairs:
        spread[:, i, j] = spread[:, j, i] = [by_fold[f][f"v{i}_{j}"] for f in range(folds)]
    scores, d = [], len(numeric)
    for held in range(folds):
        rest = np.arange(folds) != held
        centre = n[rest] @ mean[rest] / n[rest].sum()
        off = mean[rest] - centre
        total = (n[rest][:, None, None] * (spread[rest] + off[:, :, None] * off[:, None, :])).sum(axis=0)
        scale = np.sqrt(np.diag(total)[:d] / (n[rest].sum() - 1))
        scale[scale == 0] = 1.0
        gram = total[:d, :d] / np.outer(scale, scale) + alpha * np.eye(d)
        slope = np.linalg.lstsq(gram, total[:d, d] / scale, rcond=None)[0] / scale
        miss = mean[held, d] - centre[d] - slope @ (mean[held, :d] - centre[:d])
        own = spread[held]
        error = own[d, d] - 2 * slope @ own[:d, d] + slope @ own[:d, :d] @ slope + miss**2
        scores.append(1 - error / own[d, d] if own[d, d] else 0.0)
    return scores


def cross_validate(df: DataFrame, target: str, numeric: Sequence[str], keys: Sequence[str], categorical: Sequence[str] = (),
                   kind: str = "logistic", task: str = "classification", folds: int = 5, fold: Column | None = None, **params) -> DataFrame:
    """Mean and spread of accuracy or r2 over folds chosen by a key hash, or by ``fold``: 0 to ``folds`` - 1."""
    fold = F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(folds)).cast("int") if fold is None else fold.cast("int")
    rows = materialize(df.where(F.col(target).isNotNull()).withColumn("fold", fold).select("fold", target, *numeric, *categorical), "folds")
    if task == "classification":
        judge, fit = MulticlassClassificationEvaluator(metricName="accuracy"), fit_classifier
    else:
        judge, fit = RegressionEvaluator(metricName="r2"), fit_regressor
    # Fills, scales, labels and penalty are learned from the training folds alone.
    scores = None
    if task == "regression" and kind in ("linear", "ridge") and not categorical and numeric:
        scores = fold_scores(rows, target, numeric, folds, 0.0 if kind == "linear" else params.get("alpha", 1.0))
    todo = range(folds) if scores is None else ()
    scores = scores or []
    for held in todo:
        model = fit(rows.where(F.col("fold") != held), target, numeric, categorical, kind, **params)
        scores.append(judge.evaluate(model.transform(rows.where(F.col("fold") == held))))
    mean = sum(scores) / folds
    spread = (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5
    out = [(kind, judge.getMetricName(), folds, float(mean), float(spread))]
    return df.sparkSession.createDataFrame(out, "model string, metric string, folds int, mean double, std double")


# --- registry --------------------------------------------------------------------------------


class ModelRegistry:
    """Named models below one shared folder: the fitted pipeline and one row of facts per model."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def save(self, name: str, model: PipelineModel, facts: DataFrame) -> None:
        model.write().overwrite().save(f"{self.folder}/models/{name}")
        facts.select(F.lit(name).alias("name"), *facts.columns).write.mode("overwrite").json(f"{self.folder}/facts/{name}")

    def load(self, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.folder}/models/{name}")

    def facts(self, spark) -> DataFrame:
        return spark.read.json(f"{self.folder}/facts/*")
