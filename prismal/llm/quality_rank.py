"""A quality classifier from preference pairs, after Bradley and Terry.

Every document has a strength that is linear in features of its text. A labelled good document is
preferred to a labelled bad one with the logistic probability of their difference in strength, so the weights
come from logistic loss on feature differences, without an intercept. Scores are strengths shifted by a
quantile of the labelled ones: that quantile gets the score at which documents are predicted good.

Fitted on a bounded sample, chosen by hash, of at most about ``max_labelled`` labelled documents and ``per_good`` pairs for each good one; scores
cover all documents.

Defined results: a null text counts as empty and gets a score like any other; equal texts get equal scores; documents with several labels
count as their highest; without labels of both kinds every score is the threshold itself; an empty table gives an empty table; columns
named like the outputs are replaced, all others are kept.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.rule_stats import ratios, with_counts
from prismal.session import materialize


def features() -> list[Column]:
    """Bounded functions of the ratios, with ramps where both too little and too much is a sign."""
    r = ratios()

    def ramp(x: Column, low: float, high: float) -> Column:
        return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))

    length = F.log1p(F.col("n_words"))
    return [
        F.sqrt(r["symbols"]), ramp(r["symbols"], 0, 0.02), F.sqrt(r["dup_lines"]), ramp(r["dup_lines"], 0.05, 0.4),
        F.sqrt(r["repeats"]), ramp(r["repeats"], 0.02, 0.3), F.sqrt(r["upper"]), ramp(r["upper"], 0.03, 0.15), F.sqrt(r["marks"]),
        ramp(r["marks"], 0.02, 0.3), ramp(r["same_next"], 0.01, 0.2), ramp(r["stops"], 0.0, 0.08), ramp(r["stops"], 0.2, 0.4),
        ramp(r["word_length"], 3.5, 4.7), ramp(r["word_length"], 5.8, 7.0), ramp(r["digits"], 0.02, 0.2),
        ramp(r["distinct"], 0.2, 0.6), ramp(r["distinct"], 0.6, 0.9), ramp(length, 3.0, 5.0), ramp(length, 5.0, 8.0),
        ramp(r["distinct"] * F.sqrt(F.greatest("n_words", F.lit(1))), 4.0, 12.0),
    ]


def fit(labelled: DataFrame, max_labelled: int = 20_000, per_good: int = 8, seed: int = 7) -> list[float]:
    """Weights of the features. ``labelled`` has ``x`` (array), ``good`` (boolean) and ``key`` (a hash of the document)."""
    sizes = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    good, bad = sizes.get(True, 0), sizes.get(False, 0)
    width = len(features())
    if not good or not bad:
        return [0.0] * width
    share = min(1.0, max_labelled / (good + bad))
    rows = labelled.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    # Both kinds are dealt out to so many slots that a slot has about ``per_good`` bad documents; pairs are formed within a slot.
    slots = max(1, int(bad * share) // per_good)
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(slots)))
    a = rows.filter("good").select("slot", F.col("x").alias("a"), F.col("key").alias("ka"))
    b = rows.filter("NOT good").select("slot", F.col("x").alias("b"), F.col("key").alias("kb"))
    turned = F.pmod(F.xxhash64("ka", "kb"), F.lit(2))  # half of the pairs the other way round: both outcomes occur
    difference = F.zip_with("a", "b", lambda p, q: p - q)
    pairs = a.join(b, "slot").withColumn("label", turned.cast("double"))
    pairs = pairs.withColumn("difference", F.when(turned == 1, difference).otherwise(F.transform(difference, lambda d: -d)))
    pairs = materialize(pairs.select("label", "difference"), "pairs")
    if pairs.select("label").distinct().count() < 2:
        return [0.0] * width
    model = LogisticRegression(featuresCol="v", labelCol="label", fitIntercept=False, regParam=1e-3, maxIter=60, standardization=False)
    return [float(w) for w in model.fit(pairs.select("label", array_to_vector("difference").alias("v"))).coefficients]


def strength(weights: list[float]) -> Column:
    return sum((x * w for x, w in zip(features(), weights)), F.lit(0.0))


def shift(labelled: DataFrame, weights: list[float]) -> tuple[float, float]:
    """The strength quantile that best tells the labelled documents apart, and its probability.

    Quantiles run from 1 to 50 hundredths of all labelled documents; best is the highest mean of the two shares told right.
    """
    total = sum((F.col("x")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
    rows = labelled.select("good", total.alias("s"))
    steps = [i / 100 for i in range(1, 51)]
    cuts = rows.agg(F.percentile_approx("s", steps, 100_000)).first()[0]
    if not cuts:
        return 0.0, 0.0
    row = rows.agg(*[F.sum(F.when(F.col("good") & (F.col("s") >= c), 1).otherwise(0)).alias(f"g{i}") for i, c in enumerate(cuts)],
                   *[F.sum(F.when(~F.col("good") & (F.col("s") < c), 1).otherwise(0)).alias(f"b{i}") for i, c in enumerate(cuts)],
                   F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad")).first()
    value = [row[f"g{i}"] / max(row["good"], 1) + row[f"b{i}"] / max(row["bad"], 1) for i in range(len(cuts))]
    best = max(range(len(cuts)), key=lambda i: (value[i], -i))
    return float(cuts[best]), steps[best]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of 5: never learned from. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3,
          learn: Column | None = None, keep=lambda counted: counted, **options) -> DataFrame:
    """``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if the score is at least ``threshold``).

    Labels of rows where ``learn`` holds are learned from; by default those that are not held out.
    """
    learn = ~held_out(doc_id) if learn is None else learn
    counted = materialize(keep(with_counts(df, text)), "counted")
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") >= 1).alias("good"))
    known = counted.filter(learn & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.array(*features()).alias("x")).join(marks, "_id")
    known = materialize(known.select("x", "good", F.xxhash64("_id").alias("key")), "labelled")
    weights = fit(known, **options)
    cut, _ = shift(known, weights)
    at = strength(weights) - cut + math.log(threshold / (1 - threshold))
    out = counted.withColumn("held_out", held_out(doc_id)).withColumn("score", 1 / (1 + F.exp(-at)))
    # Decided on the strength, which the score follows: rounding of the score can't turn a document at the threshold.
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
