"""Quality rules, and an isolation forest over their statistics.

A random tree cuts a few hundred ordinary documents apart, by random splits of the box that holds the statistics of
all documents; an odd document soon ends in a part of the box without ordinary ones. So the mean path length over many trees tells how
anomalous a document is. Trees grow on labelled good documents where there are any, since junk of one kind
that fills a dense spot of its own would look ordinary. The threshold comes from labelled documents of both kinds.

The forest is fitted on at most about 4 x ``trees`` x ``rows_per_tree`` documents, chosen by hash; each tree
grows in a group of its own and just the grown trees reach the driver. The box, the statistics, the threshold's counts and the
verdicts cover all documents.

Defined results: a null or empty text has no words and fails the base rules; equal texts get equal verdicts, so ties and repeated rows
do; without labels of both kinds the method rejects nothing; an empty table gives an empty table; columns
named like the outputs are replaced, all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from prismal.llm.common import append, with_fields
from prismal.llm.rule_stats import COUNTS, ratios, with_counts
from prismal.session import materialize

FEATURES = ("symbols", "upper", "marks", "same_next", "stops", "word_length")
TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
BINS = 1000


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def statistics() -> dict[str, Column]:
    """The forest's inputs. Roots spread the small shares, which most documents have, over more of the box."""
    own = ratios()
    return {name: own[name] if name == "word_length" else F.sqrt(own[name]) for name in FEATURES}


def grow(points: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list, list, list, list]:
    """One tree over the box from ``low`` to ``high`` as parallel lists; a leaf has feature -1 and its depth, corrected for the points it holds."""
    feature, cut, left, right, depth = [], [], [], [], []
    stack = [(np.arange(len(points)), low, high, 0, -1, False)]
    while stack:
        rows, low, high, level, parent, is_right = stack.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), depth.append(level + mean_path(len(rows)))
        wide = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(wide):
            continue
        f = int(rng.choice(wide))
        at = float(rng.uniform(low[f], high[f]))
        below = points[rows, f] <= at
        feature[node], cut[node] = f, at
        own = np.arange(len(low)) == f
        stack += [(rows[~below], np.where(own, at, low), high, level + 1, node, True),
                  (rows[below], low, np.where(own, at, high), level + 1, node, False)]
    return feature, cut, left, right, depth


def good_labels(labels: DataFrame, doc_id: str) -> DataFrame:
    """Ids and ``good`` of labelled documents; of several labels the highest counts."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy(F.col("doc_id").alias(doc_id)).agg((F.max("quality") >= 1).alias("good"))


def fit(stats: DataFrame, labels: DataFrame, trees: int = 100, rows_per_tree: int = 256, doc_id: str = "doc_id", seed: int = 7) -> list[dict]:
    """The forest. ``stats`` has the counts of ``with_counts``; documents that fail the base rules play no part."""
    passing = stats.filter(~base_failed()).select(doc_id, *[c.alias(n) for n, c in statistics().items()])
    box = passing.agg(*[f(n).alias(f"{f.__name__}_{n}") for f in (F.min, F.max) for n in FEATURES], F.count(F.lit(1)).alias("n")).first()
    good = passing.join(good_labels(labels, doc_id).filter("good"), doc_id).drop("good")
    n = good.count()
    rows, n = (good, n) if n else (passing, box["n"])
    if not n:
        return []
    rows = rows.withColumn("_key", F.xxhash64(doc_id, *FEATURES, F.lit(seed)))
    wanted = 4 * trees * rows_per_tree
    offers = max(1, min(trees, wanted // n))  # trees that each row is offered to: few rows serve several trees
    chosen = rows.filter(F.pmod(F.shiftright("_key", 32), F.lit(1 << 24)) < min(1.0, wanted / n) * (1 << 24))
    chosen = chosen.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(offers - 1))))
    chosen = chosen.withColumn("tree", F.pmod(F.col("tree") + F.pmod("_key", F.lit(trees)), F.lit(trees)).cast("int"))
    low, high = (np.array([box[f"{side}_{f}"] for f in FEATURES], float) for side in ("min", "max"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1000 + tree)
        own = group.sort_values(["_key", *FEATURES])
        own = own.iloc[rng.permutation(len(own))[:rows_per_tree]]
        parts = grow(own[list(FEATURES)].to_numpy(float), low, high, rng, math.ceil(math.log2(rows_per_tree)) + 2)
        return pd.DataFrame([[tree, *parts]], columns=["tree", "feature", "cut", "left", "right", "depth"])

    found = chosen.groupBy("tree").applyInPandas(one, TREE).collect()  # one row for each tree
    return [r.asDict() for r in sorted(found, key=lambda r: r["tree"])]


def anomaly(df: DataFrame, forest: list[dict], rows_per_tree: int = 256, name: str = "anomaly") -> DataFrame:
    """Adds the anomaly, between 0 and 1; about 0.5 is usual. Needs the counts of ``with_counts``."""
    trees = [tuple(np.array(t[k]) for k in ("feature", "cut", "left", "right", "depth")) for t in forest]
    scale = mean_path(rows_per_tree)
    free = "_ratio"
    while any(c.lower().startswith(free) for c in df.columns):
        free = "_" + free
    names = [f"{free}{i}" for i in range(len(FEATURES))]
    own = statistics()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1)
            total = np.zeros(len(x))
            for feature, cut, left, right, depth in trees:
                node = np.zeros(len(x), np.int64)
                while True:
                    inner = np.flatnonzero(feature[node] >= 0)
                    if not len(inner):
                        break
                    at = node[inner]
                    node[inner] = np.where(x[inner, feature[at]] <= cut[at], left[at], right[at])
                total += depth[node]
            yield append(batch.drop_columns(names), {name: pa.array(2.0 ** (-total / max(len(trees), 1) / scale))})

    return df.drop(name).withColumns(dict(zip(names, (own[f] for f in FEATURES)))).mapInArrow(run, with_fields(df, [StructField(name, DoubleType())]))


def calibrate(scored: DataFrame, labels: DataFrame, cost: float = 10.0, doc_id: str = "doc_id") -> float:
    """The anomaly from which documents are rejected: the share of labelled bad ones rejected, less ``cost`` times that of good ones, is highest there.

    Labelled documents that pass the base rules all count; what reaches the driver is a histogram of BINS entries for each
    label. Thresholds are multiples of 1 / BINS; of equal ones the highest is taken.
    """
    known = scored.filter(~base_failed()).join(good_labels(labels, doc_id), doc_id)
    rows = known.groupBy("good", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).count().collect()
    counts = np.zeros((2, BINS + 1))
    for r in rows:
        counts[int(r["good"]), min(r["bin"], BINS)] += r["count"]
    totals = counts.sum(axis=1)
    if not totals.all():
        return 2.0
    rejected = counts[:, ::-1].cumsum(axis=1)[:, ::-1] / totals[:, None]  # by every threshold bin / BINS
    value = rejected[0] - cost * rejected[1]
    best = BINS - int(np.argmax(value[::-1]))
    return best / BINS if value[best] > 0 else 2.0


def judge(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", cost: float = 10.0, keep=lambda counted: counted) -> DataFrame:
    """``df`` with the counts, ``base_failed``, ``anomaly`` and ``kept``.

    ``keep`` is applied to the counted documents before they are written to the shared folder for the fit; a caller that
    needs no texts drops them there.
    """
    counted = materialize(keep(with_counts(df, text)), "counted")
    forest = fit(counted.select(doc_id, *COUNTS), labels, doc_id=doc_id)
    threshold = calibrate(anomaly(counted.select(doc_id, *COUNTS), forest), labels, cost, doc_id)
    out = anomaly(counted, forest).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
