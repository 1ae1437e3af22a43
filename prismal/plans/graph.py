"""Connected components by repeated minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.session import materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and the lowest node of its component as ``root``.

    ``nodes`` has ``node``; ``edges`` has ``a`` and ``b``. Every round takes the
    lowest label among the neighbours and then follows the label once, so long
    chains halve. Rounds are cut by written tables and stop when nothing moves;
    labels only sink, so they do stop.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("_near")))
        lower = labels.join(near, "node", "left").select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("_now"))
        ahead = lower.select(F.col("node").alias("_now"), F.col("_now").alias("_next"))
        moved = materialize(lower.join(ahead, "_now").select("node", "_was", F.col("_next").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root < _was").limit(1).count() == 0:
            return labels
