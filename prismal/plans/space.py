"""Cutting point sets into boxes: a tree kept as written tables, used for exact neighbour search.

A box with too many rows is cut into slabs along its widest axis, at approximate quantiles; its slabs are cut
likewise, one level in each pass, until all are small enough or hold equal points only. Boxes are numbered by their
path from the root, so the parent of a box is its number shifted right.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.session import materialize

#: Bits of a box number for each level: a box is cut into at most 2 ** BITS slabs.
BITS = 4
MOST_LEVELS = 15
#: Up to this level the tree has at most 2 ** (BITS * level) boxes, 4,096, and may be broadcast.
BROADCAST_LEVEL = 3
ROOT = 1
# Distances are summed in another order than the bounds of boxes.
_SLACK = 1e-12


@dataclass(frozen=True)
class BoxTree:
    """``rows``: the points with ``_box``, the leaf that holds them. ``levels``: for each level ``_box``, ``n``, ``lo``, ``hi`` and ``leaf``; the corners are those of the points held."""

    rows: DataFrame
    levels: list[DataFrame]

    @property
    def leaves(self) -> DataFrame:
        """``_box`` and ``n`` of all leaves."""
        return reduce(DataFrame.unionByName, [level.where("leaf").select("_box", "n") for level in self.levels])


def _hinted(df: DataFrame, level: int) -> DataFrame:
    return F.broadcast(df) if level <= BROADCAST_LEVEL else df


def box_tree(points: DataFrame, columns: Sequence[str], box_rows: int) -> BoxTree:
    """Tree whose leaves hold at most ``box_rows`` points, or points that no cut parts (or that lie MOST_LEVELS deep)."""
    names = points.columns
    point = F.array(*[F.col(c) for c in columns])
    open_rows, done, levels = points.withColumn("_box", F.lit(ROOT).cast("long")), [], []
    steps = [i / 2**BITS for i in range(1, 2**BITS)]
    while True:
        level = len(levels)
        ends = [F.array(*[fn(c) for c in columns]).alias(name) for name, fn in (("lo", F.min), ("hi", F.max))]
        boxes = open_rows.groupBy("_box").agg(F.count(F.lit(1)).alias("n"), *ends)
        spread = F.zip_with("hi", "lo", lambda h, l: h - l)
        cut = (F.col("n") > box_rows) & (F.array_max(spread) > 0) if level < MOST_LEVELS else F.lit(False)
        boxes = materialize(boxes.withColumn("leaf", ~cut).withColumn("_axis", F.array_position(spread, F.array_max(spread)).cast("int")), "boxes")
        levels.append(boxes.drop("_axis"))
        crowded = boxes.where("NOT leaf").select("_box", "_axis")
        if crowded.isEmpty():
            return BoxTree(reduce(DataFrame.unionByName, [*done, open_rows]), levels)
        valued = open_rows.join(_hinted(crowded, level), "_box").withColumn("_v", F.element_at(point, F.col("_axis")))
        found = F.array_distinct(F.percentile_approx("_v", steps, 1000))
        cuts = valued.groupBy("_box").agg(found.alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        above = F.filter("_all", lambda c: c > F.col("_low"))
        cuts = materialize(cuts.select("_box", F.when(F.size(above) > 0, above).otherwise(F.array("_high")).alias("_cuts")), "cuts")
        slab = F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
        done.append(open_rows.join(_hinted(crowded, level), "_box", "left_anti"))
        placed = valued.join(_hinted(cuts, level), "_box")
        open_rows = materialize(placed.select(*names, (F.shiftleft("_box", BITS) + slab).alias("_box")), "placed")


def _gaps(columns: Sequence[str], metric: str) -> tuple[Column, Column]:
    """Least and greatest distance between a point and the box from ``lo`` to ``hi``."""
    least, most = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(columns):
        below, above = F.col("lo")[i] - F.col(c), F.col(c) - F.col("hi")[i]
        near, far = F.greatest(F.lit(0.0), below, above), F.greatest(F.abs(below), F.abs(above))
        least, most = (least + near * near, most + far * far) if metric == "euclidean" else (least + near, most + far)
    if metric == "euclidean":
        least, most = F.sqrt(least), F.sqrt(most)
    return F.nanvl(least, F.lit(0.0)) * (1 - _SLACK), F.nanvl(most, F.lit(float("inf"))) * (1 + _SLACK)


def boxes_in_reach(queries: DataFrame, key: str, columns: Sequence[str], tree: BoxTree, k: int, metric: str) -> DataFrame:
    """The queries with every leaf (``_box``, ``n``) that may hold one of their ``k`` nearest points, and ``gap``, the least distance to it.

    The tree is descended level by level. At each level some boxes nearest to a query hold ``k`` points together, so the
    farthest corner of these bounds its k-th distance: boxes beyond that are dropped with all that is below them.
    """
    names = queries.columns
    root = F.broadcast(tree.levels[0])  # one row
    least, most = _gaps(columns, metric)
    found = queries.withColumn("_box", F.lit(ROOT).cast("long")).join(root, "_box")
    found = found.select(*names, "_box", "n", "leaf", least.alias("gap"), most.alias("far"))
    own = Window.partitionBy(key)
    for level, boxes in enumerate(tree.levels[1:], 1):
        below = boxes.withColumn("_parent", F.shiftright("_box", BITS))
        down = found.where("NOT leaf").select(*names, F.col("_box").alias("_parent")).join(_hinted(below, level), "_parent")
        down = down.select(*names, "_box", "n", "leaf", least.alias("gap"), most.alias("far"))
        every = found.where("leaf").unionByName(down)
        held = F.sum("n").over(own.orderBy("far", "_box").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        every = every.withColumn("_held", held)
        bound = F.coalesce(F.min(F.when(F.col("_held") >= k, F.col("far"))).over(own), F.lit(float("inf")))
        found = materialize(every.withColumn("_bound", bound).where("gap <= _bound").drop("_held", "_bound"), "reach")
    return found.drop("far", "leaf")
