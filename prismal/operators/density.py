"""Density clusters (DBSCAN), exact for any number of columns.

Space is cut into cells whose diagonal is eps, so rows of one cell are always
neighbours: a cell with ``min_rows`` rows is all core and needs no pair at all.
Only rows of sparse cells (fewer than ``min_rows`` each) meet the rows around
them. Two core cells are linked through shrinking boxes: boxes wholly within eps
link, boxes wholly beyond eps drop out, and only small undecided boxes compare
their rows.

Up to ``GRID_COLUMNS`` columns the cells around a cell are listed. Beyond, where they
would be too many, rows meet over a grid of their ``GRID_COLUMNS`` columns of largest
variance (rows within eps lie within one step of it on each) and are then compared on
all columns; cells meet likewise by the lower corners of their boxes. The more columns,
the fewer rows share a cell: the cost then nears that of the rows close on the grid's columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.operators.features import standard_scale
from prismal.plans.graph import components
from prismal.plans.ordered import value_ranks
from prismal.plans.scalars import union_all
from prismal.session import materialize

GRID_COLUMNS = 4
PAIR_LIMIT = 4096


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cell steps that can hold a neighbour."""
    reach = range(-math.ceil(math.sqrt(d)) - 1, math.ceil(math.sqrt(d)) + 2)
    return [o for o in itertools.product(reach, repeat=d) if sum(max(0, abs(s) - 1) ** 2 for s in o) <= d]


def _around(cell: str, d: int, forward: bool = False) -> Column:
    """Array of neighbouring cells of a cell column (only the later half with ``forward``)."""
    chosen = [o for o in _offsets(d) if not forward or o > (0,) * d]
    parts = ["array(" + ", ".join(f"{cell}[{i}] + {s}L" for i, s in enumerate(o)) + ")" for o in chosen]
    return F.expr(f"array({', '.join(parts)})")


def _beside(place: str, m: int) -> Column:
    """Array of the places at most one step away on each axis of a grid."""
    parts = ["array(" + ", ".join(f"{place}[{i}] + {s}L" for i, s in enumerate(o)) + ")" for o in itertools.product((-1, 0, 1), repeat=m)]
    return F.expr(f"array({', '.join(parts)})")


def _place(point: str, step: float, axes: Sequence[int]) -> Column:
    """Place of a point array on a grid over some axes; the step is a little longer, so rounding never parts neighbours."""
    return F.array(*[F.floor(F.col(point)[i] / (step * (1 + 1e-6))).cast("long") for i in axes])


def _widest(points: DataFrame, d: int) -> list[int]:
    """The axes of largest variance, at most ``GRID_COLUMNS``."""
    spread = points.agg(*[F.coalesce(F.var_pop(F.col("_p")[i]), F.lit(0.0)).alias(f"v{i}") for i in range(d)]).first()
    return sorted(sorted(range(d), key=lambda i: -spread[i])[:GRID_COLUMNS])


def _apart(a: str, b: str, d: int) -> Column:
    """Squared distance between two point arrays."""
    return sum(((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)), F.lit(0.0))


def _box_gaps(d: int) -> tuple[Column, Column]:
    """Squared least and greatest distance between the tight boxes of sides a and b."""
    least, most = F.lit(0.0), F.lit(0.0)
    for i in range(d):
        lo_a, hi_a, lo_b, hi_b = (F.col(c)[i] for c in ("lo_a", "hi_a", "lo_b", "hi_b"))
        gap = F.greatest(F.lit(0.0), lo_a - hi_b, lo_b - hi_a)
        wide = F.greatest(hi_a - lo_b, hi_b - lo_a)
        least, most = least + gap * gap, most + wide * wide
    return least, most


def _cell_of(side: float, d: int) -> Column:
    return F.array(*[F.floor(F.col("_p")[i] / side).cast("long") for i in range(d)])


def _link_cells(core: DataFrame, side: float, eps: float, d: int, pair_limit: int, axes: Sequence[int] | None) -> DataFrame:
    """Pairs (cell_a, cell_b) of core cells with two core rows within eps."""
    def boxes(level: int) -> DataFrame:
        ends = [fn(F.col("_p")[i]).alias(f"{name}{i}") for name, fn in (("lo", F.min), ("hi", F.max)) for i in range(d)]
        found = core.groupBy(_cell_of(side / 2**level, d).alias("box")).agg(F.count(F.lit(1)).alias("n"), *ends)
        return found.select("box", "n", *[F.array(*[F.col(f"{name}{i}") for i in range(d)]).alias(name) for name in ("lo", "hi")])

    def named(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(F.col("box").alias(f"box_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "lo", "hi")])

    level, linked = 0, []
    cells = materialize(boxes(0), "boxes")
    if axes is None:
        near = named(cells, "a").select("*", F.explode(_around("box_a", d, forward=True)).alias("box_b")).join(named(cells, "b"), "box_b")
    else:  # lower corners of cells with rows within eps are at most eps and a side apart
        step = eps + side
        a = named(cells, "a").withColumn("_at", _place("lo_a", step, axes)).select("*", F.explode(_beside("_at", len(axes))).alias("_to")).drop("_at")
        near = a.join(named(cells, "b").withColumn("_to", _place("lo_b", step, axes)), "_to").where("box_a < box_b").drop("_to")
    open_pairs = near.select("*", F.col("box_a").alias("cell_a"), F.col("box_b").alias("cell_b"))
    while True:
        least, most = _box_gaps(d)
        state = F.when(most <= eps * eps, "linked").when(least > eps * eps, "apart").when(
            F.col("n_a") * F.col("n_b") <= pair_limit, "small").otherwise("open")
        judged = materialize(open_pairs.withColumn("_state", state).where("_state <> 'apart'"), "pairs")
        linked.append(judged.where("_state = 'linked'").select("cell_a", "cell_b"))
        small = judged.where("_state = 'small'").select("cell_a", "cell_b", "box_a", "box_b")
        rows = core.select(_cell_of(side / 2**level, d).alias("box"), "_p")
        met = (small.join(rows.select(F.col("box").alias("box_a"), F.col("_p").alias("_pa")), "box_a")
               .join(rows.select(F.col("box").alias("box_b"), F.col("_p").alias("_pb")), "box_b"))
        linked.append(met.where(_apart("_pa", "_pb", d) <= eps * eps).select("cell_a", "cell_b"))
        undecided = judged.where("_state = 'open'")
        if undecided.limit(1).count() == 0:
            break
        linked = [materialize(union_all(linked).distinct(), "links")]
        level += 1
        half = materialize(boxes(level), "boxes").withColumn("parent", F.transform("box", lambda v: F.shiftright(v, 1)))
        a = half.select(F.col("parent").alias("box_a"), *[F.col(c).alias(f"{c}_new_a") for c in ("box", "n", "lo", "hi")])
        b = half.select(F.col("parent").alias("box_b"), *[F.col(c).alias(f"{c}_new_b") for c in ("box", "n", "lo", "hi")])
        left = undecided.select("cell_a", "cell_b", "box_a", "box_b").join(linked[0], ["cell_a", "cell_b"], "left_anti")
        open_pairs = left.join(a, "box_a").join(b, "box_b").select(
            "cell_a", "cell_b", *[F.col(f"{c}_new_{s}").alias(f"{c}_{s}") for c in ("box", "n", "lo", "hi") for s in ("a", "b")])
    return union_all(linked).distinct()


def dbscan(df: DataFrame, columns: Sequence[str], key: str, eps: float, min_rows: int = 5, standardize: bool = False,
           pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``key``, ``cluster`` (0.. by lowest key, -1 for noise) and ``is_core``. The key is a unique bigint.

    A border row within reach of several clusters joins the one with the lowest key.
    """
    d = len(columns)
    if d < 1:
        raise ValueError("at least one column")
    rows = df.dropna(subset=list(columns)).select(F.col(key).cast("long").alias("_k"), *columns)
    if standardize:
        rows = standard_scale(rows, columns, population=True)
        columns = [f"{c}_std" for c in columns]
    side = eps / math.sqrt(d) * (1 - 1e-12)
    points = rows.select("_k", F.array(*[F.col(c).cast("double") for c in columns]).alias("_p")).withColumn("_cell", _cell_of(side, d))
    points = materialize(points, "points")
    if d <= GRID_COLUMNS:
        axes, at, around_row = None, "_cell", _around("_cell", d)
    else:
        axes, at = _widest(points, d), "_at"
        around_row = _beside("_at", len(axes))
        points = points.withColumn("_at", _place("_p", eps, axes))
    kept = list(dict.fromkeys(["_k", "_p", "_cell", at]))

    sizes = points.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    sized = points.join(sizes, "_cell")
    crowded = sized.where(F.col("_n") >= min_rows).select(*kept)
    sparse = sized.where(F.col("_n") < min_rows).select(*kept)
    around = sparse.select(F.col("_k"), F.col("_p").alias("_q"), F.explode(around_row).alias(at))
    counts = (around.join(points.select("_p", at), at).where(_apart("_q", "_p", d) <= eps * eps)
              .groupBy("_k").agg(F.count(F.lit(1)).alias("_near")))
    judged = materialize(sparse.join(counts, "_k").withColumn("_core", F.col("_near") >= min_rows), "judged")
    core = materialize(crowded.unionByName(judged.where("_core").select(*kept)), "core")

    cells = materialize(core.groupBy("_cell").agg(F.min("_k").alias("node")), "cells")
    links = _link_cells(core, side, eps, d, pair_limit, axes)
    edges = (links.join(cells.select(F.col("_cell").alias("cell_a"), F.col("node").alias("a")), "cell_a")
             .join(cells.select(F.col("_cell").alias("cell_b"), F.col("node").alias("b")), "cell_b"))
    roots = components(cells.select("node"), edges)
    labelled = cells.join(roots, "node").select("_cell", "root")
    ids = value_ranks(labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select("root", (F.col("dense_rank") - 1).cast("int").alias("cluster"))
    labelled = materialize(labelled.join(ids, "root").select("_cell", "cluster"), "labelled")

    core_rows = core.join(labelled, "_cell").select("_k", "cluster", F.lit(True).alias("is_core"))
    edge_rows = judged.where("NOT _core").select("_k", F.col("_p").alias("_q"), F.explode(around_row).alias(at))
    touched = (edge_rows.join(core.join(labelled, "_cell").select(at, "_p", "cluster"), at)
               .where(_apart("_q", "_p", d) <= eps * eps).groupBy("_k").agg(F.min("cluster").alias("cluster")))
    other_rows = judged.where("NOT _core").select("_k").join(touched, "_k", "left").select(
        "_k", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.lit(False).alias("is_core"))
    return core_rows.unionByName(other_rows).withColumnRenamed("_k", key)
