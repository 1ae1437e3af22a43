"""Ordered passes (running totals, previous values, ranks, positions) that do not need one global window.

Rows are dealt to partitions by measured ranges of the order column and written with the number of their
partition. Each partition is ordered on its own, the totals of the partitions make one small table, and a join
carries them across. No size is guessed and no border goes through the driver: Spark samples the borders in its
range exchange, and how many ranges there are follows ``spark.sql.shuffle.partitions``. Where the files below the
frame fit one task together, an ordinary window does the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.plans.sizing import inputs_fit_one_task
from prismal.session import materialize

BLOCK = "_block"


def with_blocks(df: DataFrame, order: str, keys: Sequence[str] = (), blocks: int | None = None) -> tuple[DataFrame, bool]:
    """Add a block number that never falls as (``keys``, ``order``) grow; returns the frame and whether there are several.

    Missing values sort first, NaN last. Equal values share a block, so callers collapse repeats (value, count)
    before ordering. ``blocks``: how many ranges; by default the session's shuffle partitions, as far as they fill.
    """
    if blocks == 1 or blocks is None and inputs_fit_one_task(df):
        return df.withColumn(BLOCK, F.lit(0)), False
    along = [F.col(c) for c in (*keys, order)]
    ranged = df.repartitionByRange(blocks, *along) if blocks else df.repartitionByRange(*along)
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id()), "ranges"), True


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(BLOCK) == F.col("_k_block")]


def running_totals(df: DataFrame, order: str, sums: Mapping[str, str], keys: Sequence[str] = (),
                   descending: bool = False, blocks: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{new: source}`` along ``order`` (rows with equal order share a total)."""
    keys = list(keys)
    placed, several = with_blocks(df, order, keys, blocks)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, BLOCK).orderBy(direction).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if not several:
        return placed.select("*", *[F.sum(src).over(inside).alias(new) for new, src in sums.items()]).drop(BLOCK)
    block_dir = F.col(BLOCK).desc() if descending else F.col(BLOCK).asc()
    earlier = Window.partitionBy(*keys).orderBy(block_dir).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, BLOCK).agg(*[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()])
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_k_block"),
        *[F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_c_{new}") for new in sums])
    return placed.join(carried, _same(keys)).select(
        *df.columns, *[(F.col(f"_c_{new}") + F.sum(src).over(inside)).alias(new) for new, src in sums.items()])


def with_previous(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (),
                  prefix: str = "prev_", blocks: int | None = None) -> DataFrame:
    """Add the values of the previous row along ``order`` (unique within the keys)."""
    keys = list(keys)
    placed, several = with_blocks(df, order, keys, blocks)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    if not several:
        return placed.select("*", *[F.lag(v).over(inside).alias(prefix + v) for v in values]).drop(BLOCK)
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    # The row without an order value sorts first: it is a block's last row only where it is its only one.
    last = F.coalesce(F.max_by(packed, F.col(order)), F.any_value(packed)).alias("_last")
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = placed.groupBy(*keys, BLOCK).agg(last).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_k_block"), F.lag("_last").over(across).alias("_carry"))
    first = F.row_number().over(inside) == 1
    return placed.join(carried, _same(keys)).select(
        *df.columns,
        *[F.when(first, F.col(f"_carry.{v}")).otherwise(F.lag(v).over(inside)).alias(prefix + v) for v in values])


def value_ranks(counts: DataFrame, value: str, n: str = "n", keys: Sequence[str] = (),
                blocks: int | None = None) -> DataFrame:
    """Average and dense rank per distinct value of a (value, count) frame."""
    ranked = running_totals(counts.withColumn("_one", F.lit(1).cast("long")), value,
                            {"_upto": n, "dense_rank": "_one"}, keys, blocks=blocks)
    return ranked.withColumn("avg_rank", F.col("_upto") - F.col(n) + (F.col(n) + 1) / 2.0).drop("_upto", "_one")


def positions(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows, written, with their number from 0 along the columns of ``order``.

    Rows that are equal in all these columns are numbered in any order. No window holds more than one row for each
    partition: a row's number is its place within its partition plus the rows of the partitions before.
    """
    along = [F.col(c) for c in order]
    placed = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "positions")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = placed.withColumn("_part", part).join(F.broadcast(base), "_part")
    return joined.select(*df.columns, (F.col("_base") + place).alias(name))
