"""Exact quantiles with linear interpolation, at any input size.

Spark's ``percentile`` keeps a value -> count map of a whole group in one task.
That is the fast way while the input is small. Beyond the size limit the same
numbers come from two passes that keep no group in one place:

1. a ``percentile_approx`` sketch brackets each wanted rank between two values;
2. where both ends of a bracket are one value, it is the quantile; else
   values below the bracket are only counted, the few values inside it are
   counted per distinct value (both combine before the shuffle), split into
   bins, and only the bins that hold the wanted ranks are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismal.plans.scalars import attach_row
from prismal.plans.sizing import fits_value_map, may_broadcast
from prismal.session import materialize

SKETCH_ACCURACY = 50_000
BRACKET_BINS = 512


def quantile_name(column: str) -> str:
    return f"q_{column}"


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
              *, approx: bool = False, spread: bool | None = None) -> DataFrame:
    """One row per key group (one row without keys) with an array ``q_<column>`` per column.

    The array follows the order of ``probs``. ``spread`` forces or forbids the
    two-pass way; by default the size estimate decides.
    """
    keys = list(keys)
    columns = list(columns)
    slim = df.select(*keys, *columns)
    if approx:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return slim.groupBy(*keys).agg(*[
            F.percentile_approx(F.col(c).cast("double"), wanted, SKETCH_ACCURACY).alias(quantile_name(c))
            for c in columns
        ])
    if spread is None:
        spread = not fits_value_map(slim)
    if not spread:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return slim.groupBy(*keys).agg(*[
            F.percentile(F.col(c).cast("double"), wanted).alias(quantile_name(c)) for c in columns
        ])
    order = sorted(set(float(p) for p in probs))
    found = _bracketed(slim, columns, order, keys)
    at = [order.index(float(p)) for p in probs]
    return found.select(*keys, *[
        F.array(*[F.col(quantile_name(c))[i] for i in at]).alias(quantile_name(c)) for c in columns])


def summarize(df: DataFrame, aggregates: Sequence[Column], columns: Sequence[str], probs: Sequence[float],
              keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates and quantiles of the same groups (keys without missing values).

    Two aggregates side by side: the plain one keeps whole-stage code, which
    ``percentile`` in the same aggregate would take away.
    """
    keys = list(keys)
    cuts = quantiles(df, columns, probs, keys)
    if not aggregates:
        return cuts
    plain = df.groupBy(*keys).agg(*aggregates)
    return plain.join(cuts, keys) if keys else attach_row(plain, cuts)


def _bracketed(df: DataFrame, columns: list[str], probs: list[float], keys: list[str]) -> DataFrame:
    slack = 4.0 / SKETCH_ACCURACY
    edges: list[float] = [0.0, 1.0]
    for p in probs:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    wanted = F.array(*[F.lit(e) for e in edges])
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    sketch = doubles.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[
        F.struct(F.count(c).alias("n"), F.percentile_approx(c, wanted, SKETCH_ACCURACY).alias("edge")).alias(f"_s_{c}")
        for c in columns
    ])
    sketch = materialize(sketch, "sketch")  # a row for each group, read by every pass
    if keys:
        match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        # Joined by their keys, the rows of a large group would be ordered by one task.
        tagged = doubles.join(F.broadcast(sketch) if may_broadcast(sketch) else sketch, match)
    else:
        row = sketch.first()
        known = {c: (row[f"_s_{c}"]["n"], row[f"_s_{c}"]["edge"] or [None] * len(edges)) for c in columns}
        tagged = doubles

    steps = range(len(probs))

    def count_of(column: str) -> Column:
        return F.col(f"_s_{column}.n") if keys else F.lit(known[column][0]).cast("long")

    def bracket(column: str, i: int) -> tuple[Column, Column]:
        # Below SKETCH_ACCURACY rows the whole group is the bracket; above, the slack
        # covers the sketch error and the two neighbouring ranks.
        if keys:
            edge, small = F.col(f"_s_{column}.edge"), F.col(f"_s_{column}.n") <= SKETCH_ACCURACY
            return (F.when(small, edge[0]).otherwise(edge[2 * i + 2]), F.when(small, edge[1]).otherwise(edge[2 * i + 3]))
        return tuple(F.lit(v).cast("double") for v in ends(column, i))

    def ends(column: str, i: int) -> tuple[float | None, float | None]:
        n, edge = known[column]
        return (edge[0], edge[1]) if n <= SKETCH_ACCURACY else (edge[2 * i + 2], edge[2 * i + 3])

    def settled(column: str, i: int) -> Column:
        """The value that is the whole bracket, else null."""
        low, high = bracket(column, i)
        return F.when(low == high, low)

    def inside(column: str, i: int) -> Column:
        low, high = bracket(column, i)
        return (low < high) & F.col(column).between(low, high)

    def entry(column: str, i: int) -> Column:
        low, high = bracket(column, i)
        value, width = F.col(column), high - low
        bin_no = F.when(width > 0, F.least(
            F.lit(BRACKET_BINS - 1), F.floor((value - low) / width * BRACKET_BINS).cast("int"))).otherwise(F.lit(0))
        return F.when(inside(column, i), F.struct(
            F.lit(column).alias("_column"), F.lit(i).alias("_i"), count_of(column).alias("_all"), bin_no.alias("_bin"), value.alias("_v")))

    places = [(c, i) for c in columns for i in steps if keys or ends(c, i)[0] != ends(c, i)[1]]
    if not places:
        return sketch.select(*[F.array(*[settled(c, i) for i in steps]).alias(quantile_name(c)) for c in columns])
    # Pass over all rows: only counters. Pass over the few rows inside a bracket: values.
    under = tagged.groupBy(*keys).agg(*[F.count_if(F.col(c) < bracket(c, i)[0]).alias(f"_u_{i}_{c}") for c, i in places])
    under = under.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_column"), F.lit(i).alias("_i"), F.col(f"_u_{i}_{c}").alias("_under")) for c, i in places])))
    under = under.select(*[F.col(k).alias(f"_wk_{k}") for k in keys], F.col("_column").alias("_w_column"), F.col("_i").alias("_w_i"), "_under")
    cells = (
        tagged.where(reduce(lambda x, y: x | y, [inside(c, i) for c, i in places]))
        .select(*keys, F.explode(F.filter(F.array(*[entry(c, i) for c, i in places]), lambda e: e.isNotNull())).alias("_e"))
        .select(*keys, "_e.*")
        .groupBy(*keys, "_column", "_i", "_all", "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    slot = [*keys, "_column", "_i", "_all"]
    by_bin = Window.partitionBy(*slot).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.array(*[F.lit(p) for p in probs])[F.col("_i")] * (F.col("_all") - 1)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_bin_n"))
    beside = [F.col(k).eqNullSafe(F.col(f"_wk_{k}")) for k in keys] + [F.col("_column") == F.col("_w_column"), F.col("_i") == F.col("_w_i")]
    bins = (
        cells.groupBy(*slot, "_bin").agg(F.sum("_n").alias("_bin_n")).join(under, beside)
        .withColumn("_before", F.col("_under") + F.coalesce(F.sum("_bin_n").over(by_bin), F.lit(0)))
        .where(holds(F.floor(rank)) | holds(F.ceil(rank)))
        .select(*[F.col(s).alias(f"_b_{s}") for s in slot], F.col("_bin").alias("_b__bin"), "_before")
    )
    match = [F.col(s).eqNullSafe(F.col(f"_b_{s}")) for s in slot] + [F.col("_bin") == F.col("_b__bin")]
    running = Window.partitionBy(*slot, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    low_rank, high_rank = F.floor(rank), F.ceil(rank)
    picked = (
        cells.join(bins, match).withColumn("_upto", F.col("_before") + F.sum("_n").over(running))
        .groupBy(*slot).agg(
            F.min(F.when(F.col("_upto") > low_rank, F.col("_v"))).alias("_low"),
            F.min(F.when(F.col("_upto") > high_rank, F.col("_v"))).alias("_high"))
        .withColumn("_q", F.when(low_rank == high_rank, F.col("_low")).otherwise(
            (high_rank - rank) * F.col("_low") + (rank - low_rank) * F.col("_high")))
    )
    found = picked.groupBy(*keys).agg(*[
        F.array(*[F.max(F.when((F.col("_column") == c) & (F.col("_i") == i), F.col("_q"))) for i in range(len(probs))])
        .alias(quantile_name(c)) for c in columns])
    both = lambda c: F.array(*[F.coalesce(settled(c, i), F.col(quantile_name(c))[i]) for i in steps]).alias(quantile_name(c))
    if not keys:
        return found.select(*[both(c) for c in columns])
    # Groups without any value keep their row, as with the one-pass way.
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return sketch.join(found, match, "left").select(*[F.col(f"_k_{k}").alias(k) for k in keys], *[both(c) for c in columns])


def fence_row(df: DataFrame, columns: Sequence[str], k: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles and fences: a struct ``f_<column>`` of q1, q3, iqr, lower, upper per column."""
    found = quantiles(df, columns, [0.25, 0.75], keys)
    structs = []
    for c in columns:
        q1, q3 = F.col(quantile_name(c))[0], F.col(quantile_name(c))[1]
        structs.append(F.struct(
            q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"),
            (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper")).alias(f"f_{c}"))
    return found.select(*keys, *structs)
