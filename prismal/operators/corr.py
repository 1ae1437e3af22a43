"""Pearson, Spearman and Kendall correlation in long form, and the rankings drawn from it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.functions.moments import pair_corr
from prismal.functions.text import bands
from prismal.plans.ordered import running_totals, value_ranks
from prismal.plans.scalars import rows_from_row, union_all
from prismal.sources.tables import roles

#: Bits of the rank that one round of inversion counting looks at.
RADIX_BITS = 3
STRENGTH = [(0.8, "Very Strong"), (0.6, "Strong"), (0.4, "Moderate"), (0.2, "Weak")]


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per unordered pair, all pairs in one pass; a pair uses the rows where both are present."""
    columns = list(columns or roles(df)["numeric"])
    pairs = list(combinations(columns, 2))
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = doubles.agg(*[pair_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return rows_from_row(row, [
        F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.col(f"r{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct complete (x, y) values per pair with their count; repeats combine before the shuffle."""
    entries = [F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
               for i, (a, b) in enumerate(pairs)]
    rows = df.select(F.inline(F.array(*entries))).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, cells: DataFrame, pairs: Sequence[tuple[str, str]], blocks: int | None) -> DataFrame:
    """Cells with the rank and the dense rank (``rank_x``, ``dense_x``, and so on) of both values among the pair's rows.

    A column without missing values is ranked once for all its pairs. Only where a pair loses rows are both its sides ranked for it alone.
    """
    names = sorted({c for pair in pairs for c in pair})
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(names)]).first()
    whole = {c: i for i, c in enumerate(names) if not gaps[f"g{i}"]}
    lossy = [i for i, (a, b) in enumerate(pairs) if a not in whole or b not in whole]
    sets = {(i, side): len(names) + 2 * i + side if i in lossy else whole[c] for i, pair in enumerate(pairs) for side, c in enumerate(pair)}
    found = []
    if len(lossy) < len(pairs):
        entries = [F.struct(F.lit(i).alias("set"), F.col(c).cast("double").alias("v")) for c, i in whole.items()]
        found.append(df.select(F.inline(F.array(*entries))).groupBy("set", "v").agg(F.count(F.lit(1)).alias("n")))
    if lossy:
        sides = F.inline(F.array(*[F.struct((F.col("pair") * 2 + len(names) + side).alias("set"), F.col(c).alias("v"), "n") for side, c in enumerate("xy")]))
        found.append(cells.where(F.col("pair").isin(lossy)).select(sides).groupBy("set", "v").agg(F.sum("n").alias("n")))
    ranks = value_ranks(union_all(found), "v", keys=["set"], blocks=blocks)
    out = cells
    for side, c in enumerate("xy"):
        number = F.array(*[F.lit(sets[i, side]) for i in range(len(pairs))])[F.col("pair")]
        mine = ranks.select(F.col("set").alias(f"s_{c}"), F.col("v").alias(f"v_{c}"), F.col("avg_rank").alias(f"rank_{c}"), F.col("dense_rank").alias(f"dense_{c}"))
        out = out.withColumn("_set", number).join(mine, (F.col("_set") == F.col(f"s_{c}")) & (F.col(c) == F.col(f"v_{c}"))).drop("_set", f"s_{c}", f"v_{c}")
    return out


def _named(values: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    names = [F.array(*[F.lit(p[side]) for p in pairs]) for side in (0, 1)]
    return values.select(names[0][F.col("pair")].alias("var_1"), names[1][F.col("pair")].alias("var_2"), "corr")


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks, per pair over its complete rows."""
    columns = list(columns or roles(df)["numeric"])
    pairs = list(combinations(columns, 2))
    cells = pair_cells(df, pairs)
    totals = cells.groupBy("pair").agg(F.sum("n").alias("total"))
    joined = _ranked(df, cells, pairs, blocks)
    centre = (F.col("total") + 1) / 2.0
    dx, dy = F.col("rank_x") - centre, F.col("rank_y") - centre
    sums = joined.join(F.broadcast(totals), "pair").groupBy("pair").agg(  # one total per column pair
        F.sum(F.col("n") * dx * dy).alias("xy"), F.sum(F.col("n") * dx * dx).alias("xx"), F.sum(F.col("n") * dy * dy).alias("yy"))
    return _named(sums.withColumn("corr", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))), pairs)


def discordant_pairs(ranked: DataFrame, blocks: int | None = None) -> DataFrame:
    """``discordant`` by ``pair``: the inversions between x ranks ``r`` (from 0) and ``y``, of rows that count ``n`` times.

    Radix-partitioned: every round looks at RADIX_BITS bits of the ranks, from the highest down. Rows that agree in the higher bits are a
    part, the bits of the round deal them to smaller parts. Walking a part in descending y, each smaller part's running total says how many rows
    of lower ranks have come before. Inversions within a smaller part are left to the next round, so a row takes part once in each round.
    """
    digits = 1 << RADIX_BITS
    widest = ranked.groupBy("pair").agg(F.max("r").alias("top"))
    turn = F.explode(F.sequence(F.lit(0), F.floor((F.length(F.bin("top")) - 1) / RADIX_BITS).cast("int"))).alias("turn")
    digit = F.expr(f"shiftright(r, turn * {RADIX_BITS}) & {digits - 1}")
    parts = (ranked.join(F.broadcast(widest), "pair").select("pair", "r", "y", "n", turn)  # one row per column pair
             .select("pair", "turn", F.expr(f"shiftright(r, (turn + 1) * {RADIX_BITS})").alias("part"), "y", "n", digit.alias("digit"))
             .groupBy("pair", "turn", "part", "y").agg(*[F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("n"))), F.lit(0)).alias(f"n{d}") for d in range(digits)]))
    walked = running_totals(parts, "y", {f"u{d}": f"n{d}" for d in range(digits - 1)}, ["pair", "turn", "part"], descending=True, blocks=blocks)
    below, found = F.lit(0).cast("long"), F.lit(0.0)
    for d in range(1, digits):
        below = below + F.col(f"u{d - 1}") - F.col(f"n{d - 1}")  # equal y is no inversion
        found = found + F.col(f"n{d}").cast("double") * below
    return walked.groupBy("pair").agg(F.sum(found).alias("discordant"))


def kendall_parts(df: DataFrame, pairs: Sequence[tuple[str, str]], blocks: int | None = None) -> DataFrame:
    """Pair counts behind tau-b: all pairs, ties in x, y and both, and discordant pairs. No pair of rows is ever formed."""
    cells = pair_cells(df, pairs)
    ranked = _ranked(df, cells, pairs, blocks).select("pair", "y", "n", (F.col("dense_x") - 1).alias("r"))
    discordant = discordant_pairs(ranked, blocks)

    def ties(keys: list[str], name: str) -> DataFrame:
        n = F.col("m").cast("double")
        return (cells.groupBy("pair", *keys).agg(F.sum("n").alias("m")).groupBy("pair")
                .agg(F.sum(n * (n - 1) / 2).alias(name), *([F.sum(n).alias("total")] if name == "ties_xy" else []),
                     *([F.sum(n * (n - 1) * (n - 2)).alias(f"{name}_3"), F.sum(n * (n - 1) * (2 * n + 5)).alias(f"{name}_v")])))

    out = ties(["x", "y"], "ties_xy")
    for other in (ties(["x"], "ties_x"), ties(["y"], "ties_y"), discordant):
        out = out.join(other, "pair")
    return out.withColumn("pairs", F.col("total") * (F.col("total") - 1) / 2)


def kendall_pairs(df: DataFrame, columns: Sequence[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Kendall's tau-b per pair."""
    columns = list(columns or roles(df)["numeric"])
    pairs = list(combinations(columns, 2))
    c = F.col
    score = c("pairs") - c("ties_x") - c("ties_y") + c("ties_xy") - 2 * c("discordant")
    tau = F.try_divide(score, F.sqrt((c("pairs") - c("ties_x")) * (c("pairs") - c("ties_y"))))
    return _named(kendall_parts(df, pairs, blocks).withColumn("corr", tau), pairs)


METHODS = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return METHODS[method](df, columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Both directions of every pair, without the diagonal."""
    pairs = correlation_pairs(df, columns, method)
    turned = F.explode(F.array(F.struct(F.col("var_1").alias("a"), F.col("var_2").alias("b")),
                               F.struct(F.col("var_2").alias("a"), F.col("var_1").alias("b"))))
    return pairs.select(turned.alias("t"), "corr").select(F.col("t.a").alias("var_1"), F.col("t.b").alias("var_2"), "corr")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", n: int | None = 10) -> DataFrame:
    """The n strongest pairs; all with None."""
    ranked = correlation_pairs(df, columns, method).where("corr IS NOT NULL").orderBy(
        F.abs("corr").desc(), "var_1", "var_2")
    return ranked if n is None else ranked.limit(n)


def correlation_strength(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", n: int | None = None) -> DataFrame:
    return top_correlations(df, columns, method, n).select(
        "*", bands(F.abs("corr"), STRENGTH, "Very Weak").alias("strength"),
        F.when(F.col("corr") > 0, "Positive").otherwise("Negative").alias("direction"))


def best_partner(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """The most correlated other column of every column."""
    best = F.max_by(F.struct("var_2", "corr"), F.struct(F.abs("corr"), F.col("var_2")))
    return correlation_matrix(df, columns, method).where("corr IS NOT NULL").groupBy("var_1").agg(best.alias("b")).select(
        "var_1", F.col("b.var_2").alias("partner"), F.col("b.corr").alias("corr"))


def correlation_insights(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Collinear pairs (>= .8), isolated columns (all < .2), and partners above .4 per column."""
    matrix = correlation_matrix(df, columns).where("corr IS NOT NULL")
    per = matrix.groupBy("var_1").agg(F.max(F.abs("corr")).alias("most"), F.count_if(F.abs("corr") > 0.4).alias("partners"))
    blank = F.lit(None).cast("string")
    return union_all([
        matrix.where((F.abs("corr") >= 0.8) & (F.col("var_1") < F.col("var_2"))).select(
            F.lit("multicollinear").alias("kind"), "var_1", "var_2", F.abs("corr").alias("value")),
        per.where("most < 0.2").select(F.lit("isolated").alias("kind"), "var_1", blank.alias("var_2"), F.col("most").alias("value")),
        per.where("partners > 0").select(F.lit("connected").alias("kind"), "var_1", blank.alias("var_2"),
                                         F.col("partners").cast("double").alias("value"))])


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.6) -> DataFrame:
    return pearson_pairs(df, columns).where(F.abs("corr") > above).orderBy(F.abs("corr").desc(), "var_1", "var_2")
