"""Mixing sources to target weights by proportionate-fair scheduling.

Every source's documents, in hash order, are cut into blocks of about equal size. In the ideal mix all sources flow at
once, each at a rate proportional to its weight, and where one runs out the others share its weight in proportion. Of the
blocks, block j of a source is released at the slot in which the ideal mix begins it and due by the end of the slot in which
the ideal mix ends it; the earliest deadline goes first among the released. At every slot a source is then less than one
block from what the ideal mix has given it. While all sources last, the releases and deadlines are floor(j / w) and
ceil((j + 1) / w) of the weight w. All of it is reckoned in whole numbers, so nothing drifts however long the mix is. The driver
deals the slots, a number for each block, and writes them out by ``slots`` at a time. No document is dropped or repeated.

Defined results: a null text counts as empty; a null source is a source of its own; repeated rows are all mixed in, rows equal in all that
orders them standing in either order; an empty table gives an empty table; columns named like the outputs are replaced, all others are kept.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.session import materialize, work_path

NO_SOURCE = "\x00none"
REST = "\x00rest"


def frame_counts(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Weights rounded to slots of a frame: largest remainders, at least one each. ``mix`` takes the weights as they are."""
    slots = max(slots, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: Fraction(w) / Fraction(total) * slots for s, w in weights.items()}
    counts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    spare = slots - sum(counts.values())
    for i in range(max(spare, 0)):
        counts[order[i % len(order)]] += 1
    return counts  # where many had to be raised to one, the frame is as long as their sum


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(w.denominator for w in exact))
    return [w.numerator * (common // w.denominator) for w in exact]


def deal(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int]]:
    """Source and block number of every slot in turn, earliest deadline first among released blocks; every source has a block.

    A source is drained after blocks / weight. At the virtual time v the ideal mix has dealt the blocks of the drained sources and
    v times the weights of the others.
    """
    n = len(blocks)
    shift = 2 * max(weights, default=1).bit_length()  # fractions that differ have different keys
    order = sorted(range(n), key=lambda s: (blocks[s] << shift) // weights[s])
    drained = [(blocks[s] << shift) // weights[s] for s in order]
    given = list(accumulate((blocks[s] for s in order), initial=0))
    rates = list(accumulate((weights[s] for s in order), lambda left, w: left - w, initial=sum(weights)))

    def at(s: int, j: int) -> tuple[int, int]:
        """The slot boundaries before and behind the moment at which the ideal mix has dealt j blocks of the source."""
        k = bisect_right(drained, (j << shift) // weights[s])
        part = rates[k] * j
        return given[k] + part // weights[s], given[k] - (-part // weights[s])

    number = [0] * n
    next_ = [at(s, 1) for s in range(n)]  # where the block at hand ends and the following one begins
    waiting = list(range(n))  # release * n + source
    released: list[int] = []  # deadline * n + source
    for slot in range(sum(blocks)):
        while waiting and waiting[0] < (slot + 1) * n:
            s = heapq.heappop(waiting) % n
            heapq.heappush(released, next_[s][1] * n + s)
        s = heapq.heappop(released) % n
        yield s, number[s]
        number[s] += 1
        if number[s] < blocks[s]:
            heapq.heappush(waiting, next_[s][0] * n + s)
            next_[s] = at(s, number[s] + 1)


def schedule(counts: dict[str, int]) -> list[str]:
    """The source of every slot of one frame in which each has its count."""
    names = sorted(counts)
    sizes = [counts[s] for s in names]
    return [names[s] for s, _ in deal(sizes, sizes)]


def dealt(spark: SparkSession, names: list[str], blocks: list[int], weights: list[int], slots: int) -> DataFrame:
    """``_source``, ``_number`` and ``slot`` of every block; written in parts where there are more than ``slots``."""
    turns, start, path = deal(blocks, weights), 0, None
    while True:
        part = list(islice(turns, slots))
        table = pa.table({"_source": pa.array([names[s] for s, _ in part], pa.string()), "_number": pa.array([j for _, j in part], pa.int64()),
                          "slot": pa.array(range(start, start + len(part)), pa.int64())})
        frame = spark.createDataFrame(table)
        start += len(part)
        if path is None and len(part) < slots:
            return frame
        path = path or work_path(spark, "slots")
        frame.write.mode("append").parquet(path)
        if len(part) < slots:
            return spark.read.parquet(path)


def free_of_underscores(columns: list[str]) -> dict[str, str]:
    """New names for the columns whose names begin with an underscore, as those of the steps here do."""
    free = "column"
    while any(c.lower().startswith(free) for c in columns):
        free += "s"
    return {c: f"{free}{i}" for i, c in enumerate(columns) if c.startswith("_")}


def with_blocks(rows: DataFrame, block_size: int) -> DataFrame:
    """Adds ``block`` and ``_row``: rows of ``_source`` in the order of ``_order``, ``_tie``, a new block with every ``block_size`` of ``_size``.

    A source is split by ranges of the hash, each of about 2,000 rows, so that no task holds a whole source.
    """
    counts = materialize(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n")), "sources")
    parts = F.greatest(F.ceil(F.col("_n") / 2000), F.lit(1)).cast("long")
    top = F.col("_order").cast("double") / float(1 << 63)  # 0 to 1 along the hash
    rows = rows.join(counts, "_source").withColumn("_part", F.least(F.floor(top * parts), parts - 1))
    sums = rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("_source", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("_sum", "_base"), ("_rows", "_first"))]), "parts")
    own = Window.partitionBy("_source", "_part").orderBy("_order", "_tie")
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).withColumn("_at", F.row_number().over(own)).join(sums, ["_source", "_part"])
    rows = rows.withColumn("block", F.floor((F.col("_before") + F.col("_base")) / block_size)).withColumn("_row", F.col("_first") + F.col("_at"))
    return rows.drop("_n", "_part", "_base", "_before", "_at", "_first")


def mix(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        block_size: int = 200_000, slots: int = 1_000_000, keep=lambda rows: rows) -> DataFrame:
    """``df`` with ``block`` (number in its source), ``slot`` (of the whole mix) and ``place`` (within the block).

    ``weights`` gives sources their shares of the mix; sources it doesn't name share the weight of the key ``"*"`` as one, or
    an equal weight. Without weights every source, however many there are, has the square root of its size. Sizes are characters and one for each document. Order by ``slot``, ``place`` to read the mix.
    ``keep`` is applied to the measured documents before they are dealt out; a caller that needs no texts drops them there.
    """
    own_names = free_of_underscores(df.columns)
    df, (source, doc_id, text) = df.withColumnsRenamed(own_names), (own_names.get(c, c) for c in (source, doc_id, text))
    name = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
    size = F.length(F.coalesce(F.col(text), F.lit(""))) + 1
    if weights is not None:
        name = F.when(name.isin([s for s in weights if s != "*"]), name).otherwise(F.lit(REST))
    rows = df.drop("block", "slot", "place").withColumns({
        "_source": name, "_size": size.cast("long"),
        "_order": F.shiftrightunsigned(F.xxhash64(doc_id, text), 1), "_tie": F.xxhash64(F.lit(1), doc_id, text)})
    # Not written: what follows reads the small columns of it once for the blocks, and all columns once for the answer.
    rows = with_blocks(keep(rows), block_size)
    # Blocks are numbered without gaps: a document longer than a block leaves numbers out.
    per = materialize(rows.groupBy("_source", "block").agg(F.min("_row").alias("_begin"), F.sum("_size").alias("_sum")), "per-block")
    part = Window.partitionBy("_source", F.floor(F.col("block") / 4096))
    low = per.groupBy("_source", F.floor(F.col("block") / 4096).alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    low = low.select("_source", "_part", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_base"))
    per = per.withColumn("_part", F.floor(F.col("block") / 4096)).withColumn("_own", F.row_number().over(part.orderBy("block")) - 1)
    per = per.join(low, ["_source", "_part"]).select("_source", "block", "_begin", "_sum", (F.col("_own") + F.col("_base")).cast("long").alias("_number"))
    per = materialize(per, "numbered")
    sizes = per.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_sum").alias("total"))
    names, blocks, totals = sizes.orderBy("_source").toArrow().select(["_source", "n", "total"]).to_pydict().values()  # one row for each source
    if weights is None:
        target = [total ** 0.5 for total in totals]
    else:
        target = [float(weights[s] if s in weights else weights.get("*", 1.0)) for s in names]
        if any(w <= 0 for w in target):
            raise ValueError("weights must be positive")
    lines = dealt(df.sparkSession, names, blocks, whole(target), slots)
    numbered = per.join(lines, ["_source", "_number"]).select("_source", "block", "_number", "_begin", "slot")
    numbered = materialize(numbered, "slots")  # of known size, so texts are not shuffled to meet what could be broadcast
    out = rows.join(numbered, ["_source", "block"])
    place = F.col("_row") - F.col("_begin") + 1
    kept = [c for c in rows.columns if not c.startswith("_") and c != "block"]
    out = out.withColumn("place", place).select(*kept, F.col("_number").alias("block"), "slot", "place")
    return out.withColumnsRenamed({new: old for old, new in own_names.items()})


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix, dealt out by ranges of it."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
