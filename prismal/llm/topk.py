"""Exact largest inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of neighbours in length, dealt out by ranges, so that equal lengths
may span buckets. A first round over the longest bucket gives every query a score that its k-th best can't fall
below. From that follows, for each bucket, the cosine that a vector must reach: above 1 the bucket is
passed over before its vectors are shipped; if it is high, the query's largest coordinates bound those of any vector that reaches it, and just
vectors within the bounds are verified (coordinate pruning); else vectors too short for the score are left out
(length pruning). What remains is verified with full products. Queries travel in blocks; a block meets a bucket
if one of its queries may find something there.

Components are taken as floor(256 * x) in double arithmetic. Sums are exact: in double arithmetic as long as no product can pass 2^53, else in
integers of any size; scores beyond 64 bits are held at the largest such integer.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without an id take no part; of vectors of
unequal length the shorter counts as padded with zeros; an empty vector scores 0 with any; of equal scores the smaller id comes first;
rows with the query's own id are never its answers; every row of an id is a candidate of its own; equal query rows are answered once;
an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.plans.ordered import running_totals
from prismal.session import materialize

#: Lengths are rounded; nothing that reaches the floor may be left out.
SLACK = 1 + 1e-9
#: From this cosine on, coordinates are looked at before the full product.
COORDINATE_COSINE = 0.6
FOCUS = 4


def quantized(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    """floor(256 * x) of all vectors as a matrix of doubles, padded with zeros."""
    lists = batch.column(column)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(counts), width))
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[rows, places] = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


BLOCK = "part long, place long, ids binary, matrix binary, n long, longest double"


def packed(rows: DataFrame, per: int, width: int) -> DataFrame:
    """Rows (``id``, ``vector``), in the order of their partitions, as blocks of at most ``per``.

    ``part`` and ``place`` order the blocks; ``matrix`` holds 32-bit floats where those are exact, else 64-bit ones; ``longest`` is the
    largest length in the block.
    """
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("n", pa.int64()), ("longest", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, place = [], [], 0, 0
        part = TaskContext.get().partitionId()

        def block():
            matrix, own = np.concatenate(parts), np.concatenate(ids)
            kind = "<f4" if np.abs(matrix).max(initial=0.0) < 2**24 else "<f8"
            length = float(np.sqrt((matrix**2).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict({"part": [part], "place": [place], "ids": [own.astype("<i8").tobytes()], "matrix": [matrix.astype(kind).tobytes()],
                                               "n": [len(own)], "longest": [length]}, schema=schema)

        for whole in batches:
            at = 0
            while at < whole.num_rows:
                piece = whole.slice(at, min(per - held, whole.num_rows - at))
                ids.append(piece.column(0).to_numpy(zero_copy_only=False))
                parts.append(quantized(piece, 1, width))
                held, at = held + piece.num_rows, at + piece.num_rows
                if held == per:
                    yield block()
                    ids, parts, held, place = [], [], 0, place + 1
        if held:
            yield block()

    return rows.select("id", "vector").mapInArrow(run, BLOCK)


def numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Adds the block's number in the order of all blocks: a prefix sum over the parts, of which each task made one."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return blocks.join(base, "part").withColumn(name, F.col("_base") + F.col("place")).drop("part", "place", "_base")


def unpacked(matrix: bytes, n: int, width: int) -> np.ndarray:
    kind = "<f4" if len(matrix) == 4 * n * width else "<f8"
    return np.frombuffer(matrix, kind).reshape(n, width).astype(np.float64)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of all queries with all vectors."""
    width = max(queries.shape[1], 1)
    most = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * width
    if most < 2.0**53:
        return queries @ vectors.T
    big = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in vectors]
    limit = 2**63 - 1
    exact = [[max(-limit - 1, min(limit, sum(map(int.__mul__, q, v)))) for v in big[1]] for q in big[0]]
    return np.array(exact, object).reshape(len(queries), len(vectors))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype != object and len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def needed_length(queries: np.ndarray, floor_: np.ndarray) -> np.ndarray:
    """The length that a vector must have to reach a query's floor in its own direction; infinite if none can."""
    own = np.sqrt((queries**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(own > 0, floor_ / own, np.where(floor_ > 0, np.inf, -np.inf)) / SLACK
    return np.where(np.isnan(need), -np.inf, need)


def meetings(needs: DataFrame, buckets: DataFrame) -> DataFrame:
    """``qb`` and ``bucket`` of every block of queries and each bucket, but the longest, that holds a vector long enough for it.

    ``needs``: ``qb`` and ``need``, the least length that may be of use to a query of the block. ``buckets``: ``bucket``,
    numbered from the longest down, and ``longest``. The buckets in reach are the first ones: a running count along the lengths tells how many.
    """
    lengths = buckets.select((F.col("longest") * SLACK).alias("_length"), F.lit(None).cast("long").alias("qb"), F.lit(1).cast("long").alias("_n"))
    both = lengths.unionByName(needs.select(F.col("need").alias("_length"), "qb", F.lit(0).cast("long").alias("_n")))
    reach = running_totals(both, "_length", {"_upto": "_n"}, descending=True).filter("qb IS NOT NULL AND _upto > 1")
    return reach.select("qb", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_upto") - 1)).alias("bucket"))


def search_block(queries: np.ndarray, query_ids: np.ndarray, floor_: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query place, vector place, score) of all that may be among a query's k best, at most k for each query.

    ``floor_``: scores that the k-th best can't fall below.
    """
    length = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    vectors, ids, length = vectors[order], ids[order], length[order]
    own = np.sqrt((queries**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(own * length[0] > 0, floor_ / (own * length[0]), np.where(floor_ > 0, np.inf, -np.inf)) / SLACK
    found = []

    def take(q: int, scores: np.ndarray, places: np.ndarray) -> None:
        ok = np.flatnonzero((ids[places] != query_ids[q]) & (scores >= floor_[q]))
        for i in ok[best(scores[ok], ids[places[ok]], k)]:
            found.append((q, int(order[places[i]]), int(scores[i])))

    fine = (need <= 1) & (need >= COORDINATE_COSINE)
    for q in np.flatnonzero(fine):
        unit = queries[q] / own[q]
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        alive = length * own[q] * SLACK >= floor_[q]
        cosine = floor_[q] / np.maximum(length * own[q], 1e-300) / SLACK
        cosine = np.clip(cosine, -1.0, 1.0)
        for f in focus:  # the cosine on the coordinate and on the rest can't both fall short
            room = np.sqrt(np.maximum(1 - cosine**2, 0.0) * max(1 - unit[f] ** 2, 0.0)) + 1e-9
            share = vectors[:, f] / np.maximum(length, 1e-300)
            # Above the needed cosine the interval only moves towards the query's own share.
            alive &= (share >= np.minimum(unit[f] * cosine, unit[f]) - room) & (share <= np.maximum(unit[f] * cosine, unit[f]) + room)
        places = np.flatnonzero(alive)
        if len(places):
            take(int(q), products(queries[q : q + 1], vectors[places])[0], places)
    plain = np.flatnonzero(need < COORDINATE_COSINE)
    for first in range(0, len(plain), 128):
        some = plain[first : first + 128]
        least = np.min(floor_[some] / np.maximum(own[some], 1e-300) / SLACK)
        upto = int(np.searchsorted(-length, -least, "right")) if least > 0 else len(length)
        if upto:
            scores = products(queries[some], vectors[:upto])
            for i, q in enumerate(some):
                take(int(q), scores[i], np.arange(upto))
    return found


def top_products(df: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50,
                 per_bucket: int = 4096, per_queries: int = 512) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for every row whose id is divisible by ``every``, against all rows."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) <= 1.7976931348623157e308) & ~F.isnan(x))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(finite)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.floor(x * 256.0).cast("double") * F.floor(x * 256.0).cast("double"))
    rows = materialize(rows.withColumn("norm", squares), "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    out = "qb long, q long, query_id long, vec_id long, score long"
    if width is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    buckets = rows.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    buckets = materialize(numbered(materialize(packed(buckets, per_bucket, width), "blocks"), "bucket"), "buckets")
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    blocks = materialize(numbered(materialize(packed(asked, per_queries, width), "blocks"), "qb"), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                query_ids, ids = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                queries, vectors = unpacked(r["queries"], len(query_ids), width), unpacked(r["matrix"], len(ids), width)
                floor_ = np.frombuffer(r["floors"], "<f8") if r["floors"] else np.full(len(queries), -np.inf)
                found = search_block(queries, query_ids, floor_, vectors, ids, k)
                q = [f[0] for f in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["qb"]] * len(found), pa.int64()), pa.array(q, pa.int64()), pa.array([int(query_ids[x]) for x in q], pa.int64()),
                    pa.array([int(ids[f[1]]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                    names=["qb", "q", "query_id", "vec_id", "score"])

    def met(pairs: DataFrame) -> DataFrame:
        return pairs.select("qb", F.col("queries"), "query_ids", "matrix", F.col("ids"), "floors").mapInArrow(run, out)

    ask = blocks.select("qb", F.col("matrix").alias("queries"), F.col("ids").alias("query_ids"), "n")
    # The buckets are numbered from the longest vectors down, so number 0 gives the floors.
    first = ask.select("*", F.lit(None).cast("binary").alias("floors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"))).alias("bucket"))
    longest = F.broadcast(buckets.filter("bucket = 0").drop("n", "longest"))  # one row of at most ``per_bucket`` vectors
    first = materialize(met(first.join(longest, "bucket")), "first")
    kth = first.groupBy("qb", "q").agg(F.sort_array(F.collect_list("score")).alias("s"))  # at most k for each query
    kth = kth.filter(F.size("s") >= k).groupBy("qb").agg(F.collect_list(F.struct("q", F.col("s")[0].alias("f"))).alias("known"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, needs = [], []
            for n, known, matrix in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                one = np.full(n, -np.inf)
                for entry in known or []:
                    one[entry["q"]] = entry["f"]
                values.append(one.tobytes())
                needs.append(float(needed_length(unpacked(matrix, n, width), one).min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary()), pa.array(needs, pa.float64())], names=["qb", "floors", "need"])

    floored = ask.select("qb", "n", "queries").join(kth, "qb", "left").select("qb", "n", "known", "queries")
    floored = materialize(floored.mapInArrow(floors, "qb long, floors binary, need double"), "floors")
    # A block of queries goes once to every other bucket in its reach: one row for each meeting, dealt out by the bucket.
    pairs = meetings(floored, buckets).join(ask.drop("n"), "qb").join(floored.drop("need"), "qb")
    rest = met(pairs.join(buckets.drop("n", "longest"), "bucket"))
    everything = first.unionByName(rest)
    order = Window.partitionBy("qb", "q").orderBy(F.desc("score"), "vec_id")
    ranked = everything.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
