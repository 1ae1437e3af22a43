"""Near duplicates by DartMinHash signatures, banded joins and an exact check.

Every shingle of weight w owns the region [0, w) x [0, inf) of weight and rank. Darts fall on each strip of unit
weight as a Poisson process along the rank, by the shingle's hash alone, so texts that share a shingle see the
same darts. A text throws the darts of rank up to theta = t / (its total weight), about t of them however many
shingles it has; each dart hits one of k coordinates, and every coordinate keeps its earliest dart (theta grows
for a text whose coordinates are not all hit). Two texts agree in a coordinate with the probability of
their (weighted) Jaccard similarity. Signatures are cut into bands; texts that share a band are candidates.

Candidates are not all pairs of a bucket. Texts with the same shingles are first made one. A bucket's smallest member leads it.
Each text is compared, exactly and by the whole texts, with the smallest of its leaders; links so found give components. In buckets that still
hold several components all members are compared with the leader. Buckets that hold several components even then
give their remaining pairs across components, less those that the metric rules out: Jaccard distance obeys the triangle
inequality, so two texts whose distances to the same leader differ by more than 1 - threshold can't be near.
So no link between candidates of different components is lost, and a group of copies of any size costs about one comparison for each member.

Defined results: texts without words (null, empty, white space) are copies of each other; shingles are five words, all
the words if fewer; classes are numbered by their smallest doc_id; rows of null doc_id are classes of their own with a null
class; rows that share a doc_id but not a text are compared each, ``classes`` gives the doc_id the smallest class among theirs, and ``keep_one``
keeps a text of each class; doc_id is read as a long; texts of any length count as a whole; an empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import flat_text, slices
from prismal.llm.shingles import mix, shingles
from prismal.plans.graph import components
from prismal.plans.ordered import positions
from prismal.session import materialize

_STEP = np.uint64(0x9E3779B97F4A7C15)


def darts(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures of ``n`` texts: the id of the earliest dart in each of ``k`` coordinates. Texts without shingles get zeros."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(text, weights, minlength=n)
    strips = np.repeat(np.arange(len(hashes)), weights)
    layer = np.arange(len(strips)) - np.repeat(np.cumsum(weights) - weights, weights)
    seed = mix(hashes[strips] + layer.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    owner = text[strips]
    theta = k * (math.log(k) + 5) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        alive = np.flatnonzero(todo[owner])
        rank, state = np.zeros(len(alive)), seed[alive]
        found_rank, found_id, found_place = [], [], []
        while len(alive):
            state = mix(state + _STEP)
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            on = rank <= theta[owner[alive]]
            alive, rank, state = alive[on], rank[on], state[on]
            dart = mix(state ^ _STEP)
            found_rank.append(rank)
            found_id.append(dart | np.uint64(1))
            found_place.append(owner[alive] * k + (mix(dart) % np.uint64(k)).astype(np.int64))
        order = np.argsort(-np.concatenate(found_rank), kind="stable")  # the earliest is written last and stays
        flat = np.zeros(n * k, np.uint64)
        flat[np.concatenate(found_place)[order]] = np.concatenate(found_id)[order]
        flat = flat.reshape(n, k)
        full = todo & (flat != 0).all(axis=1)
        out[full] = flat[full]
        todo &= ~full
        theta = np.where(todo, theta * 2, theta)
    return out


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = 32, rows: int = 5, width: int = 5, weighted: bool = False) -> DataFrame:
    """doc_id, ``version`` (tells texts of a doc_id apart), ``same`` (128-bit digest of the shingle set), ``size`` and ``bands`` (a hash for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, ends = flat_text(batch.column(1))
                n = batch.num_rows
                hashes, owner, counts = shingles(data, ends, width)
                weights = counts if weighted else np.ones_like(counts)
                signs = darts(hashes, owner, weights, n, bands * rows).reshape(n, bands, rows)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = mix(key + signs[:, :, r])
                key = mix(key + np.arange(bands, dtype=np.uint64))
                size = np.bincount(owner, weights, minlength=n).astype(np.int64)
                digest = np.zeros((2, n), np.uint64)
                for i in range(2):
                    np.add.at(digest[i], owner, mix(hashes * np.uint64(2 * i + 1) + weights.astype(np.uint64) * _STEP))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(2), pa.array([digest[:, i].tobytes() for i in range(n)], pa.binary()),
                    pa.array(size, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(key.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "version", "same", "size", "bands"])

    return texts_of(df, doc_id, text).mapInArrow(run, "doc_id long, version long, same binary, size long, bands array<long>")


def texts_of(df: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """``doc_id``, ``text`` and ``version``, which tells texts of a doc_id apart. With ``more``, these columns instead of the text."""
    whole = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), *(more or [whole.alias("text")]), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("version"))


def similarities(pairs: DataFrame, texts: DataFrame, width: int = 5, weighted: bool = False) -> DataFrame:
    """Adds ``near``, the exact (weighted) Jaccard similarity, to pairs ``a``, ``b`` of ids of ``texts`` (``id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                n = batch.num_rows
                both = pa.concat_arrays([batch.column(2), batch.column(3)])
                data, ends = flat_text(both)
                hashes, owner, counts = shingles(data, ends, width)
                weights = counts if weighted else np.ones_like(counts)
                total = np.bincount(owner, weights, minlength=2 * n)
                order = np.lexsort((hashes, owner % n))
                h, pair, w = hashes[order], owner[order] % n, weights[order]
                same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][same], np.minimum(w[1:], w[:-1])[same], minlength=n)
                near = shared / np.maximum(total[:n] + total[n:] - shared, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["a", "b", "near"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(run, "a long, b long, near double")


def block_similarities(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, first: int) -> np.ndarray:
    """Exact (weighted) Jaccard similarity of each of the first ``first`` texts with each of ``n`` - ``first`` others."""
    if not len(hashes):
        return np.ones((first, n - first))  # no words on either side
    _, place = np.unique(hashes, return_inverse=True)
    total = np.bincount(owner, weights, minlength=n)
    shared = np.zeros((first, n - first))
    for level in range(1, int(weights.max()) + 1):  # the smaller of two counts is the number of levels both reach
        on = weights >= level
        used, column = np.unique(place[on], return_inverse=True)
        matrix = np.zeros((n, len(used)), np.float32)
        matrix[owner[on], column] = 1
        shared += matrix[:first] @ matrix[first:].T
    return shared / np.maximum(total[:first, None] + total[None, first:] - shared, 1)


def links_in_blocks(rows: DataFrame, texts: DataFrame, threshold: float, width: int, weighted: bool, per: int = 64) -> DataFrame:
    """Links (``a``, ``b``, ``near``) between members of different roots of a bucket. ``rows``: ``key``, ``id``, ``root``, ``near`` (to the leader).

    A bucket's members are dealt out by hash to blocks of about ``per``; every block meets each block of its bucket once, in one
    row, where all its pairs are compared together. Just links leave the task. Long texts are compared in smaller parts of a block.
    """
    parts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / per).alias("n_parts"))
    placed = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")))
    member = F.struct("id", "root", "near", "text")
    blocks = placed.join(texts, "id").groupBy("key", "part", "n_parts").agg(F.collect_list(member).alias("own"))
    blocks = materialize(blocks, "blocks")
    left = blocks.select("key", F.col("own").alias("x"), F.explode(F.sequence(F.col("part"), F.col("n_parts") - 1)).alias("part"))
    met = left.join(blocks.select("key", "part", F.col("own").alias("y")), ["key", "part"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                second = list(_portions(y.as_py()))
                for a in _portions(x.as_py()):
                    for b in second:
                        yield compare(a, b)

    def compare(a: list[dict], b: list[dict]) -> pa.RecordBatch:
        data, ends = flat_text(pa.array([r["text"] for r in a] + [r["text"] for r in b], pa.string()))
        hashes, owner, counts = shingles(data, ends, width)
        weights = counts if weighted else np.ones_like(counts)
        near = block_similarities(hashes, owner, weights, len(a) + len(b), len(a))
        ids, roots, lead = ([np.array([r[c] for r in side]) for side in (a, b)] for c in ("id", "root", "near"))
        ok = (near >= threshold) & (roots[0][:, None] != roots[1][None]) & (np.abs(lead[0][:, None] - lead[1][None]) <= 1 - threshold + 1e-9)
        i, j = np.nonzero(ok)
        low, high = np.minimum(ids[0][i], ids[1][j]), np.maximum(ids[0][i], ids[1][j])
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(near[i, j], pa.float64())], names=["a", "b", "near"])

    return met.mapInArrow(run, "a long, b long, near double").dropDuplicates(["a", "b"])


def _portions(rows: list[dict], most: int = 400_000) -> Iterator[list[dict]]:
    """Consecutive rows with at most ``most`` characters of text together, or one row."""
    part, size = [], 0
    for row in rows:
        n = len(row["text"] or "")
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(row)
        size += n
    if part:
        yield part


def members(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 32, rows: int = 5,
            width: int = 5, weighted: bool = False) -> DataFrame:
    """``doc_id``, ``version`` and ``root`` of every text of every doc_id that isn't null; texts of one root are one class."""
    signed = materialize(signatures(df, doc_id, text, bands, rows, width, weighted), "signatures")
    worded = signed.filter("doc_id IS NOT NULL")
    # Texts with the same shingles are one: the first row stands for it. Combined before the shuffle. Numbers ascend with the doc_id.
    first = worded.groupBy("same").agg(F.min(F.struct("doc_id", "version")).alias("head")).select("same", "head.doc_id", "head.version")
    one = positions(first, ["doc_id", "version", "same"], "id")
    member = materialize(worded.select("doc_id", "version", "same").join(one.select("same", "id"), "same").select("doc_id", "version", "id").distinct(), "members")
    keyed = worded.join(one, ["doc_id", "version", "same"]).dropDuplicates(["id"]).select("id", "size", F.explode("bands").alias("key"))
    keyed = materialize(keyed, "bands")
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).filter("leader < _last")
    leaders = materialize(leaders.select("key", "leader"), "leaders")
    bucket = materialize(keyed.join(leaders, "key").select("key", "leader", "id", "size"), "buckets")
    wanted = one.join(bucket.select("id").distinct(), "id").select("id", "doc_id", "version")
    texts = texts_of(df, doc_id, text).join(wanted, ["doc_id", "version"]).dropDuplicates(["id"]).select("id", "text")
    texts = materialize(texts, "texts")
    a_b = ["a", "b"]

    def links(found: DataFrame) -> DataFrame:
        return found.filter(F.col("near") >= threshold).select(*a_b)

    def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
        """Roots after more links: components of the components, of which few are touched."""
        top = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        edges = links(found).join(top("a"), "a").join(top("b"), "b").filter("ra <> rb")
        edges = materialize(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "root-links")
        if edges.isEmpty():
            return roots
        higher = components(edges.select(F.explode(F.array(*a_b)).alias("node")).distinct(), edges)
        moved = roots.join(higher.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
        return materialize(moved.select("node", F.coalesce("_to", "root").alias("root")), "roots")

    def mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Of the buckets' members those of buckets that hold several components, with their root."""
        rows = materialize(rows.join(roots.select(F.col("node").alias("id"), "root"), "id"), "open")
        several = rows.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b").select("key")
        return materialize(rows.join(materialize(several, "several"), "key"), "mixed")

    lowest = bucket.filter("leader < id").groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a"))
    star = materialize(similarities(lowest.select(*a_b), texts, width, weighted), "star")
    nodes = materialize(bucket.select(F.col("id").alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    roots = joined(nodes, star)
    rows = mixed(bucket, roots)
    if not rows.isEmpty():
        rest = rows.filter("leader < id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        more = materialize(similarities(rest.join(star, a_b, "left_anti"), texts, width, weighted), "star")
        roots, star = joined(roots, more), star.unionByName(more)
        # What is left: pairs of a bucket in different components that the leader's distances don't rule out.
        rows = mixed(rows.drop("root"), roots).filter("leader < id")  # all comparisons with the leader are known
        rows = rows.join(star.select(F.col("a").alias("leader"), F.col("b").alias("id"), "near"), ["leader", "id"])
        across = materialize(links_in_blocks(rows, texts, threshold, width, weighted), "across")
        roots = joined(roots, across)

    found = member.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    return materialize(found.select("doc_id", "version", F.coalesce("root", "id").alias("root")), "classes")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id`` and ``class_id``, for every row. ``options`` as in ``members``."""
    found = members(df, doc_id, text, **options)
    first = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    found = found.join(first, "root").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = df.select(F.col(doc_id).cast("long").alias("doc_id"))
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The texts that stand for their class: one of each group of near duplicates, all columns kept.

    Of rows with the same id and the same text one stays, too. Rows of null doc_id stay.
    """
    heads = members(df, doc_id, text, **options).groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("_head"))
    heads = heads.select("_head.doc_id", "_head.version")
    row = F.struct(*df.columns).alias("row")  # columns of any name stay apart from those of the join
    whole = texts_of(df, doc_id, text, row).join(heads, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    return whole.select("row.*").unionByName(df.filter(F.col(doc_id).isNull()))
