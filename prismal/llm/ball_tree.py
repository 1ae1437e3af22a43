"""Exact ranked lexical search by sparse ball trees.

A document is a sparse vector of integer term impacts, a query the 0/1 vector of its terms, a score their inner product.
Only terms of some query can add to a score, so vectors hold just those. Tasks cut their documents into trees: a node's
ball is the centroid of its vectors and the largest distance from it, and by Cauchy-Schwarz no vector in the ball
scores above ``q . centroid + |q| * radius``, where of q just the terms count that some vector in the ball has (elsewhere vectors and
centroid are all zero). Both parts are rounded upwards by more than their arithmetic can err. Queries visit nodes best first; a node whose
bound lies below the query's k-th best score so far ends its search of the tree. At the leaves scores are summed in 64-bit
integers. The k-th best scores carry on from tree to tree within a task; the tasks' best are ranked once more.

Queries come in blocks of bounded size, each with its own pass over the documents, so what the driver and the tasks hold of them
doesn't grow with their number (one query is never cut). Terms of equal 64-bit hash count as equal.

Defined results: null and empty texts and those without terms are no documents, and no answers; items without terms, and rows without
item_id or doc_id, take no part; equal item rows are answered once, rows that share an item_id with different texts
each; rows that share a doc_id are documents of their own, ranked side by side; texts of any length count as a whole; empty tables give
an empty table; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.llm.common import flat_text, slices
from prismal.llm.line_dedup import UPPER
from prismal.llm.shingles import word_hashes
from prismal.plans.ordered import positions, running_totals
from prismal.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


@dataclass
class Queries:
    """A block of queries: their numbers, where each one's terms begin, and the terms as places in the block's vocabulary."""

    numbers: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    vocabulary: np.ndarray  # ascending 64-bit hashes

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.terms)))


def term_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term, A-Z lower-cased, and the text that holds it."""
    data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _IN_TERM[raw], [False]])
    cut = np.zeros(len(raw) + 1, np.bool_)
    cut[ends] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return word_hashes(data, first, last), np.searchsorted(ends, first, "right") - 1


def query_blocks(items: DataFrame, item_id: str, text: str, per_block: int, terms_per_block: int) -> DataFrame:
    """``number`` (one for each query), ``item_id``, ``terms`` and ``block`` of all items with terms, in blocks of bounded size."""
    rows = items.select(F.col(item_id).alias("item_id"), F.translate(F.col(text), UPPER, UPPER.lower()).alias("text"))
    rows = rows.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    rows = rows.withColumn("terms", F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), 0))).filter("size(terms) > 0")
    rows = positions(rows.withColumn("n", F.size("terms").cast("long")), ["item_id", "text"], "number").drop("text")
    rows = running_totals(rows, "number", {"upto": "n"})
    return rows.select("number", "item_id", "terms", F.struct(F.expr(f"number div {per_block}").alias("by_count"), F.expr(f"(upto - n) div {terms_per_block}").alias("by_terms")).alias("block"))


def block_queries(rows: list) -> Queries:
    """A block as arrays. ``rows``: number and terms."""
    data = [[t.encode() for t in r["terms"]] for r in rows]
    flat = [t for terms in data for t in terms]
    hashes, _ = term_hashes(b" ".join(flat), np.array([0, sum(map(len, flat)) + len(flat) - 1]))
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    sizes = np.array([len(t) for t in data])
    return Queries(np.array([r["number"] for r in rows], np.int64), np.cumsum(sizes) - sizes, terms, vocabulary)


VECTORS = "doc_id long, n long, terms array<int>, counts array<long>"


def vectors(docs: DataFrame, doc_id: str, text: str, queries) -> DataFrame:
    """doc_id, ``n`` (all terms), and the vocabulary's terms and their counts, of every document with terms. ``queries``: a broadcast block."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = queries.value.vocabulary
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, owner = term_hashes(*flat_text(batch.column(1)))
                n = np.bincount(owner, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                keys, counts = np.unique(owner[known] * len(vocabulary) + at[known], return_counts=True)
                sizes = np.bincount(keys // len(vocabulary), minlength=batch.num_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                out = pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array((keys % len(vocabulary)).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))], names=["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return rows.mapInArrow(run, VECTORS)


def impacts(n: np.ndarray, counts: np.ndarray, weights: np.ndarray, owner: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with ``m = 50 + (50 * n * N) div L``."""
    wide = 50 * int(n.max(initial=0)) * total_docs < 2**63
    m = 50 + (50 * n * total_docs) // total_terms if wide else np.array([50 + 50 * int(x) * total_docs // total_terms for x in n], np.int64)
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[owner]))


class BallTree:
    """The balls of some documents, split until ``leaf`` are left, with an upper bound for each query and node."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: Queries, leaf: int):
        self.starts, self.terms, self.values, self.queries = starts, terms, values, queries
        self.sizes = np.diff(np.append(starts, len(terms)))
        self.real = values.astype(np.float64)
        self.squares = np.add.reduceat(self.real**2, starts)
        self.scratch = np.zeros(len(queries.vocabulary))
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.bounds: list[np.ndarray] = []
        todo = [self._node(np.arange(len(starts)))]
        while todo:
            node = todo.pop()
            parts = self._split(self.members[node]) if len(self.members[node]) > leaf else None
            if parts:
                self.children[node] = (self._node(parts[0]), self._node(parts[1]))
                todo += self.children[node]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the documents' entries, and where each document's begin."""
        sizes = self.sizes[docs]
        begin = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.starts[docs] - begin, sizes), begin

    def _distances(self, docs: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Squared distances of documents from a dense centre."""
        at, begin = self.entries(docs)
        return self.squares[docs] - 2 * np.add.reduceat(self.real[at] * centre[self.terms[at]], begin) + (centre**2).sum()

    def _node(self, docs: np.ndarray) -> int:
        at, _ = self.entries(docs)
        centre = np.bincount(self.terms[at], self.real[at], minlength=len(self.scratch)) / len(docs)
        # A distance is a difference of numbers that may be far larger than it: what they can be off by is added.
        spread = self._distances(docs, centre).max()
        error = 1e-9 * (self.squares[docs].max() + (centre**2).sum())
        radius = math.sqrt(max(spread, 0.0) + error)
        at_terms = centre[self.queries.terms]
        near, present = (np.add.reduceat(x, self.queries.starts) for x in (at_terms, (at_terms > 0).astype(np.int64)))
        self.bounds.append((near + np.sqrt(present) * radius) * (1 + 1e-9) + 1.0)
        self.members.append(docs)
        self.children.append(None)
        return len(self.members) - 1

    def _dense(self, doc: int) -> np.ndarray:
        out = np.zeros(len(self.scratch))
        at, _ = self.entries(np.array([doc]))
        out[self.terms[at]] = self.real[at]
        return out

    def _split(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Halves by which of two far documents is nearer; none where all are equal."""
        first = docs[np.argmax(self._distances(docs, self._dense(docs[0])))]
        from_first = self._distances(docs, self._dense(first))
        second = docs[np.argmax(from_first)]
        lean = from_first - self._distances(docs, self._dense(second))
        if lean.max() == lean.min():
            return None
        order = np.argsort(lean, kind="stable")
        return docs[order[: len(docs) // 2]], docs[order[len(docs) // 2 :]]

    def search(self, query: int, best: Best, ids: np.ndarray) -> None:
        """Offers every document that may be among the query's best."""
        wanted = self.scratch.astype(bool)
        begin = self.queries.starts[query]
        wanted[self.queries.terms[begin : begin + self.queries.sizes[query]]] = True
        heap = [(-self.bounds[0][query], 0)]
        while heap and -heap[0][0] >= best.floor(query):
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-self.bounds[child][query], child))
                continue
            docs = self.members[node]
            at, start = self.entries(docs)
            best.offer(query, np.add.reduceat(np.where(wanted[self.terms[at]], self.values[at], 0), start), ids[docs])


class Best:
    """The k best documents of every query so far: highest score, then smallest id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def floor(self, query: int) -> int:
        """The least score that may still enter."""
        return int(self.scores[query][-1]) if len(self.scores[query]) == self.k else 1

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = scores >= self.floor(query)
        if ok.any():
            scores, ids = np.append(self.scores[query], scores[ok]), np.append(self.ids[query], ids[ok])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores[query], self.ids[query] = scores[order], ids[order]


def search(rows: DataFrame, queries, weights, total_docs: int, total_terms: int, k: int, per_tree: int, leaf: int) -> DataFrame:
    """``number``, ``doc_id`` and ``score`` of every task's k best for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = queries.value
        best = Best(len(block.numbers), k)

        def grow(part: pa.RecordBatch) -> None:
            terms, counts = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            n, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 0))
            values = impacts(n, counts, weights.value[terms], np.repeat(np.arange(len(n)), sizes), total_docs, total_terms)
            tree = BallTree(np.cumsum(sizes) - sizes, terms, values, block, leaf)
            for query in range(len(block.numbers)):
                tree.search(query, best, ids)

        for batch in batches:
            for first in range(0, batch.num_rows, per_tree):
                grow(batch.slice(first, per_tree))
        n = [len(s) for s in best.scores]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.numbers, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
                                             names=["number", "doc_id", "score"])

    return rows.filter("size(terms) > 0").mapInArrow(run, "number long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
         per_block: int = 256, terms_per_block: int = 1 << 18, per_tree: int = 2048, leaf: int = 32) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the k highest-scoring documents of every item, scores above 0."""
    spark = docs.sparkSession
    asked = materialize(query_blocks(items, item_id, item_text, per_block, terms_per_block), "queries")
    found = None
    for block in asked.select("block").distinct().orderBy("block").toLocalIterator():
        mine = asked.filter((F.col("block.by_count") == block[0]["by_count"]) & (F.col("block.by_terms") == block[0]["by_terms"]))
        block = block_queries(mine.select("number", "terms").orderBy("number").collect())  # at most per_block queries
        queries = spark.sparkContext.broadcast(block)
        rows = materialize(vectors(docs, doc_id, text, queries), "vectors")
        total_docs, total_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total_docs:
            break
        held = np.zeros(len(block.vocabulary), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the block
            held[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        best = search(rows, queries, spark.sparkContext.broadcast(weights), total_docs, total_terms, k, per_tree, leaf)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
