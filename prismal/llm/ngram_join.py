"""Exact Jaccard self-join of word shingles by prefix filters under several global token orders.

Of two sets with a Jaccard similarity of at least t, whatever global order the tokens are put in, the first
|A| - ceil(t |A|) + 1 tokens of A and the like of B share one. A pair must pass this under every order used, and a set that shares no
prefix token with any other set under some order has no link at all.

1. *Class orders.* The top two bits of a token's hash put it in one of four classes. Order c sorts the tokens of class c first, the
   rarest first. A set whose class c holds as many tokens of its own alone as its prefix is long has nothing but those
   in its prefix: it is out. Only the class's tokens are shuffled, and aggregated to their first and last owner before. Class 0
   runs over all texts, classes 1 and 2 over what class 0 left, where all tokens are kept.
2. *Full orders.* Over the sets left, tokens are sorted by their number of sets, ties by the token (order A) or by another
   hash (order B), and by its power of two, ties by a third hash (order C). Sets that share a prefix token of order A meet in that
   token's bucket; a pair is verified only if the prefixes of B and C share tokens, too, and the sizes allow the similarity.
3. *Verification* counts the shared tokens. A bucket's member with the longest posted prefix leads it (the text that
   copies were made from has no tokens of its own). Every set is compared with its foremost leader, then, in buckets that still hold several
   components, with all their leaders. What is left is looked at in blocks of members, each with every other of its bucket: first at sizes and
   places of the bucket's token alone (that leaves few), then at prefixes and tokens. No link between different components is passed
   over, and no task gets more than two blocks at a time; a bucket of m sets that stay apart costs about (m / 512)^2 / 2 meetings.

Shingles and sets of equal hash (64 bits; 128 bits for whole sets) count as equal.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; a text of fewer words
than a shingle is one shingle; rows of null doc_id link nothing and get a null component; rows that share a doc_id are answered each by
its own text; repeated rows are answered each; texts of any length are compared as a whole; an empty table gives an empty
table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import flat_text, slices
from prismal.llm.shingles import mix, shingles
from prismal.plans.graph import components
from prismal.session import materialize

#: Bits of the filter that passes on the texts still in question: a fixed 2 MB, whatever the input; it may let others through, too.
FILTER_BITS = 1 << 24
SETS = "doc_id long, node binary, owner long, size long, tokens array<long>"


def _set_rows(batch: pa.RecordBatch, width: int, classes: int) -> pa.RecordBatch:
    """doc_id, node, owner, size and the tokens of the first ``classes`` classes of every text of the batch (doc_id, text)."""
    data, ends = flat_text(batch.column(1))
    n = batch.num_rows
    hashes, text, _ = shingles(data.lower(), ends, width)  # bytes: A-Z only
    digest = np.zeros((n, 2), np.uint64)
    for i in range(2):
        np.add.at(digest[:, i], text, mix(hashes * np.uint64(2 * i + 1)))
    kept = (hashes >> np.uint64(62)) < classes
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=n))]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[kept].view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in digest], pa.binary()), pa.array(mix(digest[:, 0] + digest[:, 1]).view(np.int64)),
                                       pa.array(np.bincount(text, minlength=n), pa.int64()), tokens], names=["doc_id", "node", "owner", "size", "tokens"])


def sets(df: DataFrame, doc_id: str, text: str, width: int, classes: int, passing: bytes | None = None) -> DataFrame:
    """The shingle set of every row; with ``passing`` only of rows whose doc_id the filter lets through."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("long")).alias("hash"))
    shared = None if passing is None else df.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, "<u8")
        for whole in batches:
            if bits is not None:
                at = whole.column(2).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(FILTER_BITS - 1)
                whole = whole.filter(pa.array((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1))
            for batch in slices(whole, "text"):
                yield _set_rows(batch, width, classes)

    return rows.mapInArrow(run, SETS)


def filter_of(ids: DataFrame) -> bytes:
    """A bit set with the hashes of all ids; no more than FILTER_BITS / 64 rows go to the driver."""
    bit = F.xxhash64("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    rows = words.toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.tobytes()


def prefix_length(size: Column, percent: int) -> Column:
    """|A| - ceil(t |A|) + 1."""
    return size - F.floor((size * percent + 99) / 100) + 1


def in_question(rows: DataFrame, sizes: DataFrame, percent: int, classes: tuple[int, ...]) -> DataFrame:
    """Of ``sizes`` (``owner``, ``size``, ...) the sets that may share a prefix token under the order of each of the classes.

    ``rows`` (``owner``, ``tokens``) holds their tokens; rows of equal owner are one set.
    """
    token = rows.select("owner", F.explode("tokens").alias("token"))
    kind = F.expr("shiftrightunsigned(token, 62)")
    if classes != (0,):
        token = token.filter(kind.isin(*classes))
    held = token.groupBy("token").agg(F.min("owner").alias("owner"), F.max("owner").alias("_last"))
    lone = held.filter("owner = _last").groupBy("owner").agg(*[F.count_if(kind == c).alias(f"_n{c}") for c in classes])
    most = F.greatest(*[F.col(f"_n{c}") for c in classes], F.lit(0))
    return sizes.join(lone, "owner", "left").filter(F.coalesce(most, F.lit(0)) < prefix_length(F.col("size"), percent)).select(*sizes.columns)


def prefixes(rest: DataFrame, percent: int) -> DataFrame:
    """``id``, ``size``, ``lone`` (tokens no other set has) and the shared tokens of the prefixes under the orders A, B and C (``a``, ``b``, ``c``)."""
    token = rest.select("id", "size", F.explode("tokens").alias("token"))
    shared = materialize(token.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "token-counts")
    held = token.join(shared, "token").groupBy("id", "size").agg(F.collect_list(F.struct("n", "token")).alias("held"))  # tokens of one set
    # A set's own tokens come first under these orders and are never shared.
    held = held.withColumn("_room", (prefix_length(F.col("size"), percent) - (F.col("size") - F.size("held"))).cast("int")).filter("_room > 0")
    orders = {"a": lambda x: F.struct(x["n"], x["token"].alias("tie"), x["token"]),
              "b": lambda x: F.struct(x["n"], F.xxhash64(x["token"]).alias("tie"), x["token"]),
              "c": lambda x: F.struct(F.length(F.bin(x["n"])).alias("n"), F.xxhash64(x["token"], F.lit(1)).alias("tie"), x["token"])}
    first = {k: F.slice(F.array_sort(F.transform("held", f)), F.lit(1), F.col("_room"))["token"].alias(k) for k, f in orders.items()}
    return materialize(held.select("id", "size", (F.col("size") - F.size("held")).alias("lone"), *first.values()), "prefixes")


def _candidates(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (``a``, ``b``) those whose sizes allow a link and whose prefixes share tokens under the orders B and C."""
    side = lambda s: heads.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("b").alias(f"b_{s}"), F.col("c").alias(f"c_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    alike = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    return both.filter(alike & F.arrays_overlap("b_a", "b_b") & F.arrays_overlap("c_a", "c_b")).select("a", "b")


def _links(pairs: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those that are similar enough, by all their tokens."""
    side = lambda s: rest.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("tokens").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")))
    return both.filter(F.col("shared") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * percent).select("a", "b")


def meetings(rows: DataFrame, columns: list[str], per: int, features: DataFrame | None = None) -> DataFrame:
    """``token``, ``x`` and ``y``: every two blocks of a bucket's members, and every block with itself, once.

    Members are dealt to blocks of about ``per`` by hash; a block is a list of structs of ``columns``. ``features`` come in by ``id``
    when the members have their block, and a bucket's blocks are dealt out, so that a bucket of any size is no task of its own.
    """
    parts = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("n"))
    placed = rows.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    if features is not None:
        placed = placed.join(features, "id")
    blocks = materialize(placed.repartition("token", "part").groupBy("token", "part", "n").agg(F.collect_list(F.struct(*columns)).alias("own")), "blocks")
    left = blocks.select("token", F.col("own").alias("x"), F.explode(F.sequence("part", F.col("n") - 1)).alias("part"))
    return left.join(blocks.select("token", "part", F.col("own").alias("y")), ["token", "part"]).select("token", "x", "y")


def may_be_near(rows: DataFrame, percent: int) -> DataFrame:
    """Of the members of buckets (``token``, ``id``, ``root``, ``size``, ``rest``) those that some member of another root may be near.

    ``rest``: the member's tokens from the bucket's token on, under order A. In the bucket of the first token that two sets
    share, they share no more than the shorter rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = ({f: v[i].values.field(f).to_numpy(zero_copy_only=False) for f in ("id", "root", "size", "rest")} for v in (batch.column(1), batch.column(2)))
                both = x["size"][:, None] + y["size"][None]
                ok = np.minimum(x["rest"][:, None], y["rest"][None]) * (100 + percent) >= both * percent
                ok &= np.minimum(x["size"][:, None], y["size"][None]) * 100 >= np.maximum(x["size"][:, None], y["size"][None]) * percent
                ok &= x["root"][:, None] != y["root"][None]
                ids = np.concatenate([x["id"][ok.any(axis=1)], y["id"][ok.any(axis=0)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column(0)[i].as_py()), pa.int64()), pa.array(ids, pa.int64())], names=["token", "id"])

    return meetings(rows, ["id", "root", "size", "rest"], 512).mapInArrow(run, "token long, id long").distinct()


def links_of_blocks(rows: DataFrame, heads: DataFrame, rest: DataFrame, percent: int, per: int = 64) -> DataFrame:
    """Links between members of different roots of a bucket. ``rows``: ``token``, ``id``, ``root``."""
    features = heads.select("id", "size", "b", "c").join(rest.select("id", "tokens"), "id")

    def overlap(x: list, y: list, name: str) -> np.ndarray:
        """Whether each of ``x`` shares a prefix token with each of ``y``."""
        values = np.concatenate([np.array(r[name], np.int64) for r in x + y])
        owner = np.repeat(np.arange(len(x) + len(y)), [len(r[name]) for r in x + y])
        _, column = np.unique(values, return_inverse=True)
        has = np.zeros((len(x) + len(y), column.max() + 1), np.float32)
        has[owner, column] = 1
        return has[: len(x)] @ has[len(x) :].T > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                size, root = ([np.array([r[f] for r in side]) for side in (x, y)] for f in ("size", "root"))
                ok = root[0][:, None] != root[1][None]
                ok &= np.minimum(size[0][:, None], size[1][None]) * 100 >= np.maximum(size[0][:, None], size[1][None]) * percent
                if ok.any():
                    ok &= overlap(x, y, "b") & overlap(x, y, "c")
                found = []
                for p, q in zip(*np.nonzero(ok)):
                    shared = len(np.intersect1d(x[p]["tokens"], y[q]["tokens"], assume_unique=True))
                    if shared * 100 >= (x[p]["size"] + y[q]["size"] - shared) * percent:
                        found.append(sorted((x[p]["id"], y[q]["id"])))
                yield pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

    met = meetings(rows, ["id", "root", "size", "b", "c", "tokens"], per, features)
    return met.mapInArrow(run, "a long, b long").distinct()


def settle(heads: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """``id`` and ``root``, the smallest id of its component, of every set in ``heads``."""
    posted = heads.select("id", "size", F.size("a").alias("posts"), "lone", F.posexplode("a").alias("at", "token"))
    posted = posted.select("token", "id", "size", "posts", (F.col("size") - F.col("lone") - F.col("at")).alias("rest"))
    lead = F.max(F.struct("posts", (-F.col("id")).alias("id"))).alias("lead")
    buckets = posted.groupBy("token").agg(lead, F.count(F.lit(1)).alias("members")).filter("members > 1").select("token", "lead")
    member = materialize(posted.join(buckets, "token").select("token", "id", "size", "rest", "lead"), "buckets")
    roots = materialize(member.select("id").distinct().withColumn("root", F.col("id")), "roots")

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """Roots after more links: components of the components."""
        top = lambda s: roots.select(F.col("id").alias(s), F.col("root").alias(f"r{s}"))
        edges = links.join(top("a"), "a").join(top("b"), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = materialize(edges.distinct(), "root-links")
        if edges.isEmpty():
            return roots
        moved = components(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), edges)
        out = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
        return materialize(out.select("id", F.coalesce("_to", "root").alias("root")), "roots")

    def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Of members of buckets those whose bucket holds several components, with their root."""
        rows = rows.join(roots, "id")
        several = rows.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b").select("token")
        return materialize(rows.join(several, "token"), "open-members")

    def by_leaders(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        chosen = materialize(_candidates(pairs, heads, percent), "candidates")
        return joined(roots, materialize(_links(chosen, rest, percent), "links"))

    foremost = member.filter("id <> -lead.id").groupBy(F.col("id").alias("b")).agg(F.max("lead").alias("lead"))
    foremost = materialize(foremost.select((-F.col("lead.id")).alias("a"), "b"), "foremost")
    roots = by_leaders(foremost, roots)
    rows = still_open(member, roots)
    if not rows.isEmpty():
        top = roots.select((-F.col("id")).alias("leader"), F.col("root").alias("_lead_root"))
        pairs = rows.select("id", "root", F.col("lead.id").alias("leader")).distinct().join(top, "leader").filter("root <> _lead_root")
        pairs = pairs.select((-F.col("leader")).alias("a"), F.col("id").alias("b"))
        roots = by_leaders(pairs.join(foremost, ["a", "b"], "left_anti"), roots)
        rows = still_open(member.filter("id <> -lead.id"), roots)  # all pairs with a leader are decided
        near = materialize(may_be_near(rows, percent), "may-be-near")
        roots = joined(roots, materialize(links_of_blocks(rows.select("token", "id", "root").join(near, ["token", "id"]), heads, rest, percent), "links"))
    return roots


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row: the smallest doc_id that links of at least ``percent`` lead to."""
    rows = materialize(sets(df, doc_id, text, width, 1), "sets")
    worded = rows.filter("size > 0 AND doc_id IS NOT NULL")
    nodes = materialize(worded.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("owner").alias("owner"), F.min("size").alias("size")), "nodes")
    left = materialize(in_question(worded, nodes, percent, (0,)), "in-question")

    # All tokens of the sets still in question, one row for each set.
    again = sets(df, doc_id, text, width, 4, filter_of(left)).join(left.select("node", F.col("doc_id").alias("_head")), "node")
    rest = materialize(again.filter("doc_id = _head").dropDuplicates(["node"]).select("node", "owner", "size", "tokens"), "tokens")
    left = in_question(rest, rest.select("node", "owner", "size"), percent, (1, 2))
    rest = rest.join(materialize(left.select("node"), "in-question"), "node").withColumn("id", F.monotonically_increasing_id())
    rest = materialize(rest.select("id", "node", "size", "tokens"), "tokens")

    roots = settle(prefixes(rest, percent), rest, percent).join(rest.select("id", "node"), "id").join(nodes.select("node", "doc_id"), "node")
    first = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(first, "root").select("node", "component_id")
    answer = nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "node", F.col("size").alias("n_shingles")).join(materialize(answer, "answers"), "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
