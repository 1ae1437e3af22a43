"""A Merkle manifest of a dataset, built by sibling-shift self-joins.

Rows are leaves; the leaves of a source, by ascending doc_id, make one tree, and the trees' tops, by source, make another. In
every level a node's place gives those of its siblings: the place with its last bit flipped (XOR) in binary trees, else
the first place of the run plus each other slot. The nodes in slot zero compute them, meet them in one equijoin of the
level with itself, and emit the parent: a run costs a row for each node, however many rows a source holds, and
no group is larger than a run. Levels are written tables, a factor of ``arity`` smaller each. The way back down hands every
node what lies before and after it in its run, and the same for all levels above, so that proofs and folded roots are computed
where the run's children are, without a further shuffle.

``H`` is the lowercase hex sha256 of its inputs one after the other, digests as hex text. A leaf is H of its columns, each ``-``
if null, else the UTF-8 byte count, ``:`` and the value.

Defined results: null and empty texts are told apart by the encoding; a null source is a tree of its own and comes first; rows of
null doc_id come first within their source and count as untampered; repeated rows are leaves of their own, rows of the same source
and doc_id ascend by their digest; a lone leaf is its tree's top and has no siblings there; an empty table gives an empty table;
texts of any length take part as a whole; of other columns only those named in ``columns`` enter the leaf, the rest play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.line_dedup import UPPER
from prismal.plans.ordered import positions
from prismal.session import materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def leaves(df: DataFrame, columns: Sequence[str] = COLUMNS, doc_id: str = "doc_id", source: str = "source", text: str = "text", every: int = 5) -> DataFrame:
    """doc_id, source, ``hash`` and, where ``every`` divides the crc32 of doc_id, ``tampered``: the hash with A-Z in the text lower-cased."""
    changed = [F.translate(F.col(c), UPPER, UPPER.lower()) if c == text else F.col(c) for c in columns]
    chosen = F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), leaf([F.col(c) for c in columns]).alias("hash"),
                     F.when(chosen, leaf(changed)).alias("tampered"))


def run_places(arity: int) -> Column:
    """The places of a slot-zero node and its siblings, as far as their tree reaches."""
    if arity == 2:
        places = F.array(F.col("place"), F.col("place").bitwiseXOR(F.lit(1).cast("long")))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda slot: F.col("place") + slot)
    return F.filter(places, lambda p: p < F.col("n"))


def runs(nodes: DataFrame, arity: int) -> DataFrame:
    """The runs of one level, by its slot-zero nodes: ``tree``, ``place`` and ``n`` of the parent, its ``hash``, and ``run``, the nodes in order.

    ``nodes``: ``tree``, ``n`` (nodes of the tree in this level), ``place``, ``hash`` and ``own`` (a struct that goes along). Trees of one node are done.
    """
    nodes = nodes.filter("n > 1")
    member = F.struct(F.col("place").alias("at"), "hash", "own")
    zero = nodes.filter(F.col("place") % arity == 0).select("tree", "n", F.col("place").alias("lead"), F.explode(run_places(arity)).alias("place"))
    met = zero.join(nodes.select("tree", "place", member.alias("node")), ["tree", "place"])
    run = met.groupBy("tree", "n", "lead").agg(F.array_sort(F.collect_list("node")).alias("run"))  # ``arity`` nodes at most
    up = run.select("tree", F.expr(f"lead div {arity}").alias("place"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), "run")
    return up.withColumn("hash", F.sha2(F.array_join("run.hash", ""), 256))


def climb(nodes: DataFrame, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs from the lowest up, written, and the trees' tops: ``tree``, ``hash``, ``height`` and ``own`` of lone nodes."""
    empty = F.lit(None).cast(nodes.schema["own"].dataType)
    levels, tops = [], [nodes.filter("n = 1").select("tree", "hash", F.lit(0).alias("height"), "own")]
    while not (up := materialize(runs(nodes, arity), label)).isEmpty():
        levels.append(up)
        nodes = up.select("tree", "n", "place", "hash", empty.alias("own"))
        tops.append(nodes.filter("n = 1").select("tree", "hash", F.lit(len(levels)).alias("height"), "own"))
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return levels, materialize(out, label)


def descend(levels: list[DataFrame], tops: DataFrame, carried: Sequence[str], label: str) -> DataFrame:
    """Every node of the lowest level: ``tree``, ``hash``, ``own``, ``steps`` (its siblings before and after, from its run up) and the ``carried`` columns of its top.

    ``tops``: as ``climb`` gives them, with ``steps`` above the top and the carried columns.
    """
    lone = tops.filter("height = 0").select("tree", "hash", "own", "steps", *carried)
    above = None
    for height in range(len(levels), 0, -1):
        here = tops.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("place"), "steps", *carried)
        above = here if above is None else above.select("tree", "place", "steps", *carried).unionByName(here)
        met = levels[height - 1].select("tree", "place", "run").join(above, ["tree", "place"])
        hashes = F.col("run.hash")
        step = F.struct(F.array_join(F.slice(hashes, F.lit(1), F.col("slot")), "").alias("before"),
                        F.array_join(F.slice(hashes, F.col("slot") + 2, F.size("run")), "").alias("after"))
        out = met.select("tree", "run", "steps", *carried, F.posexplode("run").alias("slot", "node"))
        above = out.select("tree", F.col("node.at").alias("place"), F.col("node.hash").alias("hash"), F.col("node.own").alias("own"),
                           F.concat(F.array(step), F.col("steps")).cast(STEP).alias("steps"), *carried)
        if height > 1:
            above = materialize(above.drop("own"), label)
    return lone if above is None else above.drop("place").unionByName(lone)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings, level by level, give."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def manifest(df: DataFrame, arity: int = 16, columns: Sequence[str] = COLUMNS, doc_id: str = "doc_id", source: str = "source", text: str = "text", every: int = 5) -> DataFrame:
    """For every row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; and ``steps``, the proof itself, before and after by level."""
    rows = positions(leaves(df, columns, doc_id, source, text, every), ["source", "doc_id", "hash"], "at")
    # A tree is named by the number of its first leaf, which ascends with the source.
    trees = materialize(rows.groupBy("source").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "trees")
    placed = rows.join(trees, rows["source"].eqNullSafe(trees["source"]))
    nodes = placed.select("tree", "n", (F.col("at") - F.col("tree")).alias("place"), "hash", F.struct("doc_id", "tampered").alias("own"))
    levels, tops = climb(materialize(nodes, "leaves"), arity, "level")

    # The tops are the leaves of the second tree.
    ordered = positions(tops.select("tree", F.col("hash").alias("subroot")), ["tree"], "place")
    second = ordered.crossJoin(F.broadcast(trees.agg(F.count(F.lit(1)).alias("n"))))  # one row
    second = second.select(F.lit(0).cast("long").alias("tree"), "n", "place", F.col("subroot").alias("hash"), F.struct(F.col("tree").alias("of")).alias("own"))
    high, root = climb(materialize(second, "tops"), arity, "top-level")
    root = root.withColumn("steps", F.array().cast(STEP)).withColumn("root", F.col("hash"))
    paths = descend(high, root, ["root"], "top-paths").select(F.col("own.of").alias("tree"), F.col("hash").alias("subroot"), "steps", "root")
    paths = materialize(paths, "top-paths")

    tops = tops.join(paths, "tree").select("tree", "hash", "height", "own", "steps", "subroot", "root")
    found = descend(levels, materialize(tops, "tops"), ["subroot", "root"], "paths")
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = found.select(F.col("own.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
                       fold(F.coalesce("own.tampered", "hash"), F.col("steps")).alias("folded_root"), "steps")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "steps")
