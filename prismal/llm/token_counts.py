"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; suffix sums over the lengths then answer totals,
quantiles and truncated totals for every context limit without going back to the documents.

Defined results: a null text counts as empty and has length 0; repeated rows each count; an empty table
gives an empty histogram; other columns of the documents, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.llm.bpe import default_ranks, encode_flat, own_encoder
from prismal.llm.common import slices
from prismal.session import materialize


def lengths(df: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """One row ``n_tokens`` for each document."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cache = own_encoder(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                _, begin, _, _ = encode_flat(batch.column(0), splitter, cache)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(begin), pa.int64())], names=["n_tokens"])

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """``n_tokens``, ``n_docs``: how many documents have each length. Combined before the shuffle, and written, as answers read it repeatedly."""
    return materialize(counts.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame, per: int = 128) -> DataFrame:
    """For every length L that occurs: documents and tokens at least that long, the total truncated to L, and ranks.

    ``docs_from`` / ``tokens_from``: documents of length L or more, and their tokens. ``truncated_tokens``:
    the corpus total if every document is cut to L tokens. ``docs_upto``: documents of length L or less.
    Lengths are summed in ranges of ``per``, then the ranges, so no window holds the whole histogram.
    """
    block = (F.col("n_tokens") / per).cast("long")
    rows = hist.withColumn("_block", block).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    totals = totals.select("_block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_d", "_t")],
                           F.sum("_d").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
                           F.sum("_t").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("docs_from", F.sum("n_docs").over(inside)).withColumn("tokens_from", F.sum("_tokens").over(inside))
    out = out.join(totals, "_block")
    docs, tokens = F.col("docs_from") + F.col("_d"), F.col("tokens_from") + F.col("_t")
    return out.select("n_tokens", "n_docs", docs.alias("docs_from"), tokens.alias("tokens_from"),
                      (F.col("_n") - docs + F.col("n_docs")).alias("docs_upto"),
                      (F.col("_all") - tokens + docs * F.col("n_tokens")).alias("truncated_tokens"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """``probability``, ``n_tokens``: the smallest length that at least that share of documents doesn't exceed."""
    total = F.col("docs_from") + F.col("docs_upto") - F.col("n_docs")
    asked = sums.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    need = F.greatest(F.ceil(F.col("probability") * total), F.lit(1))
    return asked.filter(F.col("docs_upto") >= need).groupBy("probability").agg(F.min("n_tokens").alias("n_tokens"))


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, and the corpus total cut to it. Limits need not occur as lengths."""
    asked = sums.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    over = F.col("n_tokens") > F.col("context_limit")
    return asked.groupBy("context_limit").agg(
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "context_limit")).alias("truncated_tokens"))
