"""From raw documents to training tokens, in stages that each call one operator of prismal.llm.

Every stage works on all documents that the one before it kept; all but the last return the columns of ``documents``.

Defined results: a null or empty text has no words, so the quality rules reject it; a stage given one treats null as empty, and the line stage
returns it as empty. Texts of any length count as a whole. Rows that repeat a doc_id and text are kept until the near-duplicate stage, which keeps one;
texts that share a doc_id stand each for itself. Rows of null doc_id lose no lines and are never duplicates. A null source is a source of its own.
Without labels the forest rejects nothing. An empty table gives an empty table. Other columns are passed on as they are, but for those named
like an output of a stage's operator (``kept``, ``n_lines``, ``slot`` and the like), which hold the operator's values from there on.
"""

from __future__ import annotations

import prismal
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from prismal.session import materialize

# Python workers get the package's functions by value, so they need no copy on their path.
cloudpickle.register_pickle_by_value(prismal)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the isolation forest keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, labels).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars`` is that of the new text."""
    out = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sources weigh the square root of their size. The order is that of the files written and of their rows."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def with_place(docs: DataFrame) -> DataFrame:
    """``docs``, read from files, with ``place``: the number from 1 of each row in the order of the files and of their rows."""
    name = F.col("_metadata.file_name")
    # Numbers of Spark's part files have five digits or more.
    part = F.coalesce(F.regexp_extract(name, r"^part-([0-9]+)", 1).try_cast("long"), F.lit(0))
    files = docs.select(name.alias("_file"), part.alias("_part")).groupBy("_part", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = docs.select(*docs.columns, name.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.join(F.broadcast(files), "_file")
    return rows.select(*docs.columns, (F.col("_first") + F.col("_row") + 1).alias("place"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, the ids of every text, their number, the digest of the text decoded from them, and the text's ``place`` in the mix."""
    coded = bpe.round_trip(with_place(docs.select("doc_id", "source", "text")))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "place")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mix_sources", mix), ("byte_bpe", tokens)]

#: No SQL: the stages fit a forest, draw hashed signatures and schedule blocks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
