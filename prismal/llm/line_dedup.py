"""Removes lines that many documents share.

Normalised lines are exploded with their positions and hashed (128 bits); documents are counted for each hash, and
a line that enough documents hold is dropped from all of them but the one of the smallest doc_id. The rest is put
together again by position.

Defined results: a null or empty text is one empty line, which is too short to drop; a row of null doc_id takes no
part in the counts and keeps its lines; rows that share a doc_id are one document for the counts, and each text
among them is answered by its own lines; texts and lines of any length count as a whole; an empty table gives an empty table; other columns are kept, those named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import SPACES
from prismal.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without outer white space, its letters A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    # Where all characters are ASCII, lower() changes the same letters and is cheaper.
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def version(text: Column) -> Column:
    """Tells texts of the same doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The lines to drop: doc_id, ``version`` and ``pos``, for every line whose key ``min_docs`` documents hold, the first document's aside."""
    lines = df.select(F.col(doc_id).alias("doc_id"), version(F.col(text)).alias("version"), F.posexplode(split_lines(F.col(text))).alias("pos", "line")).filter(F.col("doc_id").isNotNull())
    lines = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = materialize(lines.select("doc_id", "version", "pos", F.unhex(F.md5("key")).alias("hash")), "lines")
    if min_docs == 2:  # two documents hold it if the smallest and the largest differ
        held = lines.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    else:
        held = lines.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= min_docs)
    held = materialize(held.select("hash", "first"), "held")  # a plain scan on both sides: a line of very many documents can be split
    return lines.join(held, "hash").filter("doc_id > first").select("doc_id", "version", "pos")


def drop_repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``df`` with the repeated lines gone from its text, and ``n_lines`` (before) and ``n_dropped``."""
    drops = repeated_lines(df, doc_id, text, min_chars, min_docs)
    drops = drops.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drop"))  # at most the lines of one text
    rest = df.drop("n_lines", "n_dropped")
    row = F.struct(*rest.columns).alias("row")  # columns of any name stay apart from those of the join
    joined = rest.select(F.col(doc_id).alias("doc_id"), version(F.col(text)).alias("version"), row).join(drops, ["doc_id", "version"], "left")
    joined = joined.withColumn("lines", split_lines(F.col("row")[text]))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text_kept = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    new = F.when(F.col("drop").isNull(), F.coalesce(F.col("row")[text], F.lit(""))).otherwise(text_kept)
    return joined.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in rest.columns], F.size("lines").cast("long").alias("n_lines"),
                         F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_dropped"))
