"""Flat files of token ids, with 64-bit document offsets, that are read back through a memory map.

Documents are dealt out by ranges of their id, so that the files in order of their numbers hold the
documents in ascending order. Each task writes one shard: its ids as unsigned integers (16 bits if all ids
fit, else 32), the offset of each document in the shard and the document ids. A manifest row for each shard
has its counts; prefix sums over the manifest give every shard's base, so no document waits for another.

Defined results: a null text counts as empty and holds the end id alone; a null doc_id comes first; rows of equal
doc_id stand in the order of their texts' hash and each has its own place; an empty table writes an empty
manifest; other columns, whatever their names, are not written; texts of any length are written whole; the name of an added token
within a text gives that token, as in the library.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.llm.bpe import Pretokenizer, SliceCache, encode_flat
from prismal.llm.common import slices, worker_cache
from prismal.session import work_path

NO_ID = -(2**63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library_encoder(path: str):
    """Splitter and cache over the tokenizers library, its vocabulary's size, its added tokens and its own call.

    The library encodes every distinct slice; slices seen before come from the cache. A slice by itself is split
    by the library just as within its text, unless the text holds the name of an added token: such texts go to the library whole.
    """

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)

        def many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.array([len(x) for x in found], np.int64)
            return np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())), counts

        def merge(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = data.tobytes()
            return many([raw[a : a + n].decode("utf-8") for a, n in zip(begin.tolist(), lengths.tolist())])

        added = [t.content for t in library.get_added_tokens_decoder().values()]
        return (worker_cache(("splitter",), Pretokenizer), SliceCache(merge, lambda piece: many([piece.decode("utf-8")])[0]),
                library.get_vocab_size(), added, lambda text: many([text])[0])

    return worker_cache(("library", path), make)


def encoded(column: pa.Array, splitter: Pretokenizer, cache: SliceCache, added: list[str], whole) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of the column behind each other, as the library gives them, and where each text's begin and the last end."""
    named = np.zeros(len(column), np.bool_)
    for name in added:
        named |= pc.match_substring(column, name).to_numpy(zero_copy_only=False)
    if not named.any():
        return encode_flat(column, splitter, cache)[:2]
    ids, begin = encode_flat(pc.if_else(pa.array(named), "", column), splitter, cache)[:2]
    parts = [whole(column[i].as_py()) if named[i] else ids[begin[i] : begin[i + 1]] for i in range(len(column))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its file system: a path without one lies in Hadoop's default file system, for Spark and for the tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder with a scheme, and the folder's path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Writes shards and the manifest to ``folder``, which all executors share; returns the manifest.

    A task writes to names of its own attempt and renames them at the end, so repeated and speculative
    attempts leave whole files. The content of a shard depends on its rows alone.
    """
    path, folder = tokenizer or default_tokenizer(), qualified(df.sparkSession, folder)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cache, size, added, alone = library_encoder(path)
        kind = np.dtype("<u2" if max(size - 1, end_id) < 1 << 16 else "<u4")
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        names = {what: (f"{root}/{what}-{shard:06d}.{attempt}.tmp", f"{root}/{what}-{shard:06d}.bin") for what in ("ids", "offsets", "docs")}
        out = {what: store.open_output_stream(tmp) for what, (tmp, _) in names.items()}
        docs = tokens = 0
        first = True
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, begin = encoded(batch.column(1), splitter, cache, added, alone)
                n = batch.num_rows
                places = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(begin))  # one end id after each document
                flat = np.full(len(ids) + n, end_id, kind)
                flat[places] = ids
                out["ids"].write(flat.tobytes())
                offsets = tokens + begin + np.arange(n + 1)
                out["offsets"].write((offsets if first else offsets[1:]).astype("<u8").tobytes())
                out["docs"].write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs, tokens, first = docs + n, tokens + len(flat), False
        for stream in out.values():
            stream.close()
        for tmp, name in names.values():
            if first:
                store.delete_file(tmp)
            else:
                store.move(tmp, name)
        if not first:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs], "tokens": [tokens], "width": [kind.itemsize]})

    spark = df.sparkSession
    rows.mapInArrow(run, "shard long, docs long, tokens long, width long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard, with the documents and ids of all shards before it as ``first_doc`` and ``first_token``."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/manifest").select(
        "*", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first_doc"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_token"))


class Stretches:
    """Numbers in a file, of which slices are read where they are asked for: through a memory map, or by ranged reads off a local disk."""

    def __init__(self, store: fs.FileSystem, name: str, kind: str):
        self.kind = np.dtype(kind)
        local = isinstance(store, fs.LocalFileSystem)
        self.file, self.map = (None, np.memmap(name, kind, "r")) if local else (store.open_input_file(name), None)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[at]
        return np.frombuffer(self.file.read_at((at.stop - at.start) * self.kind.itemsize, at.start * self.kind.itemsize), self.kind)


def open_shard(folder: str, shard: int, width: int) -> tuple[Stretches, Stretches, Stretches]:
    """Document ids, offsets and token ids of a shard below a folder with a scheme."""
    store, root = _store(folder)
    return tuple(Stretches(store, f"{root}/{what}-{shard:06d}.bin", kind) for what, kind in (("docs", "<i8"), ("offsets", "<u8"), ("ids", f"<u{width}")))


def read(spark: SparkSession, folder: str, per: int = 2048) -> DataFrame:
    """The documents of the files: doc_id, ``start`` (ids before it in all shards), ``ids`` (with the end id)."""
    folder = qualified(spark, folder)
    shards = manifest(spark, folder)
    # Shards are read in parts of ``per`` documents, dealt out evenly; each part maps just its stretch of the file.
    parts = shards.select("*", F.explode(F.sequence(F.lit(0), F.col("docs") - 1, F.lit(per))).alias("part"))
    # A fixed number of partitions: the rows are few and small, but what they stand for is not.
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, ids = open_shard(folder, row["shard"], row["width"])
                for a in range(row["part"], min(row["part"] + per, row["docs"]), 256):
                    b = min(a + 256, row["part"] + per, row["docs"])
                    at = offsets[a : b + 1].astype(np.int64)
                    own = np.asarray(docs[a:b])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(row["first_token"] + at[:-1], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ids[int(at[0]) : int(at[-1])].astype(np.int32)))],
                        names=["doc_id", "start", "ids"])

    return parts.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes the documents to a new folder of the shared one and returns what the files hold."""
    folder = work_path(df.sparkSession, "token-files")
    write(df, folder, **options)
    return read(df.sparkSession, folder)
