"""Helpers shared by the text operators: worker-lifetime caches, column passing and flat texts."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept for the life of the Python worker.

    Functions that reach the workers by value get new globals with every task; a module of the
    interpreter outlives them, so tables are built once per worker and not once per task.
    """
    store = sys.modules.setdefault("_prismal_worker_store", types.ModuleType("_prismal_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def with_fields(df: DataFrame, fields: list[StructField]) -> StructType:
    """The schema of ``df`` with ``fields`` behind it; columns of the same names are replaced."""
    new = {f.name for f in fields}
    return StructType([f for f in df.schema.fields if f.name not in new] + fields)


def append(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with the new columns behind it; columns of the same names are replaced."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in new]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(new.values()),
                                      names=[batch.schema.names[i] for i in kept] + list(new))


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20):
    """Consecutive slices of the batch with at most ``limit`` bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = column.fill_null("").cast(pa.large_binary())
    offsets = pc.cumulative_sum(pc.binary_length(ends)).to_numpy(zero_copy_only=False) if len(ends) else []
    start = 0
    while start < batch.num_rows:
        base = offsets[start - 1] if start else 0
        stop = start + 1
        while stop < batch.num_rows and offsets[stop] - base <= limit:
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


def flat_text(column: pa.Array):
    """All texts of the column behind each other as bytes, and where each begins and the last ends; null counts as empty."""
    data = column.fill_null("").cast(pa.large_binary()).to_pylist()
    ends = np.cumsum([0] + [len(x) for x in data], dtype=np.int64)
    return b"".join(data), ends
