"""Counts over whole texts that quality rules and rankings are made of.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
A null text counts as empty: all counts are 0, but for one (empty) line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from prismal.llm.common import SPACES, append, with_fields

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_marks",
          "n_same_next", "n_distinct")


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        pair = ids[:-1] * len(places) + ids[1:]
        if len(places) > 1 << 20:  # three factors would not fit into 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(places) + ids[2:]
        order = np.argsort(window, kind="stable")
        ordered = window[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(n, np.bool_)
        at = np.concatenate([order[1:][same], order[:-1][same]])
        for shift in range(3):
            twice[at + shift] = True
        repeated = int(twice.sum())
    lines = text.split("\n")
    full = [line for line in lines if line.strip(SPACES)]
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeated, len(lines),
            sum(map(str.isupper, text)) if not text.islower() else 0, sum(map(raw.count, map(bytes, zip(b"0123456789")))),
            text.count(".") + text.count(","), text.count("!") + text.count("?"), int((ids[1:] == ids[:-1]).sum()), len(places))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts behind it; columns of their names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = batch.column(batch.schema.get_field_index(text))
                found = np.array([text_counts(t.as_py() or "") for t in texts], np.int64).reshape(-1, len(COUNTS))
                yield append(batch, {name: pa.array(found[:, i]) for i, name in enumerate(COUNTS)})

    return df.mapInArrow(run, with_fields(df, [StructField(c, LongType()) for c in COUNTS]))


def ratios() -> dict[str, Column]:
    """Shares made of the counts: independent of a text's length, 0 where there is nothing to divide by."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars, "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words, "upper": F.col("n_upper") / chars, "digits": F.col("n_digits") / chars,
        "stops": F.col("n_stops") / words, "marks": F.col("n_marks") / words, "same_next": F.col("n_same_next") / words,
        "word_length": F.col("word_chars") / words, "distinct": F.col("n_distinct") / words,
    }
