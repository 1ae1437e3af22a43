"""Joins against frames of a proven row bound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate beside every row.

    ``one_row`` must come from a global aggregate, so it has exactly one row at
    any data size and the broadcast stays a few bytes.
    """
    return df.join(F.broadcast(one_row))


def rows_from_row(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row frame into one row per struct."""
    return one_row.select(F.inline(F.array(*structs)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)
