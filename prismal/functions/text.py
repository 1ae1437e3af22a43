"""String expressions with the missing-value and whitespace rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c): return F.lower(_col(c))
def upper(c): return F.upper(_col(c))


def title(c: Column | str) -> Column:
    """Upper-case every letter that starts a run of letters, lower-case the rest."""
    pieces = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, F.initcap), "")


def strip(c: Column | str) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^\s+", ""), r"\s+$", "")


def remove_special(c: Column | str) -> Column:
    """Keep ASCII letters, digits and whitespace."""
    return F.regexp_replace(_col(c), r"[^a-zA-Z0-9\s]", "")


def length(c: Column | str) -> Column:
    return F.length(_col(c))


def has_edge_space(c: Column | str) -> Column:
    return _col(c).rlike(r"^\s|\s$")


def has_special(c: Column | str) -> Column:
    return _col(c).rlike(r"[^a-zA-Z0-9\s]")


def clip(c: Column | str, low: Column, high: Column) -> Column:
    """Limit to [low, high]; missing stays missing."""
    c = _col(c)
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def bands(c: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """Label by the first threshold the value reaches, thresholds given from high to low."""
    chosen = F.when(c.isNull(), None)
    for threshold, label in steps:
        chosen = chosen.when(c >= threshold, label)
    return chosen.otherwise(default)
