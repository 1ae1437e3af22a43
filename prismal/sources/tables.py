"""Scans and sinks. Missing values are NULL only: empty text and NaN become NULL at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in floating columns."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def scan_csv(spark: SparkSession, path: str, *, schema: StructType | str | None = None, sep: str = ",",
             encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Delimited text. Only the empty field is missing; text such as ``NA`` stays text.

    Give a schema for large inputs: inference reads the data once more.
    """
    reader = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
              .option("nullValue", "").option("emptyValue", "").option("mode", "PERMISSIVE"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalize_missing(reader.csv(path))


def scan_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_csv(spark, path, sep="\t", **options)


def scan_json(spark: SparkSession, path: str, *, schema: StructType | str | None = None,
              multi_line: bool = False) -> DataFrame:
    """JSON records: one object per line (splittable), or arrays of objects with ``multi_line``."""
    reader = spark.read.option("multiLine", multi_line)
    reader = reader.schema(schema) if schema is not None else reader
    return normalize_missing(reader.json(path))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_missing(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str, *, sep: str = ",", encoding: str = "UTF-8") -> str:
    """Delimited text with a header and no index, one file per partition."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding)
     .option("emptyValue", "").csv(path))
    return path


def write_json(df: DataFrame, path: str) -> str:
    """JSON records, one object per line."""
    df.write.mode("overwrite").json(path)
    return path


def export(df: DataFrame, path: str, kind: str) -> str:
    if kind == "csv":
        return write_csv(df, path)
    if kind == "json":
        return write_json(df, path)
    raise ValueError(f"unknown export format {kind!r}")


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Column names by role: numeric, categorical, datetime, other."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for name, kind in df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            out["numeric"].append(name)
        elif kind == "string":
            out["categorical"].append(name)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            out["datetime"].append(name)
        else:
            out["other"].append(name)
    return out
