"""Query registry: each entry pairs a Spark callable with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _rounded(c: Column, digits: int) -> Column:
    """Half away from zero in double arithmetic, as the SQL side rounds; 0.0 is added to avoid -0.0."""
    scale = float(10**digits)
    up = F.floor(F.abs(c) * scale + 0.5) / scale
    return F.when(F.abs(c) < 4e18 / scale, F.signum(c) * up + 0.0).otherwise(c)


def rounded(df: DataFrame, columns: str, digits: int) -> DataFrame:
    """Round the named columns."""
    chosen = {c.strip('"') for c in columns.split()}
    return df.select(*[_rounded(F.col(f"`{c}`"), digits).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def rounded_sql(sql: str, columns: str, digits: int) -> str:
    parts = ", ".join(f'round({c}, {digits}) + 0.0::DOUBLE AS {c}' for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS answer"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query. ``doubles`` names the columns rounded on both sides."""

    def add(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            answer = fn(Tables(spark, sf_dir))
            return rounded(answer, doubles, digits) if doubles else answer

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, doubles, digits) if doubles else sql
        return fn

    return add


class Tables:
    """The given parquet tables of one scale-factor folder, plus the derived views of ``VIEWS``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            source, text = VIEWS[name]
            return self.spark.sql(text.replace(source, "{" + source + "}"), **{source: getattr(self, source)})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# Derived views with missing values, outliers, duplicates and mistyped text. Same text for both engines.
VIEWS = {
    "dirty_lineitem": ("lineitem", """
        WITH base AS (
          SELECT l_orderkey, l_linenumber, l_returnflag,
                 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
                 CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
                 CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
                 CASE WHEN l_orderkey % 5 <> 0 THEN NULL ELSE l_tax END AS l_tax_sparse
          FROM lineitem)
        SELECT *, 0 AS dup FROM base
        UNION ALL
        SELECT *, 1 AS dup FROM base WHERE l_orderkey % 17 = 0"""),
    "dirty_customer": ("customer", """
        SELECT c_custkey, c_acctbal,
               CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
                    WHEN c_custkey % 7 = 0 THEN concat('  ', c_mktsegment, ' ')
                    ELSE c_mktsegment END AS segment,
               concat(c_name, CASE WHEN c_custkey % 4 = 0 THEN '#!' ELSE '' END) AS name,
               CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR(10)) END AS nation_text,
               CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS opt_in_text
        FROM customer"""),
    "text_dates": ("orders", """
        SELECT o_orderkey, o_totalprice,
               CASE WHEN o_orderkey % 25 = 0 THEN 'unknown'
                    ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS order_date_text
        FROM orders"""),
    "gappy_events": ("events", """
        SELECT event_id, ts, user_id, event_type, value FROM events
        WHERE day(ts) NOT IN (5, 6, 17)"""),
}


def view_sql(name: str) -> str:
    """The view as a parenthesized subquery for the SQL side."""
    return "(" + VIEWS[name][1] + ")"


DIRTY_LINEITEM = view_sql("dirty_lineitem")
DIRTY_CUSTOMER = view_sql("dirty_customer")
TEXT_DATES = view_sql("text_dates")
GAPPY_EVENTS = view_sql("gappy_events")
