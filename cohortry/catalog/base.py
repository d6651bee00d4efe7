"""Registry of queries over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.functions.columns import group_tag, rounded_ratio
from cohortry.roles import ColumnRoles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every floating-point column rounded, for comparison with SQL."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


LINE_KEY = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
SIDES = ("first", "second")
SIDE_CODES = {"first": ["F"], "second": ["O"]}
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "o_orderpriority"]
ROLES = ColumnRoles(numeric=NUMERIC, categorical=CATEGORICAL)

# the study rows of every descriptive query: lines with their part and order
ROWS_SQL = """
lines AS (
  SELECT l.*, p.p_size, p.p_brand, o.o_custkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice, o.o_orderdate,
         round_even(l.l_quantity / nullif(p.p_size, 0), 4) AS ratio,
         CASE o.o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'second' END AS side
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part and order, the ratio of quantity to part size, and the side of the order's status."""
    return (
        fact(spark, sf_dir)
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("ratio", rounded_ratio("l_quantity", "p_size"))
        .withColumn("side", group_tag("o_orderstatus", SIDE_CODES))
    )
