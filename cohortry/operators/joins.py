"""Equi-joins of a large fact with dimensions.

No join here carries a broadcast hint: Spark broadcasts a side whose size it knows to be under
``spark.sql.autoBroadcastJoinThreshold`` (AQE checks the measured size again at run time) and otherwise joins by
shuffle, where AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def join_shared(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on shared key names; any other shared name is refused rather than left ambiguous."""
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    clash = shared - {c.lower() for c in on}
    if clash:
        raise ValueError(f"rename before the join: {sorted(clash)}")
    return left.join(right, list(on), how)


def join_renamed(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on differently named keys and drop the right-hand ones."""
    test = reduce(and_, [left[a] == right[b] for a, b in pairs])
    return left.join(right, test, how).drop(*[right[b] for _, b in pairs])


def fill_with_mean(df: DataFrame, column: str) -> DataFrame:
    """Missing values take the column's mean, computed once as a scalar subquery."""
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mean))


def join_audit(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows on both sides, rows of the inner join, unmatched rows of each side.

    Only counts per key are shuffled, so a hot key costs one row per task.
    """
    on = list(on)
    has_key = F.lit(True)
    for k in on:
        has_key = has_key & F.col(k).isNotNull()
    l = left.groupBy(*on).agg(F.count(F.lit(1)).alias("nl"))
    r = right.groupBy(*on).agg(F.count(F.lit(1)).alias("nr"))
    tagged = (
        l.withColumn("nr", F.lit(0).cast("bigint"))
        .unionByName(r.withColumn("nl", F.lit(0).cast("bigint")))
        .groupBy(*on)
        .agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
        .withColumn("ok", has_key)
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return tagged.agg(
        total("nl").alias("left_rows"),
        total("nr").alias("right_rows"),
        total(F.when(F.col("ok"), F.col("nl") * F.col("nr")).otherwise(0)).alias("joined_rows"),
        total(F.when(F.col("ok") & (F.col("nr") > 0), 0).otherwise(F.col("nl"))).alias("left_unmatched"),
        total(F.when(F.col("ok") & (F.col("nl") > 0), 0).otherwise(F.col("nr"))).alias("right_unmatched"),
    )
