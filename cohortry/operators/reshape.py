"""Unpivot, stacking, grids of value lists, latest row per key, top rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import DataFrame, Window, functions as F


def unpivot_years(df: DataFrame, ids: Sequence[str], years: Sequence[str], year: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(years), year, value).withColumn(year, F.col(year).cast("int"))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def expand_values(df: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the given value lists for every row, by exploding literal arrays (no join)."""
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return df


def value_grid(spark, values: Mapping[str, Sequence]) -> DataFrame:
    """The cartesian product of the lists alone: every number of a range is read as one place per list, so that tasks share the grid."""
    places, stride = {}, prod(len(items) for items in values.values())
    grid = spark.range(stride)
    for name, items in values.items():
        stride //= max(1, len(items))
        at = F.expr(f"CAST((id div {max(1, stride)}) % {max(1, len(items))} AS INT)")
        places[name] = F.get(F.array(*[F.lit(v) for v in items]), at)
    return grid.select(*[c.alias(name) for name, c in places.items()])


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """One row per key, the newest; ties are decided by ``tie_break`` and then by every other column.

    Spark keeps only the first row per key of each task ahead of the shuffle (window group limit), so a hot key is
    one row per task.
    """
    rest = [c for c in df.columns if c not in {*keys, newest, *tie_break}]
    order = [F.col(newest).desc_nulls_last(), *[F.col(c).asc() for c in [*tie_break, *rest]]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).filter(F.col("__first") == 1).drop("__first")


def top_rows(df: DataFrame, by: str, n: int = 20, tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *tie_break).limit(n)


def arg_min(df: DataFrame, label: str, cost: str) -> DataFrame:
    """The label with the smallest cost; equal costs go to the smaller label."""
    return df.filter(F.col(cost).isNotNull()).agg(
        F.min_by(label, F.struct(cost, label)).alias(label), F.min(cost).alias(cost)
    )
