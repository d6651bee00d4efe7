"""Grouped and global aggregates over missing-aware columns.

NaN counts as missing in means, deviations and sums of floating-point columns; missing keys never form a group. Value counts for many columns come from one pass with grouping sets, so each column
keeps its own type and the shuffle carries counts, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.columns import number
from cohortry.operators.order_stats import medians

_Z95 = 1.959963984540054
_MAX_SETS = 60  # columns per grouping-sets pass: the grouping id has 64 bits


def keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.filter(reduce(and_, [F.col(k).isNotNull() for k in by])) if by else df


def mean_by(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return keyed(df, by).groupBy(*by).agg(*[F.avg(number(c)).alias(c) for c in columns])


def mean_and_std(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_std`` for every column."""
    std = F.stddev_pop if population else F.stddev_samp
    return df.agg(*[a for c in columns for a in (F.avg(number(c)).alias(f"{c}_mean"), std(number(c)).alias(f"{c}_std"))])


def count_by(df: DataFrame, by: Sequence[str], name: str = "count") -> DataFrame:
    return keyed(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    value = number(column) if dict(df.dtypes)[column] in ("double", "float") else F.col(column)
    return keyed(df, by).groupBy(*by).agg(F.sum(value).alias(column))


def sizes_by_side(df: DataFrame, by: Sequence[str], value: str, sides: dict[str, Column]) -> DataFrame:
    """Rows with a value per group, one count column per side condition."""
    present = F.col(value).isNotNull()
    return keyed(df, by).groupBy(*by).agg(*[F.count_if(present & test).alias(name) for name, test in sides.items()])


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> list[tuple[DataFrame, dict[str, Column]]]:
    """Counts of every value of every column per group, in passes of up to 60 columns.

    Each pass is (frame, {column: test}): rows of a column are those where its test holds, and ``__n`` is the count.
    """
    out = []
    for start in range(0, len(columns), _MAX_SETS):
        part = list(columns[start : start + _MAX_SETS])
        counted = df.groupingSets([[*by, c] for c in part], *by, *part).agg(
            F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__n")
        )
        full = 2 ** len(part) - 1
        tests = {
            c: (F.col("__set") == full - 2 ** (len(part) - 1 - i)) & F.col(c).isNotNull() for i, c in enumerate(part)
        }
        out.append((counted, tests))
    return out


def _per_pass(df, columns, by, make) -> DataFrame:
    parts = []
    for counted, tests in value_counts(keyed(df, by), columns, by):
        parts.append(counted.groupBy(*by).agg(*[make(c, test).alias(c) for c, test in tests.items()]))
    if by:
        return reduce(lambda a, b: a.join(b, list(by)), parts)
    return reduce(lambda a, b: a.withColumns({c: b.select(c).scalar() for c in b.columns}), parts)


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of every column, in the column's type; ties go to the smallest value."""

    def most_frequent(c, test):
        return F.min_by(F.when(test, F.col(c)), F.when(test, F.struct(-F.col("__n"), F.col(c))))

    return _per_pass(df, columns, by, most_frequent)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: number of distinct non-missing values of every column."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    return _per_pass(df, columns, (), lambda c, test: F.count_if(test))


def low_cardinality(df: DataFrame, columns: Sequence[str], threshold: int = 50) -> list[str]:
    """Columns with at most ``threshold`` distinct values.

    Every task keeps at most ``threshold + 1`` values of a column, which is enough to know; a column with more in one task is
    settled there, and the other columns' few values are put together.
    """
    if not columns:
        return []
    most = threshold + 1

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set[str]] = [set() for _ in columns]
        for batch in batches:
            for own, values in zip(seen, batch.columns):
                if len(own) < most:
                    own.update(v for v in values.unique().to_pylist() if v is not None)
        rows = [(i, v) for i, own in enumerate(seen) for v in sorted(own)[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["at", "v"])

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    counts = texts.mapInArrow(few, "at int, v string").groupBy("at").agg(F.count_distinct("v").alias("n")).collect()
    found = {r["at"]: r["n"] for r in counts}
    return [c for i, c in enumerate(columns) if found.get(i, 0) <= threshold]


def mean_with_interval(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean with a 95 % normal interval per group; the interval is null for a single row."""
    half = F.lit(_Z95) * F.col("std") / F.sqrt("n")
    return (
        keyed(df, by)
        .groupBy(*by)
        .agg(F.avg(number(value)).alias("mean"), F.stddev_samp(number(value)).alias("std"), F.count(number(value)).alias("n"))
        .select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
    )


def mean_order(df: DataFrame, key: str, value: str, name: str = "mean_value") -> DataFrame:
    """Attach the mean of ``value`` per ``key``, the order in which a comparison lists its keys (report-sized input)."""
    return df.join(df.groupBy(key).agg(F.avg(number(value)).alias(name)), key)


def medians_and_modes(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row of fill values: exact medians of numbers, modes of categories."""
    parts = []
    if numeric:
        parts.append(medians(df, numeric))
    if categorical:
        parts.append(modes(df, categorical))
    return reduce(lambda a, b: a.withColumns({c: b.select(c).scalar() for c in b.columns}), parts)
