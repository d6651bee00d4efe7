"""Order statistics without a window or a hash table over all rows of a group.

``with_counts_below`` is the base: rows are first reduced to (key, value, count); value cut points, taken from a
sketch over all of them, then split every key into buckets that hold at most about 1/buckets of the distinct values each. Running
counts are taken inside a bucket, and bucket totals are added. A single key with billions of distinct values is
therefore spread over as many tasks as there are shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortry.functions.columns import null_if_nan
from cohortry.session import local_table, stored

_SKETCH = 10_000  # accuracy of the quantile sketch: rank error at most rows / _SKETCH
# half widths of a bracket around a quantile, as shares of a group's rows; the first that spans enough ranks is taken
_MARGINS = (5 / _SKETCH, 10 * 5 / _SKETCH, 100 * 5 / _SKETCH, 1.0)
_RANKS = 3
_BROADCAST_BYTES = 64 << 20  # of a bracket table; larger ones are joined by a shuffle


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with one row per non-missing number."""
    wide = df.select(*keep, *[null_if_nan(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "feature", "value").filter(F.col("value").isNotNull())


def _cuts_below(cuts, value, n: int):
    """How many of ``n`` ascending cuts lie below the value: a binary search, one look into the array per halving."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]

    def halve(found, step):
        return F.when((found + step <= n) & (F.get(cuts, found + step - 1) < value), found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def with_counts_below(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """Add ``below`` (rows of the key with a smaller value) and ``key_rows`` to distinct (keys, value) counts."""
    keys = list(keys)
    buckets = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = counts.withColumn("__bucket", F.lit(0))
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        # the always-true test on n keeps the column, so this branch reuses the exchange behind `counts`
        cuts = counts.agg(F.percentile_approx(F.when(F.col(n) > 0, F.col(value)), shares, 10 * buckets)).scalar()
        placed = (
            counts.withColumn("__cuts", cuts)
            # never null, or Spark would test the bucket for null on every input row ahead of the counting
            .withColumn("__bucket", F.coalesce(_cuts_below(F.col("__cuts"), F.col(value), buckets - 1), F.lit(0)))
            .drop("__cuts")
        )
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__bucket")
        .agg(F.sum(n).alias("__size"))
        .select(
            *keys,
            "__bucket",
            F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
            F.sum("__size").over(Window.partitionBy(*keys)).alias("key_rows"),
        )
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, [*keys, "__bucket"])
        .withColumn("below", F.col("__offset") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .drop("__bucket", "__offset")
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, avg_rank): the rank every tied row of a value shares."""
    keys = list(by) or ["__all"]
    base = df if by else df.withColumn("__all", F.lit(0))
    counts = (
        base.select(*keys, null_if_nan(F.col(value).cast("double")).alias(value))
        .dropna("any")
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = with_counts_below(counts, keys, value, "n")
    return ranked.select(*by, value, "n", (F.col("below") + (F.col("n") + 1) / 2).alias("avg_rank"))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles: (by..., feature, n_rows, q), ``q`` in the (ascending) order of ``probs``.

    Pass one sketches a bracket around every quantile, several times as wide as the sketch's error bound and at least a
    few ranks. Pass two counts rows outside the brackets per gap and keeps single values only inside them, so of large
    groups a shuffle carries about 0.1 % of the rows per quantile. Where a bracket still misses its quantile, the group is
    counted once more with all its values. The table of brackets is written out and broadcast only if it is small.
    """
    if list(probs) != sorted(probs):
        raise ValueError("probs must ascend")
    keys = [*by, "feature"]
    rows = long_values(df.dropna("any", subset=list(by)) if by else df, columns, by)
    edges = [e for p in probs for m in _MARGINS for e in (max(0.0, p - m), min(1.0, p + m))]
    n, margin = F.count("value"), F.lit(len(_MARGINS) - 1)
    for i in reversed(range(len(_MARGINS) - 1)):
        margin = F.when(n * _MARGINS[i] >= _RANKS, i).otherwise(margin)
    sketched = rows.groupBy(*keys).agg(F.percentile_approx("value", edges, _SKETCH).alias("__s"), margin.alias("__m"))
    at = lambda i, side: F.get("__s", 2 * (i * len(_MARGINS) + F.col("__m")) + side)
    brackets = sketched.select(*keys, F.array(*[at(i, side) for i in range(len(probs)) for side in (0, 1)]).alias("__e"))
    if by:
        brackets = stored(brackets, "brackets")
        small = brackets.count() * (16 * len(probs) + 64 * len(keys)) <= _BROADCAST_BYTES
    else:  # one row per column
        found = [tuple(r) for r in brackets.collect()]
        brackets, small = local_table(df.sparkSession, {"feature": pa.string(), "__e": pa.list_(pa.float64())}, found), True
    done = stored(_inside_brackets(rows, F.broadcast(brackets) if small else brackets, keys, probs), "quantiles")
    missed = F.exists("q", lambda v: v.isNull())
    if done.filter(missed).isEmpty():
        return done
    whole = F.array(*[F.lit(float(x)) for _ in probs for x in ("-inf", "inf")]).alias("__e")
    again = done.filter(missed).select(*keys, whole)
    return done.filter(~missed).unionByName(_inside_brackets(rows.join(again.select(*keys), keys, "left_semi"), again, keys, probs))


def _inside_brackets(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from (keys..., value) rows and a bracket per quantile; null where a quantile lies outside its bracket."""

    def inside_or_gap(v, e):
        """The value itself inside a bracket, else the end of the bracket below it."""
        kept = F.lit(float("-inf"))
        for i in range(len(probs)):  # the last test written is the first one tried: brackets from the top down
            kept = F.when(v > e[2 * i + 1], e[2 * i + 1]).when(v >= e[2 * i], v).otherwise(kept)
        return kept

    kept_rows = rows.join(brackets, list(keys)).select(*keys, inside_or_gap(F.col("value"), F.col("__e")).alias("__kept"), "value")
    counts = (
        kept_rows.groupBy(*keys, F.col("__kept").alias("value"))
        .agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__kept") == F.col("value")).alias("__inside"))
    )
    ranked = with_counts_below(counts, keys, "value", "__n")
    v, last = F.col("value"), F.col("below") + F.col("__inside")

    def value_at(rank):
        return F.min(F.when((F.col("below") <= rank) & (rank < last), v))

    picks = []
    for i, p in enumerate(probs):
        at = (F.col("key_rows") - 1) * F.lit(float(p))
        picks += [value_at(F.floor(at)).alias(f"__lo{i}"), value_at(F.ceil(at)).alias(f"__hi{i}")]
    found = ranked.groupBy(*keys).agg(F.max("key_rows").alias("n_rows"), *picks)
    q = []
    for i, p in enumerate(probs):
        at = (F.col("n_rows") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        q.append(lo + (hi - lo) * (at - F.floor(at)))
    return found.select(*keys, "n_rows", F.array(*q).alias("q"))


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact medians, one row per group and one column per input column."""
    long = quantiles(df, columns, [0.5], by)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in columns])


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = 10, fallback_bins: int = 5) -> DataFrame:
    """(feature, edges): distinct quantile edges; a feature that cannot be cut has no row.

    Fewer than two distinct edges with ``bins`` means trying ``fallback_bins``; a constant feature fails both.
    """
    probs = sorted({i / bins for i in range(bins + 1)} | {i / fallback_bins for i in range(fallback_bins + 1)})
    at = {p: i for i, p in enumerate(probs)}
    pick = lambda k: F.array_distinct(F.array(*[F.col("q")[at[i / k]] for i in range(k + 1)]))
    edges = quantiles(df, columns, probs)
    first, second = pick(bins), pick(fallback_bins)
    return edges.select("feature", F.when(F.size(first) >= 2, first).otherwise(second).alias("edges")).filter(
        F.size("edges") >= 2
    )


def bin_index(value, inner, n: int):
    """Right-closed bin of a value: how many of the ``n`` ascending inner edges lie below it."""
    index = F.lit(0)
    for i in range(n):  # the last test written is the first one tried
        index = F.when(value > inner[i], i + 1).otherwise(index)
    return index


def quantile_bins(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Long rows (keep..., feature, value, bin), the lowest edge included in bin 0.

    The edges are found first, one short row per column, so binning itself is a projection behind the join of a local
    table. Columns that cannot be cut have no rows.
    """
    inner = [(r["feature"], r["edges"][1:-1]) for r in quantile_edges(df, columns, bins).collect()]
    longest = max((len(e) for _, e in inner), default=0)
    padded = [(f, e + [float("inf")] * (longest - len(e))) for f, e in inner]
    table = local_table(df.sparkSession, {"feature": pa.string(), "__inner": pa.list_(pa.float64())}, padded)
    rows = long_values(df, columns, keep).join(F.broadcast(table), "feature")
    return rows.withColumn("bin", bin_index(F.col("value"), F.col("__inner"), longest)).drop("__inner")
