"""Shapley attributions: exact path attributions for trees, permutation estimates for any model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortry.operators.ensembles import lists, matrix
from cohortry.operators.rows import sample_rows
from cohortry.operators.trees import leaf_paths


#: Nodes of a part whose leaves a task keeps between batches; those of larger ones are walked again, one at a time.
_KEPT_NODES = 4_096


@dataclass(frozen=True)
class Leaf:
    """A leaf as a product of one interval test per feature on its path."""

    value: float
    slots: np.ndarray
    low: np.ndarray  # x > low
    high: np.ndarray  # x <= high
    share: np.ndarray  # part of the training rows that passes the tests of a feature


def _leaf(value: float, path: list) -> Leaf:
    low, high, share = {}, {}, {}
    for slot, threshold, below, part in path:
        low.setdefault(slot, -np.inf), high.setdefault(slot, np.inf), share.setdefault(slot, 1.0)
        if below:
            high[slot] = min(high[slot], threshold)
        else:
            low[slot] = max(low[slot], threshold)
        share[slot] *= part
    slots = sorted(share)
    take = lambda d: np.array([d[s] for s in slots], dtype=float)
    return Leaf(value, np.array(slots, dtype=int), take(low), take(high), take(share))


def tree_leaves(part: Sequence[dict]) -> Iterator[Leaf]:
    """The leaves of a part of a model, with their values times the tree's weight."""
    for tree in part:
        for leaf, path in leaf_paths(tree):
            yield _leaf(float(tree["value"][leaf]) * tree["weight"], path)


def model_baseline(model) -> float:
    """The prediction of a model where no feature is known, part by part."""
    return model.getOrDefault(model.base) + sum(baseline(list(tree_leaves(part))) for part in model.parts())


def baseline(leaves: Sequence[Leaf]) -> float:
    """Expected prediction under the training shares."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def path_attributions(x: np.ndarray, leaves: Iterable[Leaf]) -> np.ndarray:
    """Shapley values of every row: a leaf's game is a product, so coalitions of equal size share one coefficient."""
    out, columns = np.zeros(x.T.shape), np.ascontiguousarray(x.T)
    for leaf in leaves:
        d = len(leaf.slots)
        if d == 0:
            continue
        if 1 << d < len(x):  # fewer ways to pass than rows: each is worked out once, and rows look theirs up
            way = np.zeros(len(x), np.int64)
            for j, slot in enumerate(leaf.slots):
                way += ((columns[slot] > leaf.low[j]) & (columns[slot] <= leaf.high[j])).astype(np.int64) << j
            each = _leaf_attributions((np.arange(1 << d)[:, None] >> np.arange(d)) % 2 == 1, leaf)
            for j, slot in enumerate(leaf.slots):
                out[slot] += each[:, j].take(way)
            continue
        passes = np.stack([(columns[s] > low) & (columns[s] <= high) for s, low, high in zip(leaf.slots, leaf.low, leaf.high)], axis=1)
        out[leaf.slots] += _leaf_attributions(passes, leaf).T
    return out.T


def _leaf_attributions(passes: np.ndarray, leaf: Leaf) -> np.ndarray:
    """(rows, slots of the leaf): the values of rows that pass the leaf's tests as given."""
    d = len(leaf.slots)
    out = np.empty(passes.shape)
    product = np.ones((len(passes), 1))
    for j in range(d):
        wider = np.zeros((len(passes), j + 2))
        wider[:, :-1] += product * leaf.share[j]
        wider[:, 1:] += product * passes[:, [j]]
        product = wider
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    for j in range(d):
        # divide the factor of feature j out again: (share + t) where the row passes, else the constant share
        rest = np.zeros((len(passes), d))
        rest[:, d - 1] = product[:, d]
        for k in range(d - 2, -1, -1):
            rest[:, k] = product[:, k + 1] - leaf.share[j] * rest[:, k + 1]
        rest = np.where(passes[:, [j]], rest, product[:, :d] / leaf.share[j])
        out[:, j] = leaf.value * (passes[:, j] - leaf.share[j]) * (rest @ weight)
    return out


def tree_attributions(df: DataFrame, model, features: str = "features", output: str = "attributions") -> DataFrame:
    """Add an array with one attribution per slot; they sum to the prediction minus the model's baseline.

    Trees are sent as rows of arrays in parts of bounded size; tasks walk them to their leaves, one leaf at a time, on Arrow
    arrays, and the parts' arrays are added.
    """
    spark = df.sparkSession
    x = vector_to_array(features)

    def part_udf(part):
        shared = spark.sparkContext.broadcast(part)

        @F.arrow_udf("array<double>")
        def attribute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            leaves = list(tree_leaves(shared.value)) if sum(len(t["slot"]) for t in shared.value) <= _KEPT_NODES else None
            for batch in batches:
                yield lists(path_attributions(matrix(batch), leaves if leaves is not None else tree_leaves(shared.value)))

        return attribute

    parts = [part_udf(part)(x) for part in model.parts()]
    return df.withColumn(output, reduce(lambda a, b: F.zip_with(a, b, lambda u, v: u + v), parts))


def attribution_table(df: DataFrame, names: Sequence[tuple[str, str]], column: str = "attributions") -> DataFrame:
    """(feature, base, mean_abs, mean): the average size and direction of every slot's attribution over all rows."""
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(b).alias("base")) for n, b in names])
    long = df.select(F.posexplode(column).alias("slot", "phi"))
    return (
        long.groupBy("slot")
        .agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"))
        .withColumn("n", F.element_at(named, F.col("slot") + 1))
        .select("n.feature", "n.base", "mean_abs", "mean")
    )


def permutation_attributions(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    keys: Sequence[str],
    permutations: int = 8,
    seed: int = 42,
) -> DataFrame:
    """(keys..., feature, phi) for any model: sampled-permutation Shapley values of the input columns.

    Every permutation starts from its own background row and replaces one column after another by the row's own value. The
    values of a row sum to its prediction minus the mean prediction of the background rows. Only mixed variants are made
    per row (and one of the row itself); the background is scored once. A row's variants share a 128-bit hash of its
    columns; each carries a fixed coefficient per feature, so a row's variants are summed in their own task before the
    shuffle, which moves one sum per row and feature. Rows equal in all given columns have equal values; each gets its own.
    """
    p, m = len(features), permutations
    own = [k for k in keys if k not in features]
    background = sample_rows(df.select(*features, *own), m, keys, seed).collect()
    draw = np.random.RandomState(seed)
    orders = [draw.permutation(p).tolist() for _ in range(m)]
    place = np.argsort(np.array(orders), axis=1)
    starts = [background[j % len(background)] for j in range(m)] if background else []
    steps = [(j, k) for j in range(m) for k in range(1, p)] + [(-1, p)]
    weights = np.zeros((p, len(steps)), int)
    for at, (j, k) in enumerate(steps):
        for order in [orders[j]] if j >= 0 else orders:
            weights[order[k - 1], at] += 1
            if k < p:
                weights[order[k], at] -= 1
    row = [F.xxhash64(F.lit(i), *[F.col(c) for c in dict.fromkeys((*features, *own))]).alias(f"__row{i}") for i in (0, 1)]
    variants = df.select("*", *row, F.explode(F.sequence(F.lit(1), F.lit(len(steps)))).alias("__at"))
    mixed = {}
    for i, c in enumerate(features):
        kind = df.schema[c].dataType
        # the background row whose value a variant takes, 0 where it takes the row's own
        source = [0 if j < 0 or place[j, i] < k else j + 1 for j, k in steps]
        values = F.array(*[F.lit(s[c]).cast(kind) for s in starts])
        from_row = F.element_at(F.array(*map(F.lit, source)), F.col("__at"))
        mixed[c] = F.when(from_row == 0, F.col(c)).otherwise(F.get(values, from_row - 1))
    kept = variants.withColumns({f"__key_{k}": F.col(k) for k in keys}).withColumns(mixed)
    scored = score(kept)
    first = starts and score(df.sparkSession.createDataFrame([(j, *s) for j, s in enumerate(starts)], _background_schema(df, features, own))).select("__m", "prediction").collect()
    base = np.zeros(p)
    for r in first:
        base[orders[r["__m"]][0]] -= r["prediction"]
    sums = [F.sum(F.col("prediction") * F.element_at(F.array(*map(F.lit, w.tolist())), F.col("__at"))).alias(f"__s{i}") for i, w in enumerate(weights)]
    copies = F.count_if(F.col("__at") == 1)
    by_row = scored.groupBy("__row0", "__row1").agg(*[F.first(f"__key_{k}").alias(k) for k in keys], copies.alias("__n"), *sums)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(f"__s{i}") / F.col("__n") + F.lit(float(base[i]))) / m).alias("phi")) for i, c in enumerate(features)])
    return by_row.select(*keys, F.explode(F.array_repeat(pairs, F.col("__n").cast("int"))).alias("__p")).select(*keys, F.inline("__p"))


def _background_schema(df: DataFrame, features: Sequence[str], own: Sequence[str]) -> StructType:
    return StructType([StructField("__m", IntegerType()), *[df.schema[c] for c in (*features, *own)]])


def permutation_table(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"))
