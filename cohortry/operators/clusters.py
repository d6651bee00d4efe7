"""What clusters look like: sizes, profiles, relative importance, drivers, rules, projection; k-means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cohortry.functions.columns import code_text, number
from cohortry.operators.aggregates import count_by, keyed, mean_by, modes
from cohortry.operators.features import PopulationScaler, PopulationScalerModel, encoding_stages, feature_names, helper_columns
from cohortry.operators.hypothesis import long_categories
from cohortry.operators.ensembles import ClassForest
from cohortry.operators.kmeans import MiniBatchKMeans
from cohortry.operators.trees import tree_paths
from cohortry.roles import ColumnRoles


def fit_kmeans(
    df: DataFrame, roles: ColumnRoles, k: int, seed: int = 42, max_iter: int = 100, label: str = "cluster", batches: int = 10, **options
) -> PipelineModel:
    """Scaling, encoding and mini-batch k-means in one pipeline, so scoring cannot use a different preparation."""
    kmeans = MiniBatchKMeans(k=k, seed=seed, maxIter=max_iter, batches=batches, featuresCol="kmeans_features", predictionCol=label, **options)
    return Pipeline(stages=[*encoding_stages(roles, "kmeans_features"), kmeans]).fit(df)


def predict_kmeans(model: PipelineModel, df: DataFrame, roles: ColumnRoles) -> DataFrame:
    return model.transform(df).drop("kmeans_features", *helper_columns(roles))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return count_by(df, [cluster]).orderBy(cluster)


def numeric_profile(df: DataFrame, numeric: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return mean_by(df, numeric, [cluster])


def categorical_profile(df: DataFrame, categorical: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return modes(df, categorical, [cluster])


def _z(mean, overall, std):
    return F.coalesce((mean - overall) / (std + F.lit(1e-9)), F.lit(0.0))


def numeric_importance(df: DataFrame, numeric: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, feature, value = null, z): how far a cluster's mean lies from the overall mean, in sample deviations."""
    stats = F.struct(*[F.struct(F.avg(number(c)).alias("m"), F.stddev_samp(number(c)).alias("s")).alias(c) for c in numeric])
    overall = df.agg(stats.alias("o")).scalar()
    means = mean_by(df, numeric, [cluster]).withColumn("o", overall)
    z = means.select(cluster, *[_z(F.col(c), F.col("o")[c]["m"], F.col("o")[c]["s"]).alias(c) for c in numeric])
    return z.unpivot([cluster], list(numeric), "feature", "z").select(cluster, "feature", F.lit(None).cast("string").alias("value"), "z")


def category_importance(df: DataFrame, categorical: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, feature, value, z) for every category as if it were a 0/1 column.

    Only counts are needed: such a column has mean p and sample deviation sqrt(p (1-p) n / (n-1)). Values absent from
    a cluster have share 0 there.
    """
    sizes = count_by(df, [cluster], "size")
    clusters = sizes.agg(F.collect_list(F.struct(F.col(cluster), F.col("size")))).scalar()
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = long_categories(df, categorical, [cluster]).groupBy(cluster, "feature", "category").agg(F.count(F.lit(1)).alias("n"))
    values = counts.groupBy("feature", "category").agg(F.sum("n").alias("n_value")).withColumn("__k", clusters)
    grid = values.select("feature", "category", "n_value", F.inline("__k"))
    n = total.cast("double")
    p = F.col("n_value") / n
    std = F.sqrt(p * (1 - p) * F.try_divide(n, n - 1))
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("size")
    joined = grid.join(keyed(counts, [cluster]), [cluster, "feature", "category"], "left")
    return joined.select(cluster, "feature", F.col("category").alias("value"), _z(share, p, std).alias("z"))


def relative_importance(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cluster: str = "cluster") -> DataFrame:
    parts = []
    if numeric:
        parts.append(numeric_importance(df, numeric, cluster))
    if categorical:
        parts.append(category_importance(df, categorical, cluster))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def aggregated_importance(importance: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, feature, score): numbers keep their z, a category column scores the mean of |z| over its values."""
    return importance.groupBy(cluster, "feature").agg(
        F.when(F.max("value").isNull(), F.max("z")).otherwise(F.avg(F.abs("z"))).alias("score")
    )


def wide_importance(importance: DataFrame, names: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """One column per feature or ``feature_value`` of a long table; ``names`` fixes the columns."""
    name = F.when(F.col("value").isNull(), F.col("feature")).otherwise(F.concat_ws("_", "feature", "value"))
    return importance.withColumn("__name", name).groupBy(cluster).pivot("__name", list(names)).agg(F.first("z"))


def _encoded(df: DataFrame, roles: ColumnRoles, cluster: str):
    stages = Pipeline(stages=encoding_stages(roles)).fit(df)
    ready = stages.transform(df).drop(*helper_columns(roles)).withColumn("label", F.col(cluster).cast("double"))
    return ready.filter(F.col("label").isNotNull()), feature_names(stages, roles)


def cluster_drivers(df: DataFrame, roles: ColumnRoles, cluster: str = "cluster", trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """(feature, base, importance) of a forest that predicts the cluster, encoded categories included."""
    ready, names = _encoded(df, roles, cluster)
    forest = ClassForest(numTrees=trees, maxDepth=depth, seed=seed).fit(ready)
    weights = forest.featureImportances.toArray()
    rows = [(name, base, float(w)) for (name, base), w in zip(names, weights)]
    out = df.sparkSession.createDataFrame(rows, "feature string, base string, importance double")
    return out.orderBy(F.col("importance").desc(), "feature")


def cluster_rules(df: DataFrame, roles: ColumnRoles, cluster: str = "cluster", depth: int = 3, seed: int = 42) -> DataFrame:
    """(leaf, rule, cluster, n_rows, purity): the leaves of a shallow tree as conjunctions over encoded features."""
    ready, names = _encoded(df, roles, cluster)
    tree = ClassForest(numTrees=1, maxDepth=depth, seed=seed, bootstrap=False, maxFeatures="all").fit(ready)
    return tree_paths(tree, [name for name, _ in names])


def _moments(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(f, u, g, v, s): sums of products of two features, numbers as they are and categories as 0/1 flags, f before g or f = g.

    ``u`` and ``v`` are categories (null for numbers). Pairs of categories are counted, not multiplied out. One scan: rows
    first become one row per combination of categories, inside the tasks as far as it goes.
    """
    n, sums = F.count(F.lit(1)).alias("n"), [F.sum(c).alias(f"s{i}") for i, c in enumerate(numeric)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(numeric) for j, b in enumerate(numeric) if i <= j]
    combined = df.groupBy(*categorical).agg(n, *sums, *products)
    none = F.lit(None).cast("string")
    m = len(numeric)

    def entry(f, u, g, v, value):
        return F.struct(F.lit(f).alias("f"), u.alias("u"), F.lit(g).alias("g"), v.alias("v"), value.cast("double").alias("s"))

    entries = [entry(-1, none, -1, none, F.col("n"))]
    entries += [entry(i, none, j, none, F.col(f"p{i}_{j}")) for i in range(m) for j in range(i, m)]
    for k, c in enumerate(categorical):
        entries += [entry(i, none, m + k, F.col(c), F.col(f"s{i}")) for i in range(m)]
        entries += [entry(m + k, F.col(c), m + l, F.col(d), F.col("n")) for l, d in enumerate(categorical) if l >= k]
    missing = (F.col("f") >= m) & F.col("u").isNull() | (F.col("g") >= m) & F.col("v").isNull()
    return combined.select(F.inline(F.array(*entries))).filter(~missing).groupBy("f", "u", "g", "v").agg(F.sum("s").alias("s"))


def mixed_axes(df: DataFrame, roles: ColumnRoles) -> tuple[PopulationScalerModel | None, list[tuple[int, str | None]], np.ndarray, np.ndarray, np.ndarray]:
    """(scaler, slots, scale, variances, axes) of the principal components of scaled numbers and weighted category flags.

    A slot is a number's index, or a categorical column's index after the numbers and one of its categories. A flag counts
    1/sqrt(share), less its mean. ``axes`` has a column per component, largest variance first, the largest loading positive.
    The driver holds one number per pair of slots, so categories are meant to be some thousands at most.
    """
    numeric, categorical = list(roles.numeric), list(roles.categorical)
    scaler = PopulationScaler(inputCols=numeric, outputCols=[f"{c}__z" for c in numeric]).fit(df) if numeric else None
    texts = [code_text(c).alias(c) for c in categorical]
    scaled = scaler.transform(df) if scaler else df
    rows = scaled.select(*[F.coalesce(f"{c}__z", F.lit(0.0)).alias(f"{c}__z") for c in numeric], *texts)
    found = _moments(rows, [f"{c}__z" for c in numeric], categorical).collect()
    m, total = len(numeric), next((r["s"] for r in found if r["f"] == -1), None) or 0.0
    flags = {(r["f"], r["u"]): r["s"] for r in found if r["f"] >= m and r["f"] == r["g"] and r["u"] == r["v"]}
    slots = [(i, None) for i in range(m)] + sorted(flags)
    at = {slot: i for i, slot in enumerate(slots)}
    share = np.array([0.0] * m + [flags[s] / total for s in slots[m:]])
    scale = np.array([1.0] * m + [p**-0.5 for p in share[m:]])
    spread = np.zeros((len(slots), len(slots)))
    for r in found:
        if r["f"] >= 0:
            i, j = at[r["f"], r["u"]], at[r["g"], r["v"]]
            spread[i, j] = spread[j, i] = r["s"] / total
    spread = (spread - np.outer(share, share)) * np.outer(scale, scale)
    values, axes = np.linalg.eigh(spread)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    if len(slots):
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(slots))] < 0, -1.0, 1.0)
    return scaler, slots, scale, values, axes


def mixed_projection(df: DataFrame, roles: ColumnRoles, k: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., component array): principal components of scaled numbers and category flags weighted by 1/sqrt(share).

    Category flags are centred, so an average row projects to zero; a missing number counts as the mean, a missing category has
    no flag. Rows are never widened to their flags: means and products come from counts of category pairs, and a row's
    component is the sum of its numbers' loadings and one looked-up value per categorical column.
    """
    numeric, categorical = list(roles.numeric), list(roles.categorical)
    scaler, slots, scale, _, axes = mixed_axes(df, roles)
    k, m = min(k, len(slots)), len(numeric)
    loads = axes[:, :k] * scale[:, None]
    rows = scaler.transform(df) if scaler else df
    rows = rows.select(*keep, *[F.col(f"{c}__z").alias(f"__z{i}") for i, c in enumerate(numeric)], *[code_text(c).alias(f"__t{i}") for i, c in enumerate(categorical)])
    # flags are centred: every row loses the mean of a column's looked-up values, which is the sum of sqrt(share) * axis
    centre = (loads[m:] / scale[m:, None] ** 2).sum(axis=0) if len(slots) > m else np.zeros(k)
    looked = [{s[1]: loads[j] for j, s in enumerate(slots) if s[0] == m + i} for i in range(len(categorical))]
    names = rows.columns[: len(rows.columns) - m - len(categorical)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.tile(-centre, (batch.num_rows, 1))
            for i in range(m):
                out += batch.column(f"__z{i}").fill_null(0.0).to_numpy(zero_copy_only=False)[:, None] * loads[i]
            for i, own in enumerate(looked):
                codes = batch.column(f"__t{i}").dictionary_encode(null_encoding="encode")
                values = np.array([own.get(v, np.zeros(k)) for v in codes.dictionary.to_pylist()]).reshape(-1, k)
                out += values[codes.indices.to_numpy()]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*names, "components"])

    return rows.mapInArrow(projected, StructType([*rows.schema.fields[: len(names)], StructField("components", ArrayType(DoubleType()))]))
