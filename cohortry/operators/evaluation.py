"""Model metrics, importance tables, and descriptive impact tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import base_feature_name, binary_label, difference, display_name, number, status_closed_right
from cohortry.operators.aggregates import count_by, mean_order, sum_by
from cohortry.operators.hypothesis import long_categories
from cohortry.operators.order_stats import medians, quantile_bins
from cohortry.operators.reshape import stack, top_rows


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mse, r2) in one pass; r2 is null when the label does not vary."""
    miss = number(F.col(label) - F.col(prediction))
    mse = F.avg(miss * miss)
    return scored.groupBy(*by).agg(F.count(miss).alias("n"), mse.alias("mse"), (1 - F.try_divide(mse, F.var_pop(F.when(miss.isNotNull(), number(label))))).alias("r2"))


def metrics_report(scored: Mapping[str, DataFrame]) -> DataFrame:
    """One row per group: instituicao, MSE, R2."""
    parts = [
        regression_metrics(df).select(F.lit(group).alias("instituicao"), F.col("mse").alias("MSE"), F.col("r2").alias("R2"))
        for group, df in scored.items()
    ]
    return stack(parts)


def importance_table(spark, model, names: Sequence[tuple[str, str]], group: str) -> DataFrame:
    """(instituicao, feature, base, importance) of a fitted tree ensemble; importances sum to 1."""
    weights = model.featureImportances.toArray()
    rows = [(group, name, base, float(w)) for (name, base), w in zip(names, weights)]
    return spark.createDataFrame(rows, "instituicao string, feature string, base string, importance double")


def top_importance(table: DataFrame, n: int = 20) -> DataFrame:
    return top_rows(table, "importance", n, ["feature"])


def compare_importance(tables: Sequence[DataFrame]) -> DataFrame:
    """Groups stacked under display names, with each feature's mean importance as its order."""
    shown = stack(tables).withColumn("feature", display_name("feature"))
    return mean_order(shown, "feature", "importance", "mean_importance").orderBy(
        "instituicao", F.col("mean_importance").desc(), "feature"
    )


def aggregate_importance(table: DataFrame, plain: Sequence[str] | None = None) -> DataFrame:
    """Importance summed over the encoded names of a feature.

    Uses the carried ``base`` column; with ``plain`` the base is recovered from the name instead.
    """
    base = F.col("base") if plain is None else base_feature_name("feature", plain)
    return sum_by(table.select("instituicao", base.alias("feature"), "importance"), "importance", ["instituicao", "feature"])


def duration_comparison(
    df: DataFrame, actual: str, ideal: str, code: str, members: Sequence, yes: str = "Pública", no: str = "Privada", group: str = "tipo_ies"
) -> DataFrame:
    """Rows with the difference of durations, its status, and the binary group."""
    diff = difference(actual, ideal)
    return df.withColumns(
        {"diferenca_permanencia": diff, "status_conclusao": status_closed_right(diff), group: binary_label(code, members, yes, no)}
    )


def status_counts(df: DataFrame, status: str = "status_conclusao", group: str | None = None) -> DataFrame:
    return count_by(df, [status] if group is None else [status, group])


def category_means(df: DataFrame, features: Sequence[str], value: str, side: str) -> DataFrame:
    """(side, feature, category, n, mean) for every category of every feature in one pass."""
    long = long_categories(df, features, [side, value]).filter(F.col(side).isNotNull())
    return long.groupBy(side, "feature", "category").agg(F.count(number(value)).alias("n"), F.avg(number(value)).alias("mean"))


def bin_means(df: DataFrame, features: Sequence[str], value: str, side: str, bins: int = 10) -> DataFrame:
    """(feature, bin, side, mean, bin_median): the value's mean along equal-frequency bins of every feature."""
    kept = df.select(*features, F.col(side), F.col(value).alias("__y"))
    binned = quantile_bins(kept, features, [side, "__y"], bins).select(
        F.col("feature").alias("__feature"), "bin", F.col("value").alias("x"), side, "__y"
    )
    means = binned.filter(F.col(side).isNotNull()).groupBy("__feature", "bin", side).agg(F.avg("__y").alias("mean"))
    labels = medians(binned, ["x"], ["__feature", "bin"]).withColumnRenamed("x", "bin_median")
    return means.join(labels, ["__feature", "bin"]).withColumnRenamed("__feature", "feature")
