"""Two-sample tests per group, computed from counts per distinct value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import code_text, null_if_nan, significance_flag
from cohortry.functions.pvalues import mann_whitney_p, student_p
from cohortry.operators.aggregates import keyed
from cohortry.operators.order_stats import with_counts_below


def _sided(df: DataFrame, value: str, side: str, sides: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    base = df.select(*keys, null_if_nan(F.col(value).cast("double")).alias("__value"), F.col(side).alias("__side"))
    return keyed(base, keys).filter(F.col("__value").isNotNull() & F.col("__side").isin(*sides))


def rank_statistics(df: DataFrame, value: str, side: str, sides: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n1, n2, mean1, mean2, u1, z, ties): the Mann-Whitney statistics of the two sides in every group.

    z carries the tie-corrected deviation and the continuity correction; it is null when all values are equal.
    """
    keys = list(by) or ["__all"]
    base = df if by else df.withColumn("__all", F.lit(0))
    counts = (
        _sided(base, value, side, sides, keys)
        .groupBy(*keys, "__value")
        .agg(F.count_if(F.col("__side") == sides[0]).alias("__c1"), F.count_if(F.col("__side") == sides[1]).alias("__c2"))
        .withColumn("__tied", F.col("__c1") + F.col("__c2"))
    )
    t = F.col("__tied").cast("double")
    sums = (
        with_counts_below(counts, keys, "__value", "__tied")
        .groupBy(*keys)
        .agg(
            F.sum("__c1").alias("n1"),
            F.sum("__c2").alias("n2"),
            F.sum(F.col("__c1") * (F.col("below") + (F.col("__tied") + 1) / 2)).alias("r1"),
            F.sum(t * t * t - t).alias("tie_term"),
            *[F.try_divide(F.sum(F.col(f"__c{i}") * F.col("__value")), F.sum(f"__c{i}")).alias(f"mean{i}") for i in (1, 2)],
        )
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1)))
    centre = n1 * n2 / 2
    z = F.try_divide(F.greatest(F.col("u1"), n1 * n2 - F.col("u1")) - centre - 0.5, F.sqrt(variance))
    out = sums.withColumn("u1", u1).withColumn("z", F.when((n1 > 0) & (n2 > 0), z))
    return out.select(*by, "n1", "n2", "mean1", "mean2", "u1", "z", (F.col("tie_term") > 0).alias("ties"))


def mann_whitney(df: DataFrame, value: str, side: str, sides: tuple[str, str], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Two-sided test: (by..., n1, n2, mean1, mean2, u1, z, p_value, significance); p is null with fewer than 2 rows on a side."""
    stats = rank_statistics(df, value, side, sides, by)
    p = null_if_nan(mann_whitney_p("u1", "n1", "n2", "z", "ties"))
    return stats.withColumn("p_value", p).withColumn("significance", significance_flag("p_value", alpha)).drop("ties")


def welch_statistics(df: DataFrame, value: str, side: str, sides: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n1, n2, mean1, mean2, t, dof) of the unequal-variance t test."""
    base = _sided(df, value, side, sides, by)
    aggs = []
    for i, s in enumerate(sides, 1):
        v = F.when(F.col("__side") == s, F.col("__value"))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_samp(v).alias(f"var{i}")]
    s1 = F.try_divide(F.col("var1"), F.col("n1"))
    s2 = F.try_divide(F.col("var2"), F.col("n2"))
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2))
    dof = F.try_divide(
        (s1 + s2) * (s1 + s2), F.try_divide(s1 * s1, F.col("n1") - 1) + F.try_divide(s2 * s2, F.col("n2") - 1)
    )
    return base.groupBy(*by).agg(*aggs).select(*by, "n1", "n2", "mean1", "mean2", t.alias("t"), dof.alias("dof"))


def welch(df: DataFrame, value: str, side: str, sides: tuple[str, str], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    stats = welch_statistics(df, value, side, sides, by)
    p = null_if_nan(student_p("t", "dof"))
    return stats.withColumn("p_value", p).withColumn("significance", significance_flag("p_value", alpha))


def long_categories(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, category) with one canonical text per category."""
    wide = df.select(*keep, *[code_text(f).alias(f) for f in features])
    return wide.unpivot(list(keep), list(features), "feature", "category").filter(F.col("category").isNotNull())


def category_tests(
    df: DataFrame, features: Sequence[str], value: str, side: str, sides: tuple[str, str], alpha: float = 0.05
) -> DataFrame:
    """The rank test for every category of every feature in one grouped pass."""
    long = long_categories(df, features, [value, side])
    return mann_whitney(long, value, side, sides, ["feature", "category"], alpha)


def comparison_report(tests: DataFrame) -> DataFrame:
    """The published column names of the comparison table."""
    return tests.select(
        F.col("feature").alias("Feature"),
        F.col("category").alias("Categoria"),
        F.col("p_value").alias("P-Valor"),
        F.col("significance").alias("Significancia"),
        F.col("n1").alias("N_Publica"),
        F.col("n2").alias("N_Privada"),
    )
