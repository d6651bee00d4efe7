"""Order statistics and tests against NumPy and enumeration, with skew, ties, missing values and repartitioning."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.pvalues import exact_tail, rank_test_p, student_two_sided
from cohortry.operators import hypothesis as H
from cohortry.operators import order_stats as O


def skewed(spark, n=4000, seed=1):
    """A third of the rows share one key, and in it most values are one value."""
    r = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        x = 5.0 if hot and r.rand() < 0.8 else float(np.round(r.lognormal(0, 2), 3))
        rows.append(("hot" if hot else f"k{r.randint(20)}", x if r.rand() > 0.02 else None, "a" if r.rand() < 0.4 else "b"))
    return rows, spark.createDataFrame(rows, "k string, x double, side string")


def test_quantiles_equal_numpy(spark, monkeypatch):
    rows, df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile([x for _, x, _ in rows if x is not None], probs)
    for parts in (1, 9):
        got = O.quantiles(df.repartition(parts), ["x"], probs).first()
        np.testing.assert_allclose(got.q, want, rtol=1e-12)
    for bound in (O._BROADCAST_BYTES, 0):
        monkeypatch.setattr(O, "_BROADCAST_BYTES", bound)
        by_key = {r.k: r.q for r in O.quantiles(df, ["x"], probs, ["k"]).collect()}
        for k in {k for k, _, _ in rows}:
            np.testing.assert_allclose(by_key[k], np.quantile([x for kk, x, _ in rows if kk == k and x is not None], probs), rtol=1e-12)


def test_quantiles_with_many_distinct_values(spark):
    r = np.random.RandomState(3)
    x = np.concatenate([r.standard_cauchy(100_000), np.full(50_000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    probs = [i / 10 for i in range(11)]
    np.testing.assert_allclose(O.quantiles(df, ["x"], probs).first().q, np.quantile(x, probs), rtol=1e-12)


def test_missed_brackets_are_counted_again(spark, monkeypatch):
    """Brackets that are far too narrow give the same quantiles by a second count."""
    monkeypatch.setattr(O, "_MARGINS", (0.0,))
    monkeypatch.setattr(O, "_SKETCH", 20)
    x = np.random.RandomState(5).standard_normal(5000)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)], "k int, x double")
    for r in O.quantiles(df, ["x"], [0.1, 0.5, 0.9], ["k"]).collect():
        np.testing.assert_allclose(r.q, np.quantile(x[r.k :: 3], [0.1, 0.5, 0.9]), rtol=1e-12)


def test_medians_of_many_groups(spark):
    df = spark.range(300_000).selectExpr("id % 100000 AS k", "CAST(id AS double) AS x")
    wrong = O.medians(df, ["x"], ["k"]).filter("x <> k + 100000")
    assert wrong.isEmpty()


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "x double, y double")
    row = O.medians(df, ["x", "y"]).first()
    assert (row.x, row.y) == (None, 2.0)
    assert O.quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_median_of_nan_column(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert O.medians(df, ["x"]).first().x == 2.0


def qcut(x, bins):
    edges = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    return np.maximum(np.searchsorted(edges, x, side="left") - 1, 0) if len(edges) > 1 else None


def test_bins_with_duplicate_edges(spark):
    x = np.array([0.0] * 90 + list(range(1, 11)), dtype=float)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "x double, constant double")
    got = O.quantile_bins(df, ["x", "constant"]).collect()
    assert {r.feature for r in got} == {"x"}  # a constant column cannot be cut
    counts = np.bincount([r.bin for r in got])
    np.testing.assert_array_equal(counts, np.bincount(qcut(x, 10)))
    assert (counts > 0).all()


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, None)], "x double")
    assert sorted((r.x, r.avg_rank) for r in O.average_ranks(df, "x").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5)]


def test_exact_tail_equals_enumeration():
    for m, n in [(2, 3), (3, 7), (5, 6), (8, 8)]:
        sums = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)]
        for u in range(m * n // 2 + 1):
            assert exact_tail(u, m, n) == pytest.approx(np.mean(np.array(sums) <= u), abs=1e-13)


def test_student_tail():
    # reference points of the t distribution, and the normal limit
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert student_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-9)
    assert student_two_sided(1.959963985, 1e9) == pytest.approx(0.05, abs=1e-7)
    assert student_two_sided(0.0, 5) == 1.0


def mann_whitney(a, b):
    """u1, z by direct comparison."""
    a, b = np.array(a), np.array(b)
    u1 = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
    n1, n2 = len(a), len(b)
    _, t = np.unique(np.concatenate([a, b]), return_counts=True)
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    return u1, (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sd


def test_rank_test_per_group(spark):
    rows, df = skewed(spark)
    for parts in (1, 9):
        for r in H.mann_whitney(df.repartition(parts), "x", "side", ("a", "b"), ["k"]).collect():
            side = lambda s: [x for k, x, t in rows if k == r.k and t == s and x is not None]  # noqa: B023, E731
            u1, z = mann_whitney(side("a"), side("b"))
            assert (r.n1, r.n2, r.u1) == (len(side("a")), len(side("b")), u1)
            assert r.z == pytest.approx(z, rel=1e-9)
            assert r.p_value == pytest.approx(min(1, math.erfc(z / math.sqrt(2))), rel=1e-9)
            assert r.significance == ("SIGNIFICATIVO" if r.p_value < 0.05 else "Não sig.")


@pytest.mark.parametrize(
    "first, second, p, flag",
    [
        ([1, 2, 3], [4, 5, 6], 0.1, "Não sig."),
        ([1, 2, 3, 4], [5, 6, 7, 8, 9], 2 / 126, "SIGNIFICATIVO"),
        ([1], [4, 5, 6], None, "Não sig."),
        ([2, 2, 2], [2, 2], 1.0, "Não sig."),
        ([2, 2, 2], [], None, "Não sig."),
    ],
)
def test_small_samples(spark, first, second, p, flag):
    df = spark.createDataFrame([(float(x), "a") for x in first] + [(float(x), "b") for x in second], "x double, s string")
    row = H.mann_whitney(df, "x", "s", ("a", "b")).first()
    assert row.p_value == (None if p is None else pytest.approx(p, abs=1e-12)) and row.significance == flag


def test_categories_in_one_pass_equal_single_tests(spark):
    _, df = skewed(spark, 1500)
    df = df.withColumn("code", (F.length("k") * 1.0))
    together = {(r.feature, r.category): r.z for r in H.category_tests(df, ["k", "code"], "x", "side", ("a", "b")).collect()}
    assert ("code", "3") in together  # 3.0 is category "3"
    alone = H.mann_whitney(df.filter("k = 'hot'"), "x", "side", ("a", "b")).first()
    assert together[("k", "hot")] == pytest.approx(alone.z)


def test_welch(spark):
    rows, df = skewed(spark)
    a, b = (np.array([x for _, x, t in rows if t == s and x is not None]) for s in "ab")
    row = H.welch(df, "x", "side", ("a", "b")).first()
    s1, s2 = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert row.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(s1 + s2))
    assert row.dof == pytest.approx((s1 + s2) ** 2 / (s1**2 / (len(a) - 1) + s2**2 / (len(b) - 1)))
    assert rank_test_p(0.0, 1, 5, 1.0, False) != rank_test_p(0.0, 1, 5, 1.0, False)  # NaN
