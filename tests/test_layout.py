"""Fits depend on the rows alone, not on how they are partitioned."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortry.functions.columns import code_text
from cohortry.operators import aggregates as A
from cohortry.operators import clusters as C
from cohortry.operators import evaluation as E
from cohortry.operators import regression as M
from cohortry.operators import tuning as G
from cohortry.operators.features import Prepared
from cohortry.roles import ColumnRoles
from cohortry.session import shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(4000).select(
        "id", (F.rand(1) * 10).alias("x"), F.randn(2).alias("y"), F.concat(F.lit("c"), (F.col("id") % 3)).alias("g"), (F.col("id") % 2).cast("int").alias("cluster")
    )
    made = made.withColumn("label", F.col("x") * 2 + F.sin("y") * 5)
    path = shared_dir(spark, "layout")
    made.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def layouts(rows):
    return [rows.repartition(7, "x"), rows.coalesce(1).orderBy(F.desc("y"))]


def train(df):
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)


@pytest.mark.parametrize(
    "make",
    [
        lambda: M.forest({"n_estimators": 5, "max_depth": 4}),
        lambda: M.boosting({"n_estimators": 4, "max_depth": 3, "subsample": 0.5}),
        lambda: M.histogram_boosting({"n_estimators": 3, "max_depth": 4}),
    ],
)
def test_regressions(layouts, rows, make):
    found = [M.fit_cached(make(), train(df)).transform(train(rows)).select("id", F.round("prediction", 9)).orderBy("id").collect() for df in layouts]
    assert found[0] == found[1]


def test_kmeans_and_drivers(layouts, rows):
    roles = ColumnRoles(("x", "y"), ("g",))
    found = [C.predict_kmeans(C.fit_kmeans(df, roles, 4), rows.drop("cluster"), roles).select("id", "cluster").orderBy("id") for df in (d.drop("cluster") for d in layouts)]
    assert found[0].collect() == found[1].collect()
    drivers = [C.cluster_drivers(df, roles, trees=5, depth=4).withColumn("importance", F.round("importance", 9)).collect() for df in layouts]
    assert drivers[0] == drivers[1]


@pytest.mark.parametrize(("family", "candidates"), [("RandomForest", [{"n_estimators": 3, "max_depth": 3}, {"n_estimators": 6, "max_depth": 3}]), ("LightGBM", [{"n_estimators": 2, "num_leaves": 5}])])
def test_searches(layouts, family, candidates):
    roles = ColumnRoles(("x", "y"), (), "label", ("id",))
    found = []
    for df in layouts:
        made = train(df).select("id", "features", "label")
        _, row = G.search(Prepared(made.filter("id % 5 > 0"), made.filter("id % 5 = 0"), None, roles), family, candidates, 3, "all", "grid")
        found.append((*row[:5], *[round(v, 9) for v in row[5:]]))
    assert found[0] == found[1]


def test_code_text_at_any_size(spark):
    df = spark.createDataFrame([(1.0, "1.0"), (12345678.0, "12345678"), (-3e15, "1.5"), (0.5, "1e3"), (None, None)], "x double, t string")
    got = [tuple(r) for r in df.select(code_text("x"), code_text("t")).collect()]
    assert got == [("1", "1"), ("12345678", "12345678"), ("-3000000000000000", "1.5"), ("0.5", "1000"), (None, None)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0)], "k string, x double")
    assert A.mean_by(df, ["x"], ["k"]).first().x == 2.0
    assert A.sum_by(df, "x", ["k"]).first().x == 4.0
    assert tuple(A.mean_with_interval(df, "x", ["k"]).first())[1:3] == (2, 2.0)
    assert A.mean_and_std(df, ["x"]).first().x_mean == 2.0
    scored = df.withColumnRenamed("x", "label").withColumn("prediction", F.lit(2.0))
    assert tuple(E.regression_metrics(scored).first()) == (2, 1.0, 0.0)


def test_low_cardinality_is_exact(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("fifty"), (F.col("id") % 51).alias("more"), F.col("id").cast("string").alias("all"), F.lit(None).cast("string").alias("none"))
    assert A.low_cardinality(df.repartition(9), df.columns, 50) == ["fifty", "none"]
