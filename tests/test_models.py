"""Feature stages, regression, search and attribution against closed forms and brute force."""

import json
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortry.operators import attribution as T
from cohortry.operators import features as P
from cohortry.operators import kernels as L
from cohortry.operators import regression as M
from cohortry.operators import tuning as G
from cohortry.operators.evaluation import importance_table, regression_metrics
from cohortry.operators.scenarios import unknown_categories, what_if_rows
from cohortry.roles import ColumnRoles

ROLES = ColumnRoles(("a", "b", "s"), ("g",), "y", ("id",))


@pytest.fixture(scope="module")
def data():
    r = np.random.RandomState(5)
    n = 600
    a, b, s = r.randn(n), 5 * r.randn(n), 0.2 * r.randn(n)
    g = r.choice(["u", "v", "w"], n, p=[0.5, 0.3, 0.2])
    y = 2 * a - b + 10 * s + 3 * (g == "u") + np.where(a > 0, b, 0) + 0.1 * r.randn(n)
    return [(i, float(a[i]), float(b[i]), float(s[i]), str(g[i]), float(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, a double, b double, s double, g string, y double").cache()


@pytest.fixture(scope="module")
def prepared(frame):
    return P.prepare_regression(frame, ROLES)


def matrix(df, *extra):
    rows = df.select(vector_to_array("features").alias("x"), *extra).collect()
    return np.array([r.x for r in rows]), [r[1:] for r in rows]


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(4)], "x double, c double")
    model = P.PopulationScaler(inputCols=["x", "c"], outputCols=["xz", "cz"]).fit(df)
    rows = model.transform(df).collect()
    np.testing.assert_allclose([r.xz for r in rows], (np.arange(4) - 1.5) / 1.118033988749895)
    assert {r.cz for r in rows} == {0.0}


def test_imputer(spark):
    df = spark.createDataFrame([(1, "b", 1), (None, None, 2), (4, "a", None), (None, "a", 3), (6, "b", 4)], "n int, t string, m int")
    model = P.MixedImputer(numericCols=["n"], categoricalCols=["t", "m"]).fit(df)
    assert model.fill_values() == {"n": 4.0, "t": "a", "m": 1}
    assert [(r.n, r.t, r.m) for r in model.transform(df).collect()][1:3] == [(4.0, "a", 2), (4.0, "a", 1)]


def test_unknown_and_missing_categories_are_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    model = Pipeline(stages=P.encoding_stages(ColumnRoles(categorical=("t",)))).fit(train)
    score = spark.createDataFrame([("a",), ("c",), (None,)], "t string")
    assert [list(r.features) for r in model.transform(score).collect()] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    assert P.feature_names(model, ColumnRoles(categorical=("t",))) == [("t_a", "t"), ("t_b", "t")]
    assert [tuple(r) for r in unknown_categories(score, model, ["t"]).collect()] == [("t", "c", 1)]


def test_preparation(frame, prepared):
    assert prepared.train.count() + prepared.test.count() == frame.count()
    x, _ = matrix(prepared.train)
    np.testing.assert_allclose(x[:, :3].mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(x[:, :3].std(axis=0), 1, atol=1e-9)
    assert [n for n, _ in P.feature_names(prepared.stages, prepared.roles)] == ["a", "b", "s", "g_u", "g_v", "g_w"]
    narrow = P.prepare_regression(frame, ROLES, max_categories=2)
    assert narrow.roles.categorical == ()
    again = P.prepare_regression(frame.repartition(5), ROLES)
    assert sorted(r.id for r in again.test.collect()) == sorted(r.id for r in prepared.test.collect())


def test_stages_are_stored(frame, prepared, tmp_path):
    prepared.stages.write().overwrite().save(f"{tmp_path}/stages")
    again = PipelineModel.load(f"{tmp_path}/stages").transform(frame).first().features
    assert again == prepared.stages.transform(frame).first().features


def test_dummies(frame):
    wide = P.dummy_columns(frame.withColumn("g", F.when(F.col("id") > 0, F.col("g"))), ["g"], ["id"])
    assert wide.columns == ["id", "g_u", "g_v", "g_w"]
    assert tuple(wide.filter("id = 0").first())[1:] == (0, 0, 0)
    assert len(P.dummy_columns(frame, ["id"]).columns) == frame.select("id").distinct().count()


@pytest.mark.parametrize("alpha", [0.1, 10.0, 500.0])
def test_ridge_closed_form(frame, data, alpha):
    raw = VectorAssembler(inputCols=["a", "b", "s"], outputCol="features").transform(frame).withColumnRenamed("y", "label")
    model = M.Ridge(alpha=alpha).fit(raw)
    x, y = np.array([d[1:4] for d in data]), np.array([d[5] for d in data])
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(model.coefficients.toArray(), w, atol=1e-9)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-9)


def test_parameter_names():
    forest = M.forest({"max_depth": None, "max_features": 0.5, "min_samples_leaf": 3, "min_samples_split": 7, "criterion": "squared_error"})
    assert [forest.get(n) for n in ("numTrees", "maxDepth", "maxFeatures", "minLeaf", "minSplit", "bootstrap")] == [100, 0, "0.5", 3, 7, True]
    assert M.forest(None, "privada").get("numTrees") == 600 and M.forest(None, "privada").get("maxDepth") == 100
    boosted = M.histogram_boosting({"num_leaves": 70, "max_depth": -1, "reg_alpha": 0.1, "reg_lambda": 0.2, "min_child_samples": 50})
    assert [boosted.get(n) for n in ("numLeaves", "maxDepth", "l1", "l2", "minLeaf")] == [70, 0, 0.1, 0.2, 50]
    with pytest.raises(ValueError):
        M.forest({"no_such": 1})


def test_support_vector(prepared):
    x, rows = matrix(prepared.train, "label")
    y = np.array([r[0] for r in rows])
    model = M.support_vector({"kernel": "linear", "C": 1.0, "epsilon": 0.1}, maxIter=40).fit(prepared.train)

    def objective(w, b):
        return 0.5 * w @ w + np.maximum(0, np.abs(x @ w + b - y) - 0.1).sum()

    best = objective(model.weights, model.bias)
    # plain subgradient descent on one machine, many steps
    w, b, low = np.zeros(x.shape[1]), y.mean(), np.inf
    for t in range(20000):
        miss = x @ w + b - y
        g = np.sign(miss) * (np.abs(miss) > 0.1)
        step = 0.003 / np.sqrt(1 + t)
        w, b = w - step * (w + g @ x), b - step * g.sum()
        low = min(low, objective(w, b))
    assert best <= low * 1.005
    rbf = M.support_vector({"kernel": "rbf", "C": 10.0, "epsilon": 0.1}, maxIter=15, smooth=0.01).fit(prepared.train)
    fit = regression_metrics(rbf.transform(prepared.test)).first()
    assert fit.r2 > 0.5
    assert 0 < rbf.kernel_error["mean"] < 0.2 and rbf.kernel_error["mean"] <= rbf.kernel_error["largest"] <= 1


def test_landmark_kernel(spark):
    draw = np.random.RandomState(3)
    x = draw.randn(400, 2)
    data = [(v.tolist(),) for v in np.vstack([x, x[:1].repeat(200, axis=0)])]
    rows = spark.createDataFrame(data, "x array<double>").repartition(5)
    before = np.inf
    for count in (4, 16, 64):
        chosen = L.choose_landmarks(rows, count)
        assert len(chosen) == len(np.unique(chosen, axis=0)) == count
        np.testing.assert_array_equal(chosen, L.choose_landmarks(rows.repartition(2), count))
        lift = L.Landmarks(chosen, 0.5)
        mean, largest = L.kernel_error(rows, lift)
        exact, z = L.rbf(x, x, 0.5), lift(x)
        wrong = np.abs(exact - z @ z.T)
        assert wrong.max() <= largest + 1e-9  # the measured error bounds every entry
        assert mean == pytest.approx(((1 - (z * z).sum(axis=1)).sum() + 200 * (1 - (z[0] ** 2).sum())) / 600, abs=1e-9)
        assert mean < before
        before = mean
        np.testing.assert_allclose(lift(chosen) @ lift(chosen).T, L.rbf(chosen, chosen, 0.5), atol=1e-7)
    np.testing.assert_array_equal(L.choose_landmarks(rows, 400), L._sorted(x))  # all distinct rows, where they are few
    assert L.choose_landmarks(rows.limit(0), 4).size == 0


def test_exact_rbf_fit_on_few_distinct_rows(spark):
    """With a landmark for every distinct row the fit is that of the exact kernel, found here on one machine."""
    draw = np.random.RandomState(8)
    points = draw.randn(12, 2)
    at = draw.randint(12, size=300)
    x, y = points[at], np.sin(2 * points[at, 0]) + points[at, 1] + 0.05 * draw.randn(300)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    model = M.support_vector({"kernel": "rbf", "C": 2.0, "epsilon": 0.1}, maxIter=60, tol=1e-9, landmarks=20).fit(df)
    assert model.kernel_error["largest"] < 1e-9
    width = 1 / (2 * x.var())
    kernel, across = L.rbf(points, points, width), L.rbf(x, points, width)

    def objective(a, b):
        return 0.5 * a @ kernel @ a + 2.0 * np.maximum(0, np.abs(across @ a + b - y) - 0.1).sum()

    predicted = np.array([r.prediction for r in model.transform(spark.createDataFrame([(Vectors.dense(p),) for p in points], ["features"])).collect()])
    mine = objective(np.linalg.solve(kernel, predicted - model.bias), model.bias)
    a, b, low = np.zeros(12), y.mean(), np.inf
    for t in range(60000):  # plain descent in the kernel's own space
        miss = across @ a + b - y
        g = np.sign(miss) * (np.abs(miss) > 0.1)
        step = 0.02 / np.sqrt(1 + t)
        a, b = a - step * (a + 2.0 * np.bincount(at, g, 12)), b - step * 2.0 * g.sum() / 300
        low = min(low, objective(a, b))
    assert mine <= low * 1.005


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    row = regression_metrics(df).first()
    y, p = np.array([1.0, 2, 4]), np.array([1.5, 2, 3])
    assert row.mse == pytest.approx(((y - p) ** 2).mean())
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_grid_search_score_equals_manual_folds(prepared):
    _, table = G.search_groups({"all": prepared}, "Ridge", candidates=[{"alpha": 1.0}, {"alpha": 1e5}], folds=3)
    row = table.first()
    assert json.loads(row.best_params) == {"alpha": 1.0} and row.n_iterations == 2
    from cohortry.operators.rows import with_fold

    x, rows = matrix(with_fold(prepared.train, ["id"], 3), "label", "fold")
    y, fold = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    scores = []
    for f in range(3):
        xt, yt = x[fold != f], y[fold != f]
        xc = xt - xt.mean(axis=0)
        w = np.linalg.lstsq(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (yt - yt.mean()), rcond=None)[0]
        scores.append(((y[fold == f] - (yt.mean() + (x[fold == f] - xt.mean(axis=0)) @ w)) ** 2).mean())
    assert row.best_score == pytest.approx(-np.mean(scores), rel=1e-6)


def test_search_with_encoding_inside_folds(prepared):
    model, row = G.search(prepared, "RandomForest", [{"n_estimators": 3, "max_depth": 3}], 2, "all", "grid", encode_per_fold=True)
    assert row[0] == "RandomForest" and np.isfinite(row[5])


def test_candidates():
    assert len(G.grid_candidates(G.GRIDS["SVR"])) == 12
    assert len(G.grid_candidates(G.GRIDS["RandomForest"])) == 24
    a, b = (G.random_candidates(G.RANGES["SVR"], 5, seed=s) for s in (1, 1))
    assert a == b and all(0.1 <= c["C"] <= 10.1 for c in a)


def tree_value(nodes, x, known):
    """Expected prediction when only the features in ``known`` are given."""
    def walk(i):
        left, right = nodes["left"][i], nodes["right"][i]
        if left < 0:
            return nodes["value"][i]
        if nodes["slot"][i] in known:
            return walk(left if x[nodes["slot"][i]] <= nodes["threshold"][i] else right)
        return (nodes["n"][left] * walk(left) + nodes["n"][right] * walk(right)) / nodes["n"][i]

    return walk(0)


@pytest.mark.parametrize("family, params", [("RandomForest", {"n_estimators": 3, "max_depth": 4}), ("GradientBoosting", {"n_estimators": 3, "max_depth": 3})])
def test_tree_attributions(spark, prepared, family, params):
    model = M.make_regressor(family, params).fit(prepared.train)
    scored = T.tree_attributions(model.transform(prepared.test), model)
    x, rows = matrix(scored, "prediction", "attributions")
    base = T.model_baseline(model)
    phi = np.array([r[1] for r in rows])
    np.testing.assert_allclose(phi.sum(axis=1), [r[0] - base for r in rows], atol=1e-9)
    trees = [t for part in model.parts() for t in part]
    weights = [t["weight"] for t in trees]
    p = x.shape[1]
    for row in range(3):
        want = np.zeros(p)
        for order in permutations(range(p)):
            known = set()
            before = sum(w * tree_value(t, x[row], known) for w, t in zip(weights, trees))
            for f in order:
                known.add(f)
                after = sum(w * tree_value(t, x[row], known) for w, t in zip(weights, trees))
                want[f] += after - before
                before = after
        np.testing.assert_allclose(phi[row], want / factorial(p), atol=1e-9)
    table = T.attribution_table(scored, P.feature_names(prepared.stages, prepared.roles)).collect()
    assert {r.base for r in table} == {"a", "b", "s", "g"}
    importance = importance_table(spark, model, P.feature_names(prepared.stages, prepared.roles), "all")
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_permutation_attributions_add_up(frame):
    score = lambda d: d.withColumn("prediction", F.col("a") * F.col("b") + F.when(F.col("g") == "u", 3.0).otherwise(0.0))
    phi = T.permutation_attributions(frame, score, ["a", "b", "g"], ["id"], permutations=6)
    from cohortry.operators.rows import sample_rows

    base = score(sample_rows(frame, 6, ["id"])).agg(F.avg("prediction")).first()[0]
    sums = phi.groupBy("id").agg(F.sum("phi").alias("total")).join(score(frame), "id")
    assert sums.count() == 600
    assert sums.agg(F.max(F.abs(F.col("total") - (F.col("prediction") - base)))).first()[0] < 1e-9


def test_what_if_rows(frame):
    out = what_if_rows(frame, {"Base": {}, "A": {"a": 9.0}, "G": {"g": "w"}})
    assert out.count() == 3 * frame.count()
    assert out.filter("cenario = 'A'").select("a").distinct().collect()[0].a == 9.0
    assert out.filter("cenario = 'Base'").select("a").distinct().count() == 600


def test_prepared_rows_are_read_from_one_written_copy(frame):
    joined = frame.join(frame.select("id", F.lit(1).alias("one")), "id")
    made = P.prepare_regression(joined, ROLES)
    for part in (made.train, made.test):
        assert "Join" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_is_dealt_to_its_part_once(spark):
    from cohortry.operators.rows import train_test_split

    rows = spark.range(500).select("id", (F.col("id") % 7).alias("x"), F.lit("a").alias("c"), (F.col("id") * 1.0).alias("y"))
    made = P.prepare_regression(rows, ColumnRoles(("x",), ("c",), "y", ("id",)))
    assert [sorted(r.id for r in d.collect()) for d in (made.train, made.test)] == [sorted(r.id for r in d.collect()) for d in train_test_split(rows, ["id"])]
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (made.train, made.test)]
    assert not any("md5" in p for p in plans) and "__test" not in made.train.columns


def test_equal_ways_through_a_tree_are_worked_out_once(monkeypatch):
    tree = {"slot": [0, 1, -1, -1, -1], "threshold": [5.0, 0.5, None, None, None], "left": [1, 2, -1, -1, -1], "right": [4, 3, -1, -1, -1], "n": [10.0, 6.0, 2.0, 4.0, 4.0], "value": [0.0, 0.0, 1.0, 3.0, 9.0]}
    part = [{"weight": 0.5} | {k: np.array([np.nan if v is None else v for v in c]) for k, c in tree.items()}]
    x = np.random.RandomState(0).rand(300, 3) * [10, 1, 1]
    done, plain = [], T._leaf_attributions
    monkeypatch.setattr(T, "_leaf_attributions", lambda passes, leaf: done.append(len(passes)) or plain(passes, leaf))
    whole = T.path_attributions(x, list(T.tree_leaves(part)))
    assert max(done) == 4
    np.testing.assert_array_equal(whole, np.concatenate([T.path_attributions(x[i : i + 2], list(T.tree_leaves(part))) for i in range(0, 300, 2)]))
    below, small = x[:, 0] <= 5, x[:, 1] <= 0.5
    value = np.where(below, np.where(small, 1.0, 3.0), 9.0) * 0.5
    np.testing.assert_allclose(whole.sum(axis=1) + T.baseline(list(T.tree_leaves(part))), value)


def test_trees_score_arrow_arrays():
    import pyarrow as pa

    from cohortry.operators.ensembles import lists, matrix, tree_values

    x = pa.array([[1.0, 2.0], [3.0, float("nan")], [9.0, 0.0]])
    assert matrix(x).shape == (3, 2) and len(matrix(x[:0])) == 0 and matrix(x[1:])[1, 0] == 9.0
    assert lists(np.array([[1.0, 2.0], [3.0, 4.0]])).to_pylist() == [[1.0, 2.0], [3.0, 4.0]]
    tree = {"slot": np.array([1, -1, 0, -1, -1]), "threshold": np.array([1.0, np.nan, 3.0, np.nan, np.nan]), "left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]), "value": np.arange(10.0)}
    assert tree_values(matrix(x), tree, 2).tolist() == [[6.0, 7.0], [6.0, 7.0], [2.0, 3.0]]


def test_sweep_query_runs_all_restarts_to_the_end(monkeypatch):
    from cohortry.catalog import QUERIES, models

    seen = {}
    monkeypatch.setattr(models, "_prepared", lambda spark, sf: None)
    monkeypatch.setattr(models.K, "k_sweep", lambda rows, estimator, ks: seen.update(ks=list(ks), restarts=estimator.getOrDefault(estimator.nInit), steps=estimator.getOrDefault(estimator.maxIter)) or [None])
    QUERIES["c05_k_sweep"](None, None)
    assert seen == {"ks": list(range(2, 16)), "restarts": 10, "steps": 100}
