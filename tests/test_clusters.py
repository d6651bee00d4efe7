"""k-prototypes against brute force, invariants, and cluster reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import clusters as C
from cohortry.operators.kprototypes import KPrototypes, KPrototypesModel, cao_seeds, coded, elbow_table, step
from cohortry.roles import ColumnRoles

NUM, CAT = ["x", "y"], ["c", "d"]


@pytest.fixture(scope="module")
def rows():
    r = np.random.RandomState(0)
    out = []
    for i in range(240):
        g = 0 if i % 3 == 0 else r.randint(1, 3)
        out.append((float(r.randn() * 0.5 + 4 * g), float(r.randn() * 0.5 - 4 * g), "abc"[g] if r.rand() > 0.1 else "a", "pq"[r.randint(2)]))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, c string, d string").cache()


def distances(rows, prototypes, gamma):
    return np.array(
        [[sum((a - b) ** 2 for a, b in zip(r[:2], num)) + gamma * sum(a != b for a, b in zip(r[2:], cat)) for num, cat in prototypes] for r in rows]
    )


def test_fit_is_a_fixed_point(frame, rows):
    model = KPrototypes(numericCols=NUM, categoricalCols=CAT, k=3, nInit=3).fit(frame)
    d = distances(rows, model.prototypes, model.gamma)
    assert model.cost == pytest.approx(d.min(axis=1).sum())
    assert all(b <= a + 1e-6 for a, b in zip(model.history, model.history[1:]))
    label = d.argmin(axis=1)
    for j, (num, cat) in enumerate(model.prototypes):
        mine = [r for r, l in zip(rows, label) if l == j]
        np.testing.assert_allclose(np.mean([r[:2] for r in mine], axis=0), num, atol=1e-6)
        for pos, v in enumerate(cat, 2):
            values, n = np.unique([r[pos] for r in mine], return_counts=True)
            assert v == values[n.argmax()]
    got = model.transform(frame).select(*NUM, *CAT, "cluster").collect()
    assert [r.cluster for r in got] == label.tolist()
    sizes = np.bincount(label)
    assert list(sizes) == sorted(sizes, reverse=True)
    assert model.compute_cost(frame).first()[0] == pytest.approx(model.cost)


def test_partitioning_does_not_matter(frame):
    est = KPrototypes(numericCols=NUM, categoricalCols=CAT, k=3, nInit=2, maxIter=5)
    a, b = est.fit(frame.repartition(1)), est.fit(frame.repartition(7))
    assert a.prototypes == b.prototypes and a.cost == pytest.approx(b.cost)


def test_seeds_follow_density_times_distance(frame, rows):
    tuples = sorted({r[2:] for r in rows})
    share = [{v: sum(r[2 + i] == v for r in rows) / len(rows) for v in {r[2 + i] for r in rows}} for i in range(2)]
    density = {t: sum(s[v] for s, v in zip(share, t)) / 2 for t in tuples}
    want = [max(tuples, key=lambda t: (round(density[t], 12), [-ord(v) for v in t]))]
    while len(want) < 4:
        score = lambda t: min(density[t] * sum(a != b for a, b in zip(t, w)) for w in want)
        want.append(max(tuples, key=lambda t: (round(score(t), 12), [-ord(v) for v in t])))
    assert cao_seeds(frame, CAT, 4) == want
    assert cao_seeds(frame, CAT, 2) == want[:2]


def test_more_clusters_than_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a", "p"), (2.0, 2.0, "b", "q")] * 3, "x double, y double, c string, d string")
    model = KPrototypes(numericCols=NUM, categoricalCols=CAT, k=4, nInit=2, maxIter=10).fit(df)
    assert model.cost == pytest.approx(0.0)


def test_categories_only_and_numbers_only(frame):
    assert KPrototypes(categoricalCols=CAT, k=2).fit(frame).cost >= 0
    assert KPrototypes(numericCols=NUM, k=3, nInit=2).fit(frame).cost < 400


def test_sweep_and_elbow(spark, frame):
    models = KPrototypes(numericCols=NUM, categoricalCols=CAT, nInit=2, maxIter=6).sweep(frame, [2, 3, 4])
    assert models[4].cost <= models[2].cost
    alone = KPrototypes(numericCols=NUM, categoricalCols=CAT, k=3, nInit=2, maxIter=6).fit(frame)
    assert models[3].prototypes == alone.prototypes and models[3].cost == pytest.approx(alone.cost)
    table = {r.k: r for r in elbow_table(spark, {2: 9.0, 3: 4.0, 4: 3.5, 5: None}).collect()}
    assert [k for k, r in table.items() if r.is_best] == [4]
    assert table[3].bend == pytest.approx(4.5) and table[2].bend is None and table[5].cost is None


def test_missing_categories_are_values_of_coded_rows(spark):
    rows = spark.createDataFrame([(float(i % 5), 0.0, None if i % 3 else "a", "p") for i in range(20_000)], "x double, y double, c string, d string").coalesce(1)
    blocks = coded(rows, NUM, CAT)
    assert blocks.count() > 1 and blocks.groupBy().sum("n").first()[0] == 20_000
    start = [((0.0, 0.0), ("a", "p")), ((0.0, 0.0), (None, "q"))]
    found = {r.label: r for r in step(blocks, NUM, CAT, {0: start, 7: start[:1]}, 100.0).filter("run = 0").collect()}
    assert list(found) == [0] and found[0].size == 20_000  # equal distances go to the lower label
    assert step(blocks, NUM, CAT, {7: start[:1]}, 1.0).select("size", "c").collect() == [(20_000, None)]
    assert step(coded(rows.limit(0), NUM, CAT), NUM, CAT, {0: start}, 1.0).count() == 0


def test_model_is_stored(spark, frame, tmp_path):
    model = KPrototypes(numericCols=NUM, categoricalCols=CAT, k=2, nInit=1).fit(frame)
    model.write().overwrite().save(f"{tmp_path}/kp")
    again = KPrototypesModel.load(f"{tmp_path}/kp")
    assert again.prototypes == model.prototypes
    assert again.transform(frame).columns[-1] == "cluster"


def test_importance_equals_dummies(frame, rows):
    clustered = frame.withColumn("cluster", (F.col("x") > 4).cast("int"))
    label = np.array([int(r[0] > 4) for r in rows])
    for r in C.relative_importance(clustered, NUM, CAT).collect():
        pos = (NUM + CAT).index(r.feature)
        x = np.array([row[pos] if r.value is None else float(row[pos] == r.value) for row in rows])
        assert r.z == pytest.approx((x[label == r.cluster].mean() - x.mean()) / (x.std(ddof=1) + 1e-9), abs=1e-9)
    doubled = C.relative_importance(clustered.union(clustered), NUM, CAT)
    once = {(r.cluster, r.feature, r.value): r.z for r in C.relative_importance(clustered, NUM, CAT).collect()}
    assert all(r.z * once[r.cluster, r.feature, r.value] >= 0 for r in doubled.collect())


def test_drivers_rules_projection(frame):
    clustered = frame.withColumn("cluster", F.when(F.col("c") == "a", 0).when(F.col("x") > 6, 1).otherwise(2))
    roles = ColumnRoles(NUM, CAT)
    drivers = C.cluster_drivers(clustered, roles, trees=10, depth=4).collect()
    assert sum(r.importance for r in drivers) == pytest.approx(1)
    assert {drivers[0].base, drivers[1].base} <= {"c", "x", "y"}
    rules = C.cluster_rules(clustered, roles)
    assert rules.agg(F.sum("n_rows")).first()[0] == clustered.count()
    for r in rules.collect():  # a rule is a filter: it selects the rows it counts
        test = F.lit(True)
        for part in r.rule.split(" AND "):
            name, op, limit = part.rsplit(" ", 2)
            col = F.col(name) if name in NUM else (F.col(name[0]) == name[2:]).cast("double")
            if name in NUM:
                continue
            test = test & ((col <= float(limit)) if op == "<=" else (col > float(limit)))
        assert clustered.filter(test).count() >= r.n_rows
    projected = C.mixed_projection(frame, roles, 3)
    means = projected.select(F.posexplode("components").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("i").collect()
    assert all(abs(r.m) < 1e-9 for r in means)
    assert [r.s for r in means] == sorted([r.s for r in means], reverse=True)


def test_mixed_projection_is_that_of_the_wide_table(spark):
    """Against flags written out: variances, and products of rows, which no sign of an axis changes."""
    draw = np.random.RandomState(4)
    data = [(i, None if i % 11 == 0 else float(draw.randn()), float(draw.rand()), None if i % 7 == 0 else "abc"[draw.randint(3)], int(draw.randint(2))) for i in range(120)]
    df = spark.createDataFrame(data, "id int, x double, y double, c string, d int")
    roles = ColumnRoles(("x", "y"), ("c", "d"))
    numbers = np.array([[np.nan if v is None else v for v in r[1:3]] for r in data])
    z = np.nan_to_num((numbers - np.nanmean(numbers, axis=0)) / np.nanstd(numbers, axis=0))
    flags = np.array([[r[3] == v for v in "abc"] + [r[4] == v for v in (0, 1)] for r in data], dtype=float)
    wide = np.hstack([z, (flags - flags.mean(axis=0)) / np.sqrt(flags.mean(axis=0))])
    got = np.array([r.components for r in C.mixed_projection(df, roles, 10, ["id"]).orderBy("id").collect()])
    assert got.shape == (120, 7)
    np.testing.assert_allclose(got @ got.T, (wide - wide.mean(axis=0)) @ (wide - wide.mean(axis=0)).T, atol=1e-8)
    np.testing.assert_allclose(C.mixed_axes(df, roles)[3], np.sort(np.linalg.eigvalsh(np.cov(wide.T, ddof=0)))[::-1].clip(0), atol=1e-9)
    only = C.mixed_projection(df, ColumnRoles((), ("c",)), 2).first().components
    assert len(only) == 2


def test_projection_needs_no_join_per_category_column(frame):
    projected = C.mixed_projection(frame, ColumnRoles(tuple(NUM), tuple(CAT)), 3)
    assert "Join" not in projected._jdf.queryExecution().optimizedPlan().toString()


def test_distances_have_a_line_per_prototype_and_ties_go_to_the_first():
    from cohortry.operators import kprototypes as K

    block = (np.array([[0.0, 2.0, 1.0]]), np.array([[0, 1, 0]]), [{"a": 0, "b": 1}])
    far = K._distances(block, [((0.0,), ("a",)), ((2.0,), ("a",))], 0.5)
    assert far.tolist() == [[0.0, 4.5, 1.0], [4.0, 0.5, 1.0]]
    label, least = K._least(far)
    assert label.tolist() == [0, 1, 0] and least.tolist() == [0.0, 0.5, 1.0]
