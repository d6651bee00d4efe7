"""Trees grown over binned rows against plain recursions, in any layout, at any depth."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import growth as H
from cohortry.operators.ensembles import BoostedTrees, ClassForest, TreeEnsemble, TreeForest

N = 1500


@pytest.fixture(scope="module")
def table():
    r = np.random.RandomState(3)
    x = np.stack([r.randint(0, 40, N), r.randint(0, 2, N), r.randint(0, 9, N) / 4, r.randint(0, 200, N)], axis=1).astype(float)
    y = x[:, 0] * 2 + 30 * (x[:, 1] > 0) * (x[:, 2] > 1) - x[:, 3] / 10 + r.randint(-3, 4, N)
    return x, y, (x[:, 0] // 14).astype(int)


@pytest.fixture(scope="module")
def frame(spark, table):
    x, y, c = table
    rows = [(i, [float(v) for v in x[i]], float(y[i]), int(c[i])) for i in range(N)]
    made = spark.createDataFrame(rows, "id long, a array<double>, label double, c int")
    return made.select("id", array_to_vector("a").alias("features"), "label", "c").cache()


def predicted(model, frame):
    return np.array([r[0] for r in model.transform(frame).orderBy("id").select("prediction").collect()])


def plain_best(x, y, least, l1=0.0, l2=0.0):
    score = lambda t: np.maximum(abs(t.sum()) - l1, 0) ** 2 / (len(t) + l2)
    found = (1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= (a + b) / 2
            if least <= left.sum() <= len(y) - least:
                gain = score(y[left]) + score(y[~left]) - score(y)
                if gain > found[0] + 1e-6:
                    found = (gain, f, (a + b) / 2)
    return found


def plain_tree(x, y, depth, least=1, split=2, leaves=0, l1=0.0, l2=0.0):
    """Predictions of one tree over all rows, grown best first."""
    value = lambda t: np.sign(t.sum()) * max(abs(t.sum()) - l1, 0) / (len(t) + l2)
    out = np.empty(len(y))
    nodes = [(np.arange(len(y)), 0)]
    best = {0: plain_best(x, y, least, l1, l2)}
    done = 1
    while True:
        ready = [(-best[i][0], i) for i, (rows, d) in enumerate(nodes) if rows is not None and best[i][1] is not None and (not depth or d < depth) and len(rows) >= split]
        if not ready or leaves and done >= leaves:
            break
        i = min(ready)[1]
        rows, d = nodes[i]
        left = x[rows, best[i][1]] <= best[i][2]
        nodes[i] = (None, d)
        done += 1
        for part in (rows[left], rows[~left]):
            nodes.append((part, d + 1))
            best[len(nodes) - 1] = plain_best(x[part], y[part], least, l1, l2)
    for rows, _ in nodes:
        if rows is not None:
            out[rows] = value(y[rows])
    return out, done


@pytest.mark.parametrize("small", [0, 1 << 15, 300])
@pytest.mark.parametrize(("depth", "least", "split"), [(3, 1, 2), (0, 5, 40), (5, 2, 2)])
def test_one_tree_equals_recursion(frame, table, depth, least, split, small, monkeypatch):
    monkeypatch.setattr(H, "SMALL_ROWS", small)
    x, y, _ = table
    model = TreeForest(numTrees=1, maxDepth=depth, minLeaf=least, minSplit=split, bootstrap=False).fit(frame)
    want, _ = plain_tree(x, y, depth, least, split)
    np.testing.assert_allclose(predicted(model, frame), want, atol=1e-6)


def test_passes_in_parts_and_groups(frame, table, monkeypatch):
    monkeypatch.setattr(H, "SMALL_ROWS", 0)
    monkeypatch.setattr(H, "SUM_BYTES", 8000)
    monkeypatch.setattr(H, "_GROUP_CELLS", 20)
    model = TreeForest(numTrees=1, maxDepth=4, bootstrap=False).fit(frame)
    np.testing.assert_allclose(predicted(model, frame), plain_tree(*table[:2], 4)[0], atol=1e-6)


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (40.0, 0.0), (0.0, 25.0), (15.0, 3.0)])
def test_leaf_wise_round_with_penalties(frame, table, l1, l2):
    x, y, _ = table
    model = BoostedTrees(numTrees=1, stepSize=1.0, numLeaves=17, minLeaf=20, l1=l1, l2=l2).fit(frame)
    want, leaves = plain_tree(x, y - y.mean(), 0, 20, leaves=17, l1=l1, l2=l2)
    np.testing.assert_allclose(predicted(model, frame), want + y.mean(), atol=1e-5)
    assert leaves == 17 and sum(s < 0 for s in model.rows.first()["slot"]) == 17


def test_rounds_follow_what_is_left(frame, table, monkeypatch):
    monkeypatch.setattr(H, "_WRITE_EVERY", 2)
    x, y, _ = table
    model = BoostedTrees(numTrees=5, stepSize=0.3, maxDepth=3).fit(frame)
    f = np.full(N, y.mean())
    for _ in range(5):
        f += 0.3 * plain_tree(x, y - f, 3)[0]
    np.testing.assert_allclose(predicted(model, frame), f, atol=1e-5)


def test_seventy_leaves(frame):
    model = BoostedTrees(numTrees=2, numLeaves=70, minLeaf=2).fit(frame)
    assert [sum(s < 0 for s in r["slot"]) for r in model.rows.collect()] == [70, 70]


def test_depth_beyond_thirty(spark):
    # labels 0, 1, 0, 1, ...: the best split takes one row off an end, so the tree is as deep as there are rows
    rows = spark.range(80).select((F.col("id") * 1.0).alias("x"), (F.col("id") % 2 * 1.0).alias("label"), "id")
    made = rows.select(array_to_vector(F.array("x")).alias("features"), "label", "id").cache()

    def depth(limit):
        model = TreeForest(numTrees=1, maxDepth=limit, bootstrap=False).fit(made)
        tree, at = next(iter(model.parts()))[0], {0: 0}
        for i in np.flatnonzero(tree["slot"] >= 0):
            at[int(tree["left"][i])] = at[int(tree["right"][i])] = at[i] + 1
        return max(at.values()), model

    assert [depth(limit)[0] for limit in (4, 31, 50)] == [4, 31, 50]
    whole, model = depth(0)
    assert whole > 60 and list(predicted(model, made)) == [i % 2 for i in range(80)]


def test_to_the_leaves(frame, table):
    """Without limits every leaf is pure up to rows of equal features."""
    x, y, _ = table
    model = TreeForest(numTrees=1, bootstrap=False).fit(frame)
    by = {}
    for row, value in zip(map(tuple, x), y):
        by.setdefault(row, []).append(value)
    want = np.array([np.mean(by[tuple(row)]) for row in x])
    np.testing.assert_allclose(predicted(model, frame), want, atol=1e-6)


@pytest.mark.parametrize(
    "make",
    [
        lambda: TreeForest(numTrees=6, maxFeatures="sqrt", minLeaf=2),
        lambda: TreeForest(numTrees=4, maxDepth=4, maxFeatures="0.5"),
        lambda: BoostedTrees(numTrees=4, numLeaves=12, subsample=0.6),
    ],
)
def test_layouts_give_one_model(frame, make, monkeypatch):
    monkeypatch.setattr(H, "SMALL_ROWS", 400)
    found = [sorted(map(repr, make().fit(f).rows.collect())) for f in (frame.repartition(7, "id"), frame.coalesce(1), frame.repartition(31))]
    assert found[0] == found[1] == found[2]


def test_bagging_draws_and_learns(frame, table):
    x, y, _ = table
    model = TreeForest(numTrees=20, minLeaf=3, seed=1).fit(frame)
    assert np.mean((predicted(model, frame) - y) ** 2) < 0.1 * y.var()
    trees = model.rows.collect()
    assert len(trees) == 20 and len({tuple(t["n"][:1]) for t in trees}) > 10
    assert abs(np.mean([t["n"][0] for t in trees]) / N - 1) < 0.05
    importance = model.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and importance.argmax() == 0


def test_draws_are_poisson():
    import pyarrow as pa

    keys = pa.array(np.random.RandomState(0).randint(-(2**62), 2**62, 200_000))
    batch = pa.RecordBatch.from_arrays([keys, pa.array(np.arange(200_000) % 5)], ["key", "part"])
    w = H.Draw(True, seed=3).weights(batch, 1)
    assert [abs((w == k).mean() - p) < 0.005 for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613))] == [True] * 4
    assert abs(np.corrcoef(w, H.Draw(True, seed=3).weights(batch, 2))[0, 1]) < 0.01
    kept = H.Draw(False, 0.7, 3, leave=2).weights(batch, 1)
    assert abs(kept.mean() - 0.7 * 0.8) < 0.01 and not kept[np.arange(200_000) % 5 == 2].any()


def test_classes(frame, table):
    x, _, c = table
    model = ClassForest(numTrees=1, maxDepth=2, bootstrap=False, maxFeatures="all", labelCol="c").fit(frame)
    assert (predicted(model, frame) == c).all()
    tree = next(iter(model.parts()))[0]
    assert {float(t) for s, t in zip(tree["slot"], tree["threshold"]) if s >= 0} == {13.5, 27.5}


def test_model_is_stored(frame, tmp_path):
    model = TreeForest(numTrees=3, maxDepth=4).fit(frame)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = TreeEnsemble.load(f"{tmp_path}/m")
    assert (predicted(again, frame) == predicted(model, frame)).all()


def test_parts_of_a_model_add_up(frame, monkeypatch):
    from cohortry.operators import ensembles

    model = TreeForest(numTrees=5, maxDepth=4).fit(frame)
    whole = predicted(model, frame)
    monkeypatch.setattr(ensembles, "PART_NODES", 40)
    assert len(list(model.parts())) > 2
    np.testing.assert_allclose(predicted(model, frame), whole, rtol=1e-12)


def test_constant_label_and_no_rows(spark, frame):
    flat = frame.withColumn("label", F.lit(4.0))
    assert set(predicted(TreeForest(numTrees=2).fit(flat), flat)) == {4.0}
    assert set(predicted(BoostedTrees(numTrees=2).fit(flat), flat)) == {4.0}
    with pytest.raises(ValueError):
        TreeForest(numTrees=1).fit(frame.withColumn("label", F.lit(None).cast("double")))


def test_rows_are_held_in_blocks(frame):
    held = TreeForest(numTrees=1).held(frame.coalesce(1))
    try:
        assert held.n == N and held.frame.count() <= 2
    finally:
        held.close()


def test_trees_of_many_rows_share_their_passes(frame, monkeypatch):
    grown, grow = [], H.Held.grow
    monkeypatch.setattr(H.Held, "grow", lambda self, numbers, *a, **k: grown.append(len(numbers)) or grow(self, numbers, *a, **k))
    made = TreeForest(numTrees=6, maxDepth=3)
    held = made.held(frame)
    try:
        held.n = 200_000_000
        made.fit_held(held)
    finally:
        held.close()
    assert grown == [6]


def test_finished_in_parts(frame, table, monkeypatch):
    monkeypatch.setattr(H, "SMALL_ROWS", 300)
    whole = predicted(TreeForest(numTrees=3, minLeaf=2).fit(frame), frame)
    monkeypatch.setattr(H, "_DEALT_ROWS", 2000)
    assert (predicted(TreeForest(numTrees=3, minLeaf=2).fit(frame), frame) == whole).all()


def test_few_values_are_held_as_codes():
    r = np.random.RandomState(0)
    x = np.concatenate([r.randint(0, 50, (2000, 1)), np.eye(5)[r.randint(0, 5, 2000)], r.rand(2000, 1), np.full((2000, 1), np.nan)], axis=1).astype(float)
    held = H.packed(x)
    for column, (values, codes) in zip(x.T, H.unpacked(held, 2000), strict=True):
        np.testing.assert_array_equal(values if codes is None else values[codes], column)
    assert len(held) < 2000 * (8 + 7 + 1)  # the one column of many values, and a byte for each of the others
    one = H.packed(x[:1])
    assert [v.tolist() for v, _ in H.unpacked(one, 1)][:7] == [[v] for v in x[0, :7]]


@pytest.mark.parametrize("classes", [1, 3])
@pytest.mark.parametrize("share", [0.02, 0.6, 1.0])
def test_sums_without_common_bins_are_those_of_all_bins(classes, share):
    r = np.random.RandomState(classes)
    bins = np.concatenate([r.randint(0, 30, (3000, 1)), np.eye(6)[r.randint(0, 6, 3000)], np.zeros((3000, 1))], axis=1).astype(np.uint8)
    cells = H.Cells((np.arange(29.0), *[np.array([0.5])] * 6, np.zeros(0)))
    for weight in (r.poisson(1.0, 3000), np.ones(3000, np.int64)):
        sums, want = H._Sums(cells, classes), 0
        for part in (slice(0, 1000), slice(1000, 3000)):
            target = np.rint(r.randn(3000) * 2**30) if classes == 1 else r.randint(0, 3, 3000).astype(float)
            slot = np.where(r.rand(3000) < share, r.randint(0, 4, 3000), -1)
            mine, own = bins[part], np.flatnonzero((slot[part] >= 0) & (weight[part] > 0))
            sums.add(7, mine, sums.entries(mine), target[part], weight[part], slot[part], 4)
            want = want + H._sums_of(mine[own], target[part][own], weight[part][own], slot[part][own], 4, cells, classes)
        assert (sums.of(7) == want).all() and want[:, :, 0].sum() > 0


def test_a_row_costs_as_many_entries_as_it_has_uncommon_bins():
    bins = np.eye(20)[np.arange(1000) % 20].astype(np.uint8)
    row, _ = H._Sums(H.Cells(tuple([np.array([0.5])] * 20)), 1).entries(bins)
    assert np.bincount(row).tolist() == [2] * 1000  # its flag, and the node itself
