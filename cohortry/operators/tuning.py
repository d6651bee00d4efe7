"""Hyper-parameter search with folds that do not depend on partitioning."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortry.operators.ensembles import TreeEnsemble, TreeForest
from cohortry.operators.evaluation import regression_metrics
from cohortry.operators.features import Prepared, encoding_stages
from cohortry.operators.regression import fit_cached, make_regressor
from cohortry.operators.rows import with_fold
from cohortry.session import cached

# The search grids per model family.
GRIDS = {
    "RandomForest": {
        "n_estimators": [700],
        "max_depth": [20, 30],
        "min_samples_split": [2, 5],
        "min_samples_leaf": [1, 3],
        "max_features": ["sqrt", None, 0.5],
    },
    "LightGBM": {
        "n_estimators": [200, 300, 500],
        "learning_rate": [0.05, 0.1],
        "num_leaves": [31, 70],
        "max_depth": [20, -1],
        "min_child_samples": [20, 50],
        "reg_alpha": [0.0, 0.1],
        "reg_lambda": [0.0, 0.1],
    },
    "GradientBoosting": {
        "n_estimators": [100, 200, 300],
        "learning_rate": [0.01, 0.05, 0.1],
        "max_depth": [3, 5, 8],
        "subsample": [0.7, 0.9, 1.0],
        "min_samples_split": [5, 10, 20],
    },
    "SVR": {"kernel": ["rbf", "linear"], "C": [0.1, 1.0, 10.0], "epsilon": [0.1, 0.2]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
}
# The random-search ranges; ("int", low, high) excludes high, ("real", start, width) is start..start+width.
RANGES = {
    "RandomForest": {
        "n_estimators": ("int", 100, 500),
        "max_depth": [10, 20, None],
        "min_samples_split": ("int", 2, 11),
        "min_samples_leaf": ("int", 1, 5),
    },
    "LightGBM": {
        "n_estimators": ("int", 100, 500),
        "learning_rate": ("real", 0.01, 0.3),
        "num_leaves": ("int", 20, 150),
        "max_depth": [10, -1],
    },
    "GradientBoosting": {
        "n_estimators": ("int", 100, 500),
        "learning_rate": ("real", 0.01, 0.3),
        "max_depth": ("int", 3, 10),
    },
    "SVR": {"kernel": ["rbf", "linear"], "C": ("real", 0.1, 10.0), "epsilon": ("real", 0.05, 0.5)},
    "Ridge": {"alpha": ("real", 0.1, 100.0)},
}


def grid_candidates(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def random_candidates(ranges: Mapping, n_iter: int, seed: int = 42) -> list[dict]:
    draw = np.random.RandomState(seed)

    def pick(space):
        if isinstance(space, tuple) and space[0] == "int":
            return int(draw.randint(space[1], space[2]))
        if isinstance(space, tuple):
            return float(space[1] + draw.rand() * space[2])
        return space[int(draw.randint(len(space)))]

    return [{name: pick(space) for name, space in ranges.items()} for _ in range(n_iter)]


def _miss(model, rows: DataFrame) -> float | None:
    return regression_metrics(model.transform(rows)).first()["mse"]


def fold_statistics(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per fold the products of all pairs of (features, 1, label), summed in one pass; a fold's matrix meets row by row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if n:
                x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(n, -1)
                z = np.column_stack([x, np.ones(n), np.asarray(batch.column("y"))])
                fold = np.asarray(batch.column("fold"))
                for f in np.unique(fold).tolist():
                    own = z[fold == f]
                    held[f] = held.get(f, 0.0) + own.T @ own
        for f, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["fold", "i", "g"])

    def summed(key, group):
        total = np.sum(group["g"].to_pylist(), axis=0)
        return pa.table({"fold": [key[0].as_py()], "i": [key[1].as_py()], "g": pa.array([total], pa.list_(pa.float64()))}).cast(pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("g", pa.list_(pa.float64()))]))

    picked = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"))
    parts = picked.filter("y IS NOT NULL").mapInArrow(partial, "fold int, i int, g array<double>")
    out: dict[int, dict[int, list]] = {}
    for r in parts.groupBy("fold", "i").applyInArrow(summed, "fold int, i int, g array<double>").collect():  # folds x features^2 numbers
        out.setdefault(r["fold"], {})[r["i"]] = r["g"]
    return {f: np.array([g[i] for i in sorted(g)]) for f, g in out.items()}


def ridge_scores(rows: DataFrame, alphas: Sequence[float]) -> list[float]:
    """Mean over the folds of the error of every penalty, all from ``fold_statistics``: fits are solved from differences."""
    parts = fold_statistics(rows)
    whole, scores = sum(parts.values()), []
    for alpha in alphas:
        errors = []
        for own in parts.values():
            g = whole - own
            p, n = len(g) - 2, g[-2, -2]
            if n <= 0:
                continue
            mean, y = g[:p, p] / n, g[p, p + 1] / n
            inner = g[:p, :p] - n * np.outer(mean, mean)
            # a flag per category sums to one, so the matrix can be singular where the penalty is tiny
            w = np.linalg.lstsq(inner + alpha * np.eye(p), g[:p, p + 1] - n * mean * y, rcond=None)[0]
            v = np.concatenate([-w, [mean @ w - y, 1.0]])
            errors.append(max(0.0, v @ own @ v) / own[-2, -2])
        scores.append(float(np.mean(errors)))
    return scores


def first_trees(model: TreeEnsemble, estimator, n: int) -> TreeEnsemble:
    """The model of the first ``n`` trees or rounds: what a fit of that many would have given."""
    out = model.copy()
    out.rows = model.rows.filter(F.col("tree") < n)
    if isinstance(estimator, TreeForest):
        out.rows = out.rows.withColumn("weight", F.lit(1.0 / n))
    return out


def tree_scores(rows: DataFrame, make: Callable, candidates: Sequence[Mapping], folds: int) -> list[float]:
    """Mean error over the folds of every candidate. The rows are binned and held once for all of them; candidates that
    differ in their number of trees alone share the fit of the largest."""
    shared: dict[str, list[int]] = {}
    for i, c in enumerate(candidates):
        shared.setdefault(json.dumps({k: v for k, v in c.items() if k != "n_estimators"}, sort_keys=True), []).append(i)
    errors: dict[int, list[float]] = {i: [] for i in range(len(candidates))}
    held = make(candidates[0]).held(rows)
    try:
        for own in shared.values():
            most = max(own, key=lambda i: candidates[i].get("n_estimators", 0))
            estimator = make(candidates[most])
            for fold in range(folds):
                model = estimator.fit_held(held, leave=fold)
                left = rows.filter(F.col("fold") == fold)
                for i in own:
                    n = candidates[i].get("n_estimators")
                    error = _miss(model if i == most or n is None else first_trees(model, estimator, int(n)), left)
                    if error is not None:
                        errors[i].append(error)
    finally:
        held.close()
    return [float(np.mean(errors[i])) for i in range(len(candidates))]


def fold_scores(rows: DataFrame, make: Callable, candidates: Sequence[Mapping], folds: int, stages: Sequence = ()) -> list[float]:
    """Mean error over the folds of every candidate, each fitted to the rows outside the fold; ``stages`` are too."""
    errors: list[list[float]] = [[] for _ in candidates]
    for fold in range(folds):
        train, left = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        if stages:
            encoder = Pipeline(stages=list(stages)).fit(train)
            train, left = encoder.transform(train), encoder.transform(left)
        with cached(train) as ready:
            for own, c in zip(errors, candidates):
                error = _miss(make(c).fit(ready), left)
                if error is not None:
                    own.append(error)
    return [float(np.mean(e)) for e in errors]


def search(
    prepared: Prepared,
    family: str,
    candidates: Sequence[Mapping],
    folds: int,
    group: str,
    method: str,
    seed: int = 42,
    encode_per_fold: bool = False,
    **fixed,
):
    """Cross-validate every candidate, refit the best one: (best model, summary row).

    The training rows are held once for the whole search; what is drawn follows from the rows, not from their layout.
    ``encode_per_fold`` refits scaling and encoding inside each fold; otherwise they come from the whole training part, and
    so do the bins of tree features.
    """
    make = lambda c: make_regressor(family, {**fixed, **c}, group, seed)
    keys = prepared.roles.keys or prepared.roles.features
    train, test, stages = with_fold(prepared.train, keys, folds, seed), prepared.test, []
    if encode_per_fold:
        stages = encoding_stages(prepared.roles)
        train, test = train.drop("features"), test.drop("features")
    with cached(train) as rows:
        if stages:
            scores = fold_scores(rows, make, candidates, folds, stages)
        elif family == "Ridge":
            scores = ridge_scores(rows, [make(c).getOrDefault("alpha") for c in candidates])
        elif family in ("RandomForest", "GradientBoosting", "LightGBM"):
            scores = tree_scores(rows, make, candidates, folds)
        else:
            scores = fold_scores(rows, make, candidates, folds)
        best = int(np.argmin(scores))
        whole = rows.drop("fold")
        if stages:
            encoder = Pipeline(stages=stages).fit(whole)
            whole, test = encoder.transform(whole), encoder.transform(test)
        model = fit_cached(make(candidates[best]), whole)
    metrics = regression_metrics(model.transform(test)).first()
    row = (
        family,
        group,
        method,
        len(candidates),
        json.dumps(dict(candidates[best]), sort_keys=True),
        -scores[best],
        float(metrics["r2"]),
        float(metrics["mse"]),
    )
    return model, row


def search_summary(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(
        list(rows),
        "model string, dataset string, search_method string, n_iterations int, best_params string, "
        "best_score double, r2_score double, mse double",
    )


def search_groups(prepared: Mapping[str, Prepared], family: str, method: str = "grid", n_iter: int = 10, seed: int = 42, candidates=None, **options):
    """Search every group: ({group: best model}, summary frame). Grid search uses 5 folds, random search 3."""
    models, rows = {}, []
    if candidates is None:
        candidates = grid_candidates(GRIDS[family]) if method == "grid" else random_candidates(RANGES[family], n_iter, seed)
    folds = options.pop("folds", 5 if method == "grid" else 3)
    for group, parts in prepared.items():
        models[group], row = search(parts, family, candidates, folds, group, method, seed, **options)
        rows.append(row)
    spark = next(iter(prepared.values())).train.sparkSession
    return models, search_summary(spark, rows)
