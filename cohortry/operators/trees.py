"""Fitted trees as paths: what has to hold on the way to each leaf."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame

from cohortry.operators.ensembles import TreeEnsemble


def leaf_paths(tree: Mapping[str, np.ndarray]) -> list[tuple[int, list[tuple[int, float, bool, float]]]]:
    """(leaf, [(slot, threshold, x <= threshold, share of the parent's rows)]) for every leaf."""
    out, todo = [], [(0, [])]
    while todo:
        at, path = todo.pop()
        if tree["slot"][at] < 0:
            out.append((at, path))
            continue
        for child, below in ((int(tree["left"][at]), True), (int(tree["right"][at]), False)):
            share = tree["n"][child] / tree["n"][at] if tree["n"][at] else 0.0
            todo.append((child, [*path, (int(tree["slot"][at]), float(tree["threshold"][at]), below, float(share))]))
    return out


def tree_paths(model: TreeEnsemble, names: list[str]) -> DataFrame:
    """(leaf, rule, cluster, n_rows, purity) of the first tree of a class forest (a model's size, not the data's)."""
    tree, classes = next(iter(model.parts()))[0], model.getOrDefault(model.classes)
    shares, rows = tree["value"].reshape(-1, classes), []
    for leaf, path in leaf_paths(tree):
        tests = [f"{names[slot]} {'<=' if below else '>'} {threshold:.6g}" for slot, threshold, below, _ in path]
        rows.append((leaf, " AND ".join(tests) or "TRUE", int(shares[leaf].argmax()), int(tree["n"][leaf]), float(shares[leaf].max())))
    spark = model.rows.sparkSession
    return spark.createDataFrame(rows, "leaf int, rule string, cluster int, n_rows bigint, purity double").orderBy("leaf")
