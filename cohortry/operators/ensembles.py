"""Estimators over ``growth``: forests, boosted trees and class forests, and the model they share.

A model's trees are rows of a table (one row per tree, its nodes as arrays) in the shared folder; the driver holds at most
``PART_NODES`` nodes at a time, when it sends them to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.operators.growth import SMALL_ROWS, Draw, Held, Rules, row_key, tree_rows

#: Nodes of a part of a model: what is broadcast at once.
PART_NODES = 1 << 21
#: Trees, and nodes of theirs at most about, that grow together in the same passes.
_TOGETHER, _OPEN_NODES = 64, 1 << 18
_ARRAYS = ("slot", "threshold", "left", "right", "gain", "n", "value")


def _param(name: str, doc: str, kind):
    return Param(Params._dummy(), name, doc, kind)


def matrix(x: pa.Array) -> np.ndarray:
    """Arrays of numbers as the lines of one matrix."""
    return np.asarray(x.flatten(), dtype=np.float64).reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """The lines of a matrix as arrays of numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def tree_values(x: np.ndarray, tree: dict, classes: int = 1) -> np.ndarray:
    """Value (or class shares) of the leaf that each row reaches."""
    n, leaf, nodes = len(x), np.asarray(tree["slot"]) < 0, np.arange(len(tree["slot"]))
    begin = np.where(leaf, 0, tree["slot"]).astype(np.int64) * n
    cut = np.where(leaf, np.nan, tree["threshold"])
    above = np.stack([np.where(leaf, nodes, tree["right"]), np.where(leaf, nodes, tree["left"])], axis=1).ravel().astype(np.int64)
    by_column, at, live = np.ascontiguousarray(x.T).ravel(), np.zeros(n, np.int64), np.arange(n)
    now = at
    while len(now):  # all rows step together; once most have ended, only the others do
        ended = leaf.take(now)
        going = len(now) - int(ended.sum())
        if 2 * going < len(now):
            at[live] = now
            live, now = live[~ended], now[~ended]
        if going:
            now = above.take(2 * now + (by_column.take(begin.take(now) + live) <= cut.take(now)))
    values = tree["value"].reshape(-1, classes)[at]
    return values if classes > 1 else values[:, 0]


class TreeEnsemble(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """base + the weighted sum of its trees' leaf values; with classes, the class of the largest mean share."""

    base = _param("base", "what is added to all predictions", TypeConverters.toFloat)
    classes = _param("classes", "number of classes, 1 for numbers", TypeConverters.toInt)
    width = _param("width", "number of features", TypeConverters.toInt)

    def __init__(self, rows: DataFrame | None = None, **params):
        super().__init__()
        self._setDefault(base=0.0, classes=1)
        self._set(**params)
        self.rows = rows

    def copy(self, extra=None):
        out = super().copy(extra)
        out.rows = self.rows
        return out

    @property
    def treeWeights(self) -> list[float]:
        return [r["weight"] for r in self.rows.select("tree", "weight").orderBy("tree").collect()]

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, summing to 1 in every tree that splits, averaged over those trees."""
        pairs = self.rows.select("tree", F.explode(F.arrays_zip("slot", "gain")).alias("x")).filter("x.slot >= 0")
        share = pairs.groupBy("tree", F.col("x.slot").alias("slot")).agg(F.sum("x.gain").alias("gain"))
        own = share.join(share.groupBy("tree").agg(F.sum("gain").alias("all")), "tree").groupBy("slot").agg(F.sum(F.col("gain") / F.col("all")).alias("v"))
        out = np.zeros(self.getOrDefault(self.width))
        for r in own.collect():  # one number per feature
            out[r["slot"]] = r["v"]
        return DenseVector(out / out.sum() if out.sum() else out)

    def parts(self) -> Iterator[list[dict]]:
        """Trees as dictionaries of arrays (weight included), at most ``PART_NODES`` nodes or one tree at a time."""
        sizes = [(r["tree"], r["size"]) for r in self.rows.select("tree", F.size("slot").alias("size")).orderBy("tree").collect()]
        now, held = [], 0
        for tree, size in [*sizes, (None, PART_NODES)]:
            if now and held + size > PART_NODES:
                rows = self.rows.filter((F.col("tree") >= now[0]) & (F.col("tree") <= now[-1])).orderBy("tree").toArrow()
                yield [
                    {"tree": t["tree"], "weight": t["weight"]} | {c: np.array([np.nan if v is None else v for v in t[c]]) for c in _ARRAYS}
                    for t in rows.to_pylist()
                ]
                now, held = [], 0
            now, held = [*now, tree], held + size

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, x = self.getOrDefault(self.classes), vector_to_array(self.getFeaturesCol())
        spark = df.sparkSession

        def part_udf(part):
            sent = spark.sparkContext.broadcast(part)
            kind = "double" if classes == 1 else "array<double>"

            @F.arrow_udf(kind)
            def score(x: pa.Array) -> pa.Array:
                rows = matrix(x)
                total = sum((t["weight"] * tree_values(rows, t, classes) for t in sent.value), np.zeros((len(x), classes) if classes > 1 else len(x)))
                return lists(total) if classes > 1 else pa.array(total)

            return score(x)

        parts = [part_udf(p) for p in self.parts()]
        if classes == 1:
            return df.withColumn(self.getPredictionCol(), reduce(lambda a, b: a + b, parts, F.lit(self.getOrDefault(self.base))))
        shares = reduce(lambda a, b: F.zip_with(a, b, lambda u, v: u + v), parts)
        return df.withColumn(self.getPredictionCol(), (F.array_position(shares, F.array_max(shares)) - 1).cast("double"))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TreeEnsemble):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.rows.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TreeEnsemble:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(self.sparkSession.read.parquet(f"{path}/trees"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _Grower(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters shared by the estimators; ``maxDepth`` and ``numLeaves`` of 0 mean no limit."""

    numTrees = _param("numTrees", "trees, or rounds of boosting", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "depth, 0 for any", TypeConverters.toInt)
    numLeaves = _param("numLeaves", "leaves grown best first, 0 for any", TypeConverters.toInt)
    minSplit = _param("minSplit", "rows a node needs to be split", TypeConverters.toInt)
    minLeaf = _param("minLeaf", "rows of a child", TypeConverters.toInt)
    maxFeatures = _param("maxFeatures", "features tried per node: sqrt, log2, a share, a number or all", TypeConverters.toString)
    bootstrap = _param("bootstrap", "draw rows with repeats for every tree", TypeConverters.toBoolean)
    stepSize = _param("stepSize", "weight of a round", TypeConverters.toFloat)
    subsample = _param("subsample", "share of the rows of a round", TypeConverters.toFloat)
    l1 = _param("l1", "what a leaf's sum is shrunken by", TypeConverters.toFloat)
    l2 = _param("l2", "what is added to a leaf's rows", TypeConverters.toFloat)
    maxBins = _param("maxBins", "bins of a feature, at most 256", TypeConverters.toInt)
    seed = _param("seed", "seed of all draws", TypeConverters.toInt)
    _own: dict = {}

    def __init__(self, **params):
        super().__init__()
        given = {"numTrees": 100, "maxDepth": 0, "numLeaves": 0, "minSplit": 2, "minLeaf": 1, "maxFeatures": "all", "bootstrap": False, "stepSize": 0.1, "subsample": 1.0, "l1": 0.0, "l2": 0.0, "maxBins": 256, "seed": 42}
        self._setDefault(**{**given, **self._own})
        self._set(**params)

    def get(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def rules(self, classes: int = 1) -> Rules:
        return Rules(self.get("maxDepth"), self.get("numLeaves"), self.get("minSplit"), self.get("minLeaf"), self.get("l1"), self.get("l2"), self.get("maxFeatures"), classes)

    def held(self, df: DataFrame, classes: int = 1) -> Held:
        """The rows binned once, for one or many fits; a column ``fold`` becomes their part."""
        part = F.col("fold").cast("int") if "fold" in df.columns else F.lit(None).cast("int")
        x = vector_to_array(self.getFeaturesCol()).alias("x")
        y = F.col(self.getLabelCol()).cast("double").alias("y")
        keyed = df.select(x, y, row_key(df, self.getFeaturesCol()).alias("key"), part.alias("part"))
        return Held(keyed.filter(~F.isnan("y")), self.get("maxBins"), classes)

    def _fit(self, df: DataFrame) -> TreeEnsemble:
        held = self.held(df)
        try:
            return self.fit_held(held)
        finally:
            held.close()

    def _model(self, rows: DataFrame, width: int, base: float = 0.0, classes: int = 1) -> TreeEnsemble:
        return TreeEnsemble(rows, featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), base=float(base), classes=classes, width=width)

    def _forest(self, held: Held, leave: int = -1, classes: int = 1) -> TreeEnsemble:
        n, rules, scale = self.get("numTrees"), self.rules(classes), held.scale
        draw = Draw(self.get("bootstrap"), 1.0, self.get("seed"), leave)
        # the driver holds the nodes above those that tasks finish: by the depth, or by the rows of a finished node
        nodes = min(2 << min(rules.max_depth or 30, 30), 2 * rules.leaves or 2 << 30, 4 * (held.n // SMALL_ROWS + 1))
        together, parts = max(1, min(_TOGETHER, _OPEN_NODES // nodes)), []
        for begin in range(0, n, together):
            numbers = range(begin, min(n, begin + together))
            trees, finished = held.grow(numbers, rules, draw)
            parts.append(tree_rows(held.spark, trees, finished, held.cells.edges, rules, scale, {t: 1.0 / n for t in numbers}))
        return self._model(reduce(DataFrame.unionAll, parts), len(held.cells.edges), scale.middle, classes)


class TreeForest(_Grower):
    """Mean of trees, each over rows drawn with repeats (Poisson weights from a hash of the row) unless ``bootstrap`` is off."""

    _own = {"bootstrap": True}

    def fit_held(self, held: Held, leave: int = -1) -> TreeEnsemble:
        return self._forest(held, leave)


class BoostedTrees(_Grower):
    """Rounds of trees fitted to what the rounds before have left, under squared loss."""

    def fit_held(self, held: Held, leave: int = -1) -> TreeEnsemble:
        rules, rate, seed, trees = self.rules(), self.get("stepSize"), self.get("seed"), {}
        whole = held.scale
        count, mass, total = held.totals(Draw(leave=leave, seed=seed), [0], 1, whole)[0]
        base = whole.middle + total / whole.factor / max(mass, 1)
        scale = type(whole)(0.0, whole.factor)
        try:
            held.start(base)
            for k in range(self.get("numTrees")):
                grown, _ = held.grow([k], rules, Draw(False, self.get("subsample"), seed, leave), scale, passes_only=True)
                if not grown[k].chosen:
                    if self.get("subsample") >= 1.0:
                        break
                    continue
                trees[k] = grown[k]
                if k + 1 < self.get("numTrees"):
                    held.advance(grown[k], rules, rate, scale)
        finally:
            held.rewind()
        rows = tree_rows(held.spark, trees, None, held.cells.edges, rules, scale, {t: rate for t in trees})
        return self._model(rows, len(held.cells.edges), base)


class ClassForest(_Grower):
    """Forest of class shares over a label 0, 1, ...; splits lower the Gini impurity."""

    _own = {"bootstrap": True, "maxFeatures": "sqrt"}

    def _fit(self, df: DataFrame) -> TreeEnsemble:
        classes = int(df.agg(F.max(self.getLabelCol())).first()[0]) + 1
        held = self.held(df, max(2, classes))
        try:
            return self._forest(held, classes=max(2, classes))
        finally:
            held.close()
