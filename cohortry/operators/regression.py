"""Regression models per group on prepared frames (``features``, ``label``)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from cohortry.operators.ensembles import BoostedTrees, TreeForest
from cohortry.operators.kernels import Identity, Landmarks, choose_landmarks, kernel_error, lift_of
from cohortry.session import cached

# Default forest parameters per group.
FOREST_DEFAULTS = {
    "privada": {"n_estimators": 600, "max_depth": 100, "min_samples_leaf": 1, "max_features": None, "bootstrap": True},
    "publica": {"n_estimators": 700, "max_depth": None, "min_samples_leaf": 1, "max_features": None, "bootstrap": True},
}
# Parameters that name an engine detail with no meaning here.
_IGNORED = {"criterion", "n_jobs", "random_state", "verbose", "solver"}
# Names of tree parameters, and how their values are stated here: 0 for no limit of depth or leaves.
_TREE_NAMES: dict[str, tuple[str, Callable]] = {
    "n_estimators": ("numTrees", int),
    "max_depth": ("maxDepth", lambda v: 0 if v in (None, -1) else int(v)),
    "max_features": ("maxFeatures", lambda v: "all" if v in (None, 1.0) else str(v)),
    "min_samples_split": ("minSplit", int),
    "min_samples_leaf": ("minLeaf", int),
    "min_child_samples": ("minLeaf", int),
    "bootstrap": ("bootstrap", bool),
    "learning_rate": ("stepSize", float),
    "subsample": ("subsample", float),
    "num_leaves": ("numLeaves", int),
    "reg_alpha": ("l1", float),
    "reg_lambda": ("l2", float),
}


def tree_params(params: Mapping) -> dict:
    """The parameters by the names of the estimators here; unknown ones raise."""
    out = {}
    for name, value in params.items():
        if name in _IGNORED:
            continue
        if name not in _TREE_NAMES:
            raise ValueError(f"unknown parameter {name}")
        key, convert = _TREE_NAMES[name]
        out[key] = convert(value)
    return out


def forest(params: Mapping | None = None, group: str = "publica", seed: int = 42) -> TreeForest:
    """Random forest (100 trees of any depth); given parameters win over the group's defaults."""
    chosen = FOREST_DEFAULTS.get(group, FOREST_DEFAULTS["publica"]) if params is None else params
    return TreeForest(seed=seed, **tree_params(chosen))


def boosting(params: Mapping | None = None, seed: int = 42) -> BoostedTrees:
    """Gradient boosting with stage-wise trees (100 rounds, rate 0.1, depth 3 unless given)."""
    return BoostedTrees(seed=seed, **{"maxDepth": 3, **tree_params(params or {})})


def histogram_boosting(params: Mapping | None = None, seed: int = 42, bins: int = 255) -> BoostedTrees:
    """Boosting of trees grown leaf by leaf, best gain first (100 rounds, 31 leaves of at least 20 rows unless given)."""
    return BoostedTrees(seed=seed, maxBins=bins, **{"numLeaves": 31, "minLeaf": 20, **tree_params(params or {})})


class Ridge(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares plus ``alpha * |w|^2`` in raw units.

    Spark divides the loss by the rows and rescales the penalty by the label's deviation; both are taken from the rows
    of each fit, so the penalty is also right inside a cross-validation fold. ``solver`` is ``normal`` (one pass, at most
    4,096 features) or ``l-bfgs`` (any number).
    """

    alpha = Param(Params._dummy(), "alpha", "weight of the penalty", TypeConverters.toFloat)
    solver = Param(Params._dummy(), "solver", "normal or l-bfgs", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0, solver="normal"):
        super().__init__()
        self._setDefault(alpha=1.0, solver="normal")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        features, label = self.getFeaturesCol(), self.getLabelCol()
        normal = self.getOrDefault(self.solver) == "normal"
        n, sigma = df.agg(F.count(label), (F.stddev_pop if normal else F.stddev_samp)(label)).first()
        fitter = LinearRegression(
            featuresCol=features,
            labelCol=label,
            predictionCol=self.getPredictionCol(),
            elasticNetParam=0.0,
            solver=self.getOrDefault(self.solver),
            regParam=self.getOrDefault(self.alpha) / n * sigma,
            standardization=False,
            maxIter=500,
            tol=1e-12,
        )
        return fitter.fit(df)


class SupportVectorModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "JSON: weights, bias, feature map and kernel error", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def weights(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault(self.state))["weights"])

    @property
    def bias(self) -> float:
        return json.loads(self.getOrDefault(self.state))["bias"]

    @property
    def kernel_error(self) -> dict[str, float]:
        """``mean`` and ``largest`` error of the rbf kernel over the training rows (zero for the linear kernel)."""
        return json.loads(self.getOrDefault(self.state))["error"]

    def _transform(self, df):
        s = json.loads(self.getOrDefault(self.state))
        w, b, lift = np.array(s["weights"]), s["bias"], lift_of(s["lift"])

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(lift(np.vstack(x)) @ w + b if len(x) else np.zeros(0))

        return df.withColumn(self.getPredictionCol(), score(vector_to_array(self.getFeaturesCol())))


class SupportVectorRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fit of ``|w|^2 / 2 + C * sum(max(0, |y - f| - epsilon))``.

    One distributed pass gives the loss and its gradient: each task reduces its Arrow batches to one array, and Spark
    sums those by position. The kink of the loss is rounded, and the rounding shrinks in stages down to ``smooth``
    deviations of the label; each stage runs limited-memory quasi-Newton steps from the last point. ``rbf`` uses
    the kernel's projection on ``landmarks`` rows chosen by k-means++ (:mod:`cohortry.operators.kernels`); its error over all
    training rows is measured and kept in the model, and is zero where there are no more distinct rows than landmarks.
    """

    kernel = Param(Params._dummy(), "kernel", "linear or rbf", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half width of the free tube", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps per stage", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "relative change that ends the fit", TypeConverters.toFloat)
    smooth = Param(Params._dummy(), "smooth", "final rounding of the kink", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "landmark rows of the rbf kernel", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the landmarks", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        kernel="rbf",
        C=1.0,
        epsilon=0.1,
        maxIter=50,
        tol=1e-5,
        smooth=0.001,
        landmarks=256,
        seed=42,
    ):
        super().__init__()
        self._setDefault(kernel="rbf", C=1.0, epsilon=0.1, maxIter=50, tol=1e-5, smooth=0.001, landmarks=256, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        get = lambda name: self.getOrDefault(getattr(self, name))
        columns = vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")
        with cached(df.select(*columns)) as rows:
            dim = len(rows.first()["x"])
            n, mean_y, sd_y = rows.agg(F.count("y"), F.avg("y"), F.stddev_pop("y")).first()
            lift, error = Identity(dim), (0.0, 0.0)
            if get("kernel") == "rbf":
                # width as the usual 1 / (features * variance of all entries)
                entries = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
                lift = Landmarks(choose_landmarks(rows, get("landmarks"), get("seed")), 1 / (dim * (entries or 1.0)))
                error = kernel_error(rows, lift)
            weights, bias = self._descend(rows, lift, n, mean_y, sd_y or 1.0)
        state = json.dumps({"weights": weights.tolist(), "bias": float(bias), "lift": lift.args, "error": {"mean": error[0], "largest": error[1]}})
        return SupportVectorModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), state=state)

    def _descend(self, rows, lift, n, mean_y, sd_y):
        get = lambda name: self.getOrDefault(getattr(self, name))
        shrink = 1 / (get("C") * n)  # objective divided by C * n: mean loss + shrink / 2 * |w|^2
        point = np.append(np.zeros(lift.features), mean_y)
        width, last = 0.1, get("smooth")
        while True:
            width = max(width, last)

            def objective(at, width=width * sd_y):
                loss, slope = loss_and_gradient(rows, lift, at, get("epsilon"), width)
                inner = np.append(at[:-1], 0.0)
                return loss / n + shrink / 2 * inner @ inner, slope / n + shrink * inner

            point = quasi_newton(objective, point, get("maxIter"), get("tol"))
            if width <= last:
                return point[:-1], point[-1]
            width /= 10


def quasi_newton(objective: Callable, point: np.ndarray, steps: int, tol: float, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``objective`` gives (value, gradient)."""
    value, slope = objective(point)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, used = -slope, []
        for moved, turned in reversed(pairs):
            share = moved @ direction / (moved @ turned)
            used.append(share)
            direction = direction - share * turned
        if pairs:
            moved, turned = pairs[-1]
            direction = direction * (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(pairs, reversed(used)):
            direction = direction + moved * (share - turned @ direction / (moved @ turned))
        fall, size = slope @ direction, 1.0
        if fall >= 0:
            direction, fall, pairs = -slope, -(slope @ slope), []
        while True:
            following = point + size * direction
            lower, new_slope = objective(following)
            if lower <= value + 1e-4 * size * fall or size < 1e-6:
                break
            size /= 2
        if lower >= value:
            return point
        step, turn = following - point, new_slope - slope
        if step @ turn > 1e-12 * np.linalg.norm(step) * np.linalg.norm(turn):
            pairs = [*pairs[1 - memory :], (step, turn)]
        gain, point, value, slope = value - lower, following, lower, new_slope
        if gain <= tol * max(abs(value), 1e-12):
            break
    return point


def loss_and_gradient(rows: DataFrame, lift: Callable, point: np.ndarray, eps: float, width: float) -> tuple[float, np.ndarray]:
    """Summed rounded loss and its gradient in (weights, bias): one array per task, added up by position."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(point) + 1)
        for batch in batches:
            if not len(batch):
                continue
            z = lift(np.vstack(batch["x"]))
            miss = z @ point[:-1] + point[-1] - batch["y"].to_numpy()
            over = np.maximum(np.abs(miss) - eps, 0.0)
            loss = np.where(over < width, over * over / (2 * width), over - width / 2)
            slope = np.sign(miss) * np.minimum(over / width, 1.0)
            total += np.concatenate([[loss.sum()], slope @ z, [slope.sum()]])
        yield pd.DataFrame({"g": [total]})

    parts = rows.mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("i", "g"))
    out = np.zeros(len(point) + 1)
    for row in parts.groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[row["i"]] = row["g"]
    return out[0], out[1:]


def support_vector(params: Mapping | None = None, seed: int = 42, **extra) -> SupportVectorRegressor:
    return SupportVectorRegressor(seed=seed, **{k: v for k, v in (params or {}).items() if k not in _IGNORED}, **extra)


def make_regressor(family: str, params: Mapping | None = None, group: str = "publica", seed: int = 42):
    """An estimator by family name."""
    plain = {k: v for k, v in (params or {}).items() if k not in _IGNORED}
    if family == "RandomForest":
        return forest(params, group, seed)
    if family == "GradientBoosting":
        return boosting(params, seed)
    if family == "LightGBM":
        return histogram_boosting(params, seed)
    if family == "Ridge":
        return Ridge(**plain)
    if family == "SVR":
        return support_vector(params, seed)
    raise ValueError(f"unknown model family {family}")


def estimator_params(family: str, params: Mapping) -> dict:
    """Names and values of one candidate of a family, as its estimator takes them."""
    if family in ("RandomForest", "GradientBoosting", "LightGBM"):
        return tree_params(params)
    return {k: v for k, v in params.items() if k not in _IGNORED}


def fit_cached(estimator: Estimator, train: DataFrame):
    """Fit on the training rows, held for the passes of the fit only: trees hold binned rows, others features and label."""
    if isinstance(estimator, (TreeForest, BoostedTrees)):
        return estimator.fit(train)
    with cached(train.select(*[c for c in ("features", "label", "fold") if c in train.columns])) as rows:
        return estimator.fit(rows)


def fit_per_group(prepared: Mapping[str, object], make: Callable, groups: Sequence[str] | None = None) -> dict:
    """One model per group; ``make(group, train)`` gives the estimator."""
    return {g: fit_cached(make(g, prepared[g].train), prepared[g].train) for g in groups or prepared}
