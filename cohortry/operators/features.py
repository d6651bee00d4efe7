"""Feature preparation: imputation, population scaling, encoding, and the pipelines built from them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import code_text, coded_boolean
from cohortry.operators.aggregates import low_cardinality, mean_and_std, medians_and_modes
from cohortry.operators.rows import at_least, drop_incomplete, in_test, require_columns
from cohortry.roles import ColumnRoles
from cohortry.session import stored


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _pairs(self):
        return list(zip(self.getInputCols(), self.getOutputCols()))


class CodeText(Transformer, _Columns):
    """Categories as one canonical text each, so 1, 1.0 and "1" are the same category at training and scoring."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return df.withColumns({out: code_text(c) for c, out in self._pairs()})


class PopulationScalerModel(Model, _Columns):
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population deviations, 1 where constant", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        stats = zip(self._pairs(), self.getOrDefault(self.means), self.getOrDefault(self.stds))
        return df.withColumns({out: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for (c, out), m, s in stats})


class PopulationScaler(Estimator, _Columns):
    """(x - mean) / population deviation; a constant column becomes zeros."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getInputCols()
        row = mean_and_std(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, population=True).first()
        return PopulationScalerModel(
            inputCols=cols,
            outputCols=self.getOutputCols(),
            means=[row[f"{c}_mean"] or 0.0 for c in cols],
            stds=[row[f"{c}_std"] or 1.0 for c in cols],
        )


class MixedImputerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "JSON: fill value per column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def fill_values(self) -> dict:
        return json.loads(self.getOrDefault(self.fills))

    def _transform(self, df):
        kind = lambda c, v: "double" if isinstance(v, float) else df.schema[c].dataType
        return df.withColumns(
            {c: F.coalesce(F.col(c).cast(kind(c, v)), F.lit(v)) for c, v in self.fill_values().items() if v is not None}
        )


class MixedImputer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Missing numbers take the exact median, missing categories the smallest of the most frequent values."""

    numericCols = Param(Params._dummy(), "numericCols", "columns filled by median", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "columns filled by mode", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numericCols=(), categoricalCols=()):
        super().__init__()
        self._set(**{k: list(v) for k, v in self._input_kwargs.items()})

    def _fit(self, df):
        numeric = self.getOrDefault(self.numericCols)
        row = medians_and_modes(df, numeric, self.getOrDefault(self.categoricalCols)).first().asDict()
        return MixedImputerModel(fills=json.dumps(row))


def encoding_stages(roles: ColumnRoles, output: str = "features") -> list:
    """Scaled numbers first, then one slot per known category; an unknown or missing category is all zeros."""
    stages, inputs = [], []
    if roles.numeric:
        scaled = [f"{c}__z" for c in roles.numeric]
        stages.append(PopulationScaler(inputCols=list(roles.numeric), outputCols=scaled))
        inputs += scaled
    if roles.categorical:
        text, index, hot = ([f"{c}__{s}" for c in roles.categorical] for s in ("text", "index", "hot"))
        stages += [
            CodeText(inputCols=list(roles.categorical), outputCols=text),
            StringIndexer(inputCols=text, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
        inputs += hot
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=output)]


def helper_columns(roles: ColumnRoles) -> list[str]:
    return [f"{c}__z" for c in roles.numeric] + [f"{c}__{s}" for c in roles.categorical for s in ("text", "index", "hot")]


def feature_names(model: PipelineModel, roles: ColumnRoles) -> list[tuple[str, str]]:
    """(encoded name, base column) for every slot of the assembled vector, in order."""
    names = [(c, c) for c in roles.numeric]
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            for column, labels in zip(roles.categorical, stage.labelsArray):
                names += [(f"{column}_{label}", column) for label in labels]
    return names


def names_frame(spark, model: PipelineModel, roles: ColumnRoles) -> DataFrame:
    rows = [(i, name, base) for i, (name, base) in enumerate(feature_names(model, roles))]
    return spark.createDataFrame(rows, "slot int, feature string, base string")


@dataclass(frozen=True)
class Prepared:
    """Train and test rows with ``features`` and ``label``, the fitted feature stages, and what they were fitted on."""

    train: DataFrame
    test: DataFrame
    stages: PipelineModel
    roles: ColumnRoles


def regression_frame(
    df: DataFrame,
    roles: ColumnRoles,
    min_year: tuple[str, int] | None = None,
    boolean_codes: Sequence[str] = (),
    leakage: Sequence[str] = (),
) -> tuple[DataFrame, ColumnRoles]:
    """Rows and roles ready for encoding: year filter, recoded booleans, leakage columns out, complete rows only."""
    require_columns(df, [*roles.features, roles.target])
    if min_year:
        df = at_least(df, *min_year)
    df = df.withColumns({c: coded_boolean(c).cast("double") for c in boolean_codes if c in df.columns})
    roles = roles.without(*leakage, roles.target)
    used = [*roles.features, roles.target]
    keys = [k for k in roles.keys if k not in used]
    return drop_incomplete(df.select(*used, *keys), used), roles


def prepare_regression(
    df: DataFrame,
    roles: ColumnRoles,
    min_year: tuple[str, int] | None = None,
    boolean_codes: Sequence[str] = (),
    leakage: Sequence[str] = (),
    max_categories: int = 50,
    test_percent: int = 20,
    seed: int = 42,
) -> Prepared:
    """The whole preparation: frame, cardinality cut, key-hashed split, stages fitted on the training part only.

    The complete rows are written to the shared folder once: the cut, the stages, and all that reads the training or test rows
    later start from there, not from the scans and joins behind ``df``; a row's part is worked out once, when it is written.
    """
    rows, roles = regression_frame(df, roles, min_year, boolean_codes, leakage)
    split_keys = roles.keys or roles.features + (roles.target,)
    made = {"label": F.col(roles.target).cast("double"), "__test": in_test(split_keys, test_percent, seed)}
    rows = stored(rows.withColumns(made), "prepared")
    kept = low_cardinality(rows, roles.categorical, max_categories)
    roles = roles.without(*[c for c in roles.categorical if c not in kept])
    train, test = rows.filter(~F.col("__test")).drop("__test"), rows.filter("__test").drop("__test")
    stages = Pipeline(stages=encoding_stages(roles)).fit(train)
    drop = helper_columns(roles)
    return Prepared(stages.transform(train).drop(*drop), stages.transform(test).drop(*drop), stages, roles)


def prepare_kmeans(df: DataFrame, roles: ColumnRoles) -> tuple[DataFrame, PipelineModel]:
    """All rows with a ``features`` vector of scaled numbers and encoded categories."""
    stages = Pipeline(stages=encoding_stages(roles)).fit(df)
    return stages.transform(df).drop(*helper_columns(roles)), stages


def prepare_kprototypes(df: DataFrame, roles: ColumnRoles) -> tuple[DataFrame, PipelineModel]:
    """Imputed and scaled numbers, imputed categories as text, under their own names; other columns pass through."""
    stages = []
    fills = MixedImputer(numericCols=list(roles.numeric), categoricalCols=list(roles.categorical))
    stages.append(fills)
    if roles.numeric:
        stages.append(PopulationScaler(inputCols=list(roles.numeric), outputCols=list(roles.numeric)))
    if roles.categorical:
        stages.append(CodeText(inputCols=list(roles.categorical), outputCols=list(roles.categorical)))
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df), model


def dummy_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide 0/1 columns named ``column_value``, one per value; a missing value is zero everywhere.

    The values become column names, so they are collected. For columns with very many values take the long form
    (:func:`cohortry.operators.hypothesis.long_categories`), which has one row per value instead.
    """
    text = df.select(*keep, *[code_text(c).alias(c) for c in columns])
    values = text.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    flags = [
        F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}_{v}") for c in columns for v in values[c]
    ]
    return text.select(*keep, *flags)
