"""Snapshots, parameter files and fitted models."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_snapshot(df: DataFrame, path: str, by: str) -> None:
    """Parquet, one folder per group; rows stay in the partition that made them, so no group is gathered."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"snapshot {path} lacks the columns {missing}")
    if df.isEmpty():
        raise ValueError(f"snapshot {path} is empty")
    return df


def read_tagged_csv(spark: SparkSession, paths: Mapping[str, str], tag: str, schema) -> DataFrame:
    """One CSV per group, tagged with the group's name and stacked by column name."""
    parts = [spark.read.schema(schema).option("header", True).csv(p).withColumn(tag, F.lit(name)) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def params_frame(spark: SparkSession, rows: Sequence[tuple[str, str, Mapping]]) -> DataFrame:
    """Rows of (model, group, parameters as JSON text)."""
    data = [(m, g, json.dumps(dict(p), sort_keys=True)) for m, g, p in rows]
    return spark.createDataFrame(data, "model string, grp string, params string")


def write_params(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, model: str, group: str) -> dict | None:
    """Parameters stored for one model and group, or None when there are none."""
    try:
        df = spark.read.schema("model string, grp string, params string").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    row = df.filter((F.col("model") == model) & (F.col("grp") == group)).orderBy("params").first()
    return json.loads(row["params"]) if row else None


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.text(f"{path}/metadata").isEmpty()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def load_first_model(spark: SparkSession, candidates: Sequence[str], loader=PipelineModel.load):
    """(model, path) of the first candidate that exists, or (None, None)."""
    for path in candidates:
        if _exists(spark, path):
            return loader(path), path
    return None, None


def load_model_with_features(spark: SparkSession, model_paths: Sequence[str], feature_path: str):
    """A model is only usable with its feature stage: (None, None) unless both are found."""
    model, _ = load_first_model(spark, model_paths)
    features, _ = load_first_model(spark, [feature_path])
    return (model, features) if model is not None and features is not None else (None, None)
