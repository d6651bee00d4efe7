"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN_FOLDERS: dict[str, str] = {}  # by application, where no shared folder is named


def build_session(app: str = "cohortry", **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    Master, memory and shuffle width are left to the caller (``spark-submit`` or ``conf``).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on this machine alone (tests) gets a temporary folder of its own; on a cluster that
    folder would be out of reach of the others, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="cohortry-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back, which cuts the lineage and survives lost executors.

    With ``by``, rows of one value of that column (a few values) lie in a folder of their own, and a filter on it reads no other.
    """
    path = shared_dir(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most so many rows to Python at once; the session's setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def local_table(spark: SparkSession, schema: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A few rows known to the driver, as a relation inside the plan (no job, no Python rows)."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, schema.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(schema)))


@contextmanager
def cached(df: DataFrame, spread: bool = False) -> Iterator[DataFrame]:
    """The frame persisted (memory, then disk) for several passes, and released afterwards; lost blocks are computed again.

    ``spread`` keeps the partitions of its last shuffle, which Spark would else put together by their bytes: for passes that
    cost much more than reading.
    """
    name = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"  # read when the frame is persisted
    before = df.sparkSession.conf.get(name)
    try:
        if spread:
            df.sparkSession.conf.set(name, "false")
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        df.sparkSession.conf.set(name, before)
    try:
        yield kept
    finally:
        kept.unpersist()
