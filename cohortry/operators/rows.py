"""Row-level operators: renames, guards, filters, samples and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.columns import group_tag, hash_bucket, hash_unit
from cohortry.sources.delimited import clean_nan


def lower_names(df: DataFrame) -> DataFrame:
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError("two columns differ only by case")
    return df.toDF(*lowered)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    taken = {c.lower() for c in df.columns if c not in names}
    clash = [new for new in names.values() if new.lower() in taken]
    if clash:
        raise ValueError(f"rename would hide the columns {clash}")
    return df.withColumnsRenamed(dict(names))


def choose_level(df: DataFrame, levels: Mapping[str, str], level: str, name: str) -> DataFrame:
    """Keep one of several category columns under ``name`` and drop the others."""
    others = [c for key, c in levels.items() if key != level]
    return rename(df.drop(*others), {levels[level]: name})


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def between_open(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter((F.col(column) > low) & (F.col(column) < high))


def at_least(df: DataFrame, column: str, low) -> DataFrame:
    return df.filter(F.col(column) >= low)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null or NaN among ``columns`` (all by default)."""
    return clean_nan(df).dropna("any", subset=list(columns) if columns else None)


def split_by_codes(df: DataFrame, code: str, groups: Mapping[str, Sequence], tag: str) -> DataFrame:
    """Tag rows with their group; rows in no group leave. A missing column gives an empty result."""
    if code not in df.columns:
        return df.withColumn(tag, F.lit(None).cast("string")).filter(F.lit(False))
    return df.withColumn(tag, group_tag(code, groups)).filter(F.col(tag).isNotNull())


def sample_fraction(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A fraction of the rows that depends only on seed and key."""
    return df.filter(hash_unit(seed, *keys) < fraction)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows, or all when there are fewer: the smallest key hashes, kept by a top-n per task."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)


def train_test_split(df: DataFrame, keys: Sequence[str], test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    test = in_test(keys, test_percent, seed)
    return df.filter(~test), df.filter(test)


def in_test(keys: Sequence[str], test_percent: int = 20, seed: int = 42) -> Column:
    """Whether a row belongs to the test part, by a hash of its keys."""
    return hash_bucket(seed, 100, *keys) < test_percent


def with_fold(df: DataFrame, keys: Sequence[str], folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number from a hash that is independent of the train/test split."""
    return df.withColumn(name, hash_bucket(seed + 1, folds, *keys))


def overwrite_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})
