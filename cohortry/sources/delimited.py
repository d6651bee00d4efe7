"""Delimited text: scans with declared columns, report sinks, and the header audit."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortry.functions.columns import decimal_comma, null_if_nan, to_double, to_long

LATIN1 = "ISO-8859-1"


def _open(path: str):
    """A byte stream of a file as Spark names it; local files and every store that Arrow knows by its scheme."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@%"))
    return store.open_input_stream(inner)


def first_lines(sources: Sequence[DataFrame], encoding: str) -> list[tuple[str, str, str]]:
    """(source, file, line): the first line that is not blank of every file, in name order.

    ``sources`` come from :func:`_files_of`. Tasks open the files and read no further than that line; all are one job.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for source, path in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as stream, io.TextIOWrapper(stream, encoding=encoding, errors="replace") as text:
                    line = next((line for line in text if line.strip()), None)
                if line is not None:
                    found.append((source, path, line.rstrip("\n")))
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["source", "file", "line"])

    files = reduce(DataFrame.unionByName, sources)
    return sorted(tuple(r) for r in files.mapInArrow(heads, "source string, file string, line string").collect())


def _files_of(spark: SparkSession, name: str, path: str | Sequence[str]) -> DataFrame:
    """(source, path) of the files of a path, glob or list that hold anything; their content is not read."""
    found = spark.read.format("binaryFile").load(path).filter("length > 0")
    return found.select(F.lit(name).alias("source"), "path")


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Mapping[str, str],
    sep: str = ";",
    encoding: str = LATIN1,
) -> DataFrame:
    """Scan ``path`` (a glob or a list) and keep the declared columns, each cast without raising.

    Columns are found by header name in every file, so files may order them differently and hold others besides; a
    file that lacks one stops the scan. ``columns`` maps a name to ``string``, ``double``, ``bigint`` or ``int``.
    """
    options = {"header": True, "sep": sep, "encoding": encoding, "enforceSchema": False}
    by_line: dict[str, list[str]] = {}
    for _, file, line in first_lines([_files_of(spark, "", path)], encoding):
        by_line.setdefault(line, []).append(file)
    parts = []
    for files in by_line.values():
        header = spark.read.options(**options).csv(files[0]).columns  # once for every distinct header
        missing = [c for c in columns if c not in header]
        if missing:
            raise ValueError(f"{files[0]} lacks the columns {missing}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(spark.read.options(**options).schema(schema).csv(files))
    if not parts:
        raise ValueError(f"no files at {path}")
    casts = {
        "string": lambda c: F.col(c),
        "double": to_double,
        "bigint": to_long,
        "int": lambda c: to_long(c).cast("int"),
    }
    return reduce(DataFrame.unionByName, [p.select(*[casts[kind](f"`{name}`").alias(name) for name, kind in columns.items()]) for p in parts])


def write_report(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


def locale_text(df: DataFrame) -> DataFrame:
    """Floating-point columns as text with a decimal comma."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.translate(F.col(f"`{f.name}`").cast("string"), ".", ",").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def write_locale_report(df: DataFrame, path: str) -> None:
    write_report(locale_text(df), path, sep=";")


def read_locale_report(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    text = read_delimited(spark, path, {c: "string" for c in columns}, sep=";", encoding="UTF-8")
    pick = {"double": decimal_comma, "bigint": to_long, "int": lambda c: to_long(c).cast("int"), "string": F.col}
    return text.select(*[pick[kind](f"`{c}`").alias(c) for c, kind in columns.items()])


def header_report(spark: SparkSession, expected: Mapping[str, tuple[str, Sequence[str]]], encoding: str = LATIN1) -> DataFrame:
    """One row per file of every named source: delimiter, columns found, and expected columns that are missing.

    ``expected`` maps a name to (path, column names). Only first lines are read, those of all files in one job. The
    delimiter is the one of ``;`` and ``,`` that the line holds more of, and alone splits it. A path without files is one
    row with ``exists = false``.
    """
    sources, rows = [], []
    for name, (path, _) in expected.items():
        try:
            sources.append(_files_of(spark, name, path))
        except Exception as error:  # the analyser reports a missing path
            if "PATH_NOT_FOUND" not in str(error):
                raise
    found = first_lines(sources, encoding) if sources else []
    for name, file, line in found:
        sep = ";" if line.count(";") > line.count(",") else ","
        # a byte-order mark shows as itself or as its latin1 reading
        columns = [c.strip().strip('"').removeprefix("\ufeff").removeprefix("ï»¿").strip('"') for c in line.split(sep)]
        missing = [c for c in expected[name][1] if c not in columns]
        rows.append((name, file, True, sep, columns, missing, len(columns)))
    there = {name for name, _, _ in found}
    rows += [(name, None, False, None, None, list(columns), None) for name, (_, columns) in expected.items() if name not in there]
    return spark.createDataFrame(
        rows, "source string, file string, exists boolean, delimiter string, columns array<string>, missing array<string>, n_columns int"
    )


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column (done once, at ingestion)."""
    return df.withColumns(
        {
            f.name: null_if_nan(f"`{f.name}`").cast(f.dataType)
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        }
    )
