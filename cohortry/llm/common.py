"""Shared helpers: Arrow slices of bounded size, words and their hashes over whole UTF-8 buffers, folders, queries.

Word hashes are 64-bit polynomial hashes over random byte values, taken for a whole buffer by one running sum, and mixed
afterwards. Equal words always have equal hashes; results that must be exact compare the words where hashes agree or
say in their docstring that they rest on 64 bits.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.session import shared_dir

#: Text bytes handled at once by array code; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session send this many rows to Python at once, where it would send more.

    Texts are long rows: Spark's default of 10,000 of them is tens of megabytes on either side of every task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for root in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_MOST_BITS = 1 << 28  # of a Bloom filter: 32 MB, whatever the number of keys


def bloom_places(key: str, bits: int) -> list[Column]:
    """Three places of a long key in a Bloom filter."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(3)]


def bloom_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of a long column as 64-bit words: 16 bits a key, or fewer beyond its largest size, where more other
    keys pass but never fewer of the right ones.

    The words are put together by an aggregation; the driver holds one filter.
    """
    bits = min(_MOST_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    places = keys.select(F.explode(F.array(*bloom_places(key, bits))).alias("at"))
    words = places.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    found = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[np.asarray(found["word"])] = np.asarray(found["bits"])
    return table.view(np.uint64)


def bloom_passes(words: np.ndarray, places: Sequence[np.ndarray]) -> np.ndarray:
    out = np.ones(len(places[0]), bool)
    for at in places:
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``limit`` text bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < n:
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
        pa.default_memory_pool().release_unused()  # Python workers live on between tasks


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def buffer_of(batch: pa.RecordBatch, column: str = "text") -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all texts of a slice (null: none) and the offsets of each."""
    parts = [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


# ---------------------------------------------------------------- words

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap`` (256 booleans); runs never cross a text's end."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    up = _powers(_BASE, len(data))
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=running[1:])
    down = _powers(_BASE_INVERSE, len(data))
    return mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes (windows across texts are included; see ``window_starts``)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] * _PLACES[0]
    for k in range(1, size):
        out = out + words[k : k + n] * _PLACES[k]
    return mixed(out + np.uint64(size))


def sequence_hash(words: np.ndarray) -> np.uint64:
    """``window_hashes`` of one whole sequence of fewer than 64 words."""
    return window_hashes(words, len(words))[0]


def word_ranges(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For texts given by byte offsets: index of each text's first word, and of the end of the last."""
    return np.searchsorted(starts, offsets)


def gap_table(inside: Sequence[int] | bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(inside)] = False
    return out


#: Space, tab, newline, vertical tab, form feed and carriage return separate words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
