"""Range sharding by sampled splitters.

A sample of keys, drawn with weight by size, gives quantile boundaries that cut the key space into many narrow ranges; the
records are dealt to them, and a range of too many records is cut again by a sample of its own. Exact totals of the ranges
then place every range on the line from 0 to the whole size, and a range that straddles a shard's end (or holds more than
a shard) is cut at the exact record by a running sum. So samples decide only how even the work is, never the result's balance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from cohortry.llm.common import query, release, stored, table
from cohortry.session import local_table

_ORDER = ["__key", "__tie", "__row"]


def in_order(*parts: np.ndarray) -> np.ndarray:
    """Longs side by side as bytes that sort like the tuples."""
    flipped = np.stack([np.asarray(p, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for p in parts], axis=1)
    return flipped.astype(">u8").view(f"S{8 * len(parts)}").ravel()


def weighted_sample(rows: DataFrame, weight: Column, total: int, n: int, seed: int) -> pd.DataFrame:
    """About ``2 n`` rows of ``__range`` and the order's columns at most, each drawn with its weight of the ``total``, by exponential clocks.

    A row is drawn if its clock, at the rate of its weight, rings before ``2 n / total``; so what reaches the driver does not grow
    with rows or tasks. The clocks are hashes of the order's columns, so a retry draws the same sample.
    """
    bits = F.shiftrightunsigned(F.xxhash64(*_ORDER, F.lit(seed)), 11).cast("double")
    clock = -F.log((bits + 1) / F.lit(float(1 << 53))) / weight
    return rows.filter(clock < 2.0 * n / max(total, 1)).select("__range", *_ORDER).toArrow().to_pandas()


def range_of(splitters: np.ndarray):
    """A column function: how many of the sorted splitters are at or below (key, tie, row)."""

    @pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, in_order(key, tie, row), "right").astype(np.int32))

    return place(*_ORDER)


def quantile_splitters(sample: pd.DataFrame, parts: int) -> np.ndarray:
    """Boundaries between ``parts`` equal shares of a sample."""
    drawn = np.sort(in_order(*[sample[c] for c in _ORDER]))
    return np.unique(drawn[[int(i * len(drawn) / parts) for i in range(1, parts)]]) if len(drawn) else drawn


def cut_ranges(held: DataFrame, least: int, range_rows: int, oversample: int, seed: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The rows with ``__range``, and (range, size, rows) of every range: at least ``least`` parts, none far above ``range_rows`` rows.

    Ranges of more than twice ``range_rows`` are cut again by a sample of their own rows, all weighing the same, until there
    is none; rows differ in the order's columns, so each cut ends.
    """
    n, whole = held.agg(F.count(F.lit(1)), F.sum("__size")).first()
    parts = max(least, -(-n // range_rows))
    sample = weighted_sample(held.withColumn("__range", F.lit(0)), F.col("__size"), whole or 0, parts * oversample, seed)
    splitters = quantile_splitters(sample, parts)
    while True:
        seed += 1
        dealt = held.withColumn("__range", range_of(splitters))
        found = dealt.groupBy("__range").agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        totals = sorted((r["__range"], r["b"], r["n"]) for r in found)
        over = {r: -(-rows // range_rows) for r, _, rows in totals if rows > 2 * range_rows}
        if not over:
            return dealt, totals
        wide = local_table(held.sparkSession, {"__range": pa.int32()}, [(r,) for r in over])
        rows = dealt.join(F.broadcast(wide), "__range")  # at most one row per range
        drawn = weighted_sample(rows, F.lit(1.0), sum(k for r, _, k in totals if r in over), sum(over.values()) * oversample, seed)
        finer = [quantile_splitters(own, over[r]) for r, own in drawn.groupby("__range")]
        splitters = np.unique(np.concatenate([splitters, *finer]))


def shard_by_size(
    rows: DataFrame,
    key: Column,
    tie: Column,
    size: Column,
    shards: int = 8,
    ranges: int = 512,
    range_rows: int = 1 << 20,
    oversample: int = 32,
    seed: int = 7,
) -> DataFrame:
    """Every row with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 inside a shard); key order runs on across shards.

    ``size`` is a positive long. A row goes to the shard that holds the start of its bytes on the key-ordered line, so
    shard totals differ by less than two rows' sizes. Rows with equal key stay adjacent, and are split only where a shard
    ends. Nulls in key or tie sort first (as the least long). Rows equal in key and tie are ordered by a hash of their content;
    fully equal rows are interchangeable, and numbered when the keys are written, so that any number of them is cut into
    ranges. An empty table gives an empty result. Columns named ``shard``, ``slot`` or starting with ``__`` in ``rows`` are
    replaced.

    There are ``ranges`` ranges, or one per ``range_rows`` rows where those are more; the driver holds ``2 * oversample`` keys
    of 24 bytes (expected) and two totals for each. A range's rows are sorted within one task and can spill.
    """
    least = -(1 << 63)
    own = [c for c in rows.columns if c not in ("shard", "slot") and not c.startswith("__")]
    # the upper half of a row's number is its content's, the lower half differs between equal rows
    content = F.shiftleft(F.shiftright(F.xxhash64(*own, size), 32), 32)
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)
    keyed = rows.select(
        *own,
        F.coalesce(key.cast("long"), F.lit(least)).alias("__key"),
        F.coalesce(tie.cast("long"), F.lit(least)).alias("__tie"),
        content.bitwiseOR(number).alias("__row"),
        size.cast("long").alias("__size"),
    )
    spark = rows.sparkSession
    held = stored(keyed, "shard-keys")  # read by the sample, the totals and the placing
    dealt, totals = cut_ranges(held, ranges, range_rows, oversample, seed)
    whole = sum(b for _, b, _ in totals)
    below = np.concatenate([[0], np.cumsum([b for _, b, _ in totals])]).astype(np.int64) if totals else []
    offsets = local_table(spark, {"__range": pa.int32(), "__offset": pa.int64()}, [(r, int(at)) for (r, _, _), at in zip(totals, below)])
    # ranges go to tasks whole, one after another, each sorted once for both running sums
    order = Window.partitionBy("__range").orderBy(*_ORDER)
    before = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(offsets), "__range")  # one row per range
    placed = placed.withColumn("__at", F.col("__offset") + before).withColumn("__n", F.row_number().over(order))
    shard = F.least(F.floor(F.col("__at").cast("decimal(38,0)") * shards / F.lit(max(whole, 1)).cast("decimal(38,0)")), F.lit(shards - 1))
    placed = placed.withColumn("shard", shard.cast("int"))
    # slots: rows of a shard before the range, known once each range's rows per shard are counted
    counted = stored(placed, "shard-rows")
    release(held)
    per = counted.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("n"), F.min("__n").alias("first")).collect()
    base: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}
    for r in sorted(per, key=lambda r: (r["shard"], r["__range"])):
        base.append((r["shard"], r["__range"], seen.get(r["shard"], 0) - r["first"]))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    bases = local_table(spark, {"shard": pa.int32(), "__range": pa.int32(), "__base": pa.int64()}, base)
    slots = counted.join(F.broadcast(bases), ["shard", "__range"])  # at most ranges + shards rows
    return slots.select(*own, "shard", (F.col("__n") + F.col("__base")).alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Documents in shards of near-equal bytes (the ``bytes`` law), equal texts side by side.

    The size of a document is the UTF-8 length of its text (null: none) plus 1. The key is a hash of the text and the tie
    the id, so the ranges of a large group of copies are cut inside the group, also where ids are null or repeated. A text of any
    length weighs only its bytes. Returns doc_id, size, text_crc32, law,
    shard, slot, grown_shard (null under this law).
    """
    text = F.encode(docs[text_col].cast("string"), "UTF-8")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(b""))).alias("text_key"),
    )
    out = shard_by_size(rows, F.col("text_key"), F.col("doc_id"), F.col("size"), shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op2_sampled_splitters")
def _(spark, sf):
    return shard_documents(table(spark, sf, "documents"))
