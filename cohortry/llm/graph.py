"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import release, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (a, b): neighbours of ``a`` are linked to the least of them and ``a`` itself.

    The least neighbour is an aggregate with map-side combination, written out, so that the join back deals both sides
    anew and Spark can split a node with very many neighbours.
    """
    least = stored(directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star-least")
    linked = directed.join(least, "a")
    if large:  # every larger neighbour
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # rows hold smaller neighbours only; the node itself is linked too
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    done = stored(out.filter(F.col("a") != F.col("b")).distinct(), "star-edges")
    release(least)
    return done


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), the component being its least node.

    Loops and repeated edges do not matter; no edges give no rows. Every step is written to the shared folder; the driver
    sees a count and a checksum per round. Rounds end when a round changes nothing.
    """
    now = stored(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "star-edges",
    )
    mark = _fingerprint(now)
    while mark[0]:
        large = _star(_both_ways(now), True)
        release(now)
        now = _star(large, False)
        release(large)
        if mark == (mark := _fingerprint(now)):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
