"""Exact top-k search by inner product over norm buckets.

Candidates are sorted by length and packed into buckets. For a query q with the score s to beat, a bucket whose longest
vector has length l can hold a better one only at a cosine of s / (|q| l) or more, the bucket's local threshold. Above 1,
this bucket and all shorter ones are passed over; where it is high, the query's largest coordinates leave narrow ranges
that a candidate's unit vector must lie in (coordinate pruning, on sorted coordinates); elsewhere the bucket is read down
to the length s / |q| (length pruning). What is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.common import query, release, stored, table
from cohortry.llm.vectors import BLOCK_ROWS, LAST, LEAST, PAIRS, Best, Block, Held, batch_rows, packed, products, unheld, whole_vectors

#: Bounds in floating point are loosened by this share, so rounding never passes over a vector.
_SLACK = 1e-9
#: Coordinates looked at, and the local threshold from which they prune more than they cost.
FOCUS, COORDINATES_FROM = 4, 0.7
#: Candidates of the longest buckets, against which every query is scored first.
HEAD = 4096
_QUERY_ROWS = 256
_MOST_KEYS = 4096
_HITS = "query long, score long, id long, found long"


class Bucket(Block):
    """A block sorted by falling length."""

    @staticmethod
    def of(block: Block) -> Bucket:
        order = np.lexsort((block["id"], -block.norm))
        return Bucket(block.v[order], block.norm[order], {k: x[order] for k, x in block.numbers.items()})

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._as:
            column = self.unit()[:, f]
            order = np.argsort(column, kind="stable")
            self._as[f] = order, column[order]
        return self._as[f]

    def within(self, unit: np.ndarray, cosine: float, focus: int) -> np.ndarray:
        """The candidates whose largest coordinates of ``unit`` allow a cosine of at least ``cosine``."""
        top = np.argsort(-np.abs(unit))[:focus]
        spread = np.arccos(np.clip(cosine, -1, 1))
        angle = np.arccos(np.clip(unit[top], -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + spread)) - _SLACK, np.cos(np.maximum(0, angle - spread)) + _SLACK
        ranges = []
        for f, a, b in zip(top, low, high):
            order, values = self.sorted_by(int(f))
            i, j = np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")
            ranges.append((j - i, order[i:j]))
        found = min(ranges, key=lambda x: x[0])[1]
        coordinates = self.unit()[np.ix_(found, top)]
        return np.sort(found[((coordinates >= low) & (coordinates <= high)).all(axis=1)])


def search_bucket(queries: Block, bucket: Bucket, best: Best, coordinates_from: float = COORDINATES_FROM, focus: int = FOCUS) -> None:
    """Add to ``best`` what the bucket holds for the queries."""
    longest = bucket.norm[0]
    least = best.score.astype(np.float64)
    at_best = queries.norm * longest
    cosine = np.where(least > 0, least / np.where(at_best > 0, at_best, 1.0), -1.0)
    cosine[(least > 0) & (at_best == 0)] = 2.0
    open_ = cosine <= 1 + _SLACK
    width = min(queries.v.shape[1], bucket.v.shape[1])
    by_coordinate = open_ & (cosine >= coordinates_from) & (0 < width == queries.v.shape[1])  # all coordinates are there
    for q in np.flatnonzero(by_coordinate):
        found = bucket.within(queries.unit()[q], float(cosine[q]) * (1 - _SLACK), focus)
        if len(found):
            _verify(queries, bucket, best, np.array([q]), found)
    by_length = np.flatnonzero(open_ & ~by_coordinate)
    if len(by_length):
        needed = np.where(least > 0, least / np.where(queries.norm > 0, queries.norm, 1.0), 0.0)[by_length]
        reach = np.searchsorted(-bucket.norm, -needed * (1 - _SLACK), "right")
        _verify(queries, bucket, best, by_length, slice(0, int(reach.max())))


def _verify(queries: Block, bucket: Bucket, best: Best, rows: np.ndarray, columns: np.ndarray | slice) -> None:
    scores = products(queries, bucket, rows, columns)
    ids, own = bucket["id"][columns], bucket["row"][columns]
    if scores.shape[1] > best.k and (loose := best.score[rows] == LEAST).any():  # a row's own k-th score bounds what is kept
        kth = np.partition(scores, -best.k - 1, axis=1)[:, -best.k - 1]
        floor = np.where(loose, kth, LEAST)
    else:
        floor = np.full(len(rows), LEAST)
    q, c = np.nonzero((scores >= np.maximum(best.score[rows], floor)[:, None]) & (own != queries["row"][rows][:, None]))
    best.add(rows[q], scores[q, c], ids[c], own[c])


def _searched(batches: Iterator[pa.RecordBatch], k: int, coordinates_from: float, focus: int) -> Iterator[pa.RecordBatch]:
    held, names = Held(), [f.split()[0] for f in _HITS.split(", ")]
    buckets = Held()
    for batch in batches:
        for cells in batch.to_pylist():
            queries = Block.read(cells, ["row", "least", "least_id"], "q_")
            bucket = buckets.of((cells["key"], cells["row"][:16]), lambda c=cells: Bucket.of(Block.read(c, ["row", "id"])))
            while len(buckets) > 2:
                buckets.popitem(last=False)
            best = held.of(bytes(queries["row"][:1]), lambda q=queries: Best(len(q), k, q["least"], q["least_id"]))
            search_bucket(queries, bucket, best, coordinates_from, focus)
            yield best.lists(names, queries["row"], bucket["row"])


def _hits(queries: DataFrame, buckets: DataFrame, k: int, coordinates_from: float, focus: int) -> DataFrame:
    """Blocks of queries, each with the keys of the buckets it has to see, against those buckets."""
    pairs = queries.join(buckets, "key")
    return pairs.mapInArrow(lambda b: _searched(b, k, coordinates_from, focus), _HITS)


def _query_blocks(rows: DataFrame) -> DataFrame:
    reach = lambda b: float(np.min(np.where(b["least"] > 0, b["least"] / np.where(b.norm > 0, b.norm, np.inf), -1.0)))
    out = packed(rows, ["row", "least", "least_id"], {"reach": ("double", reach)}, most=_QUERY_ROWS)
    return out.select(*[F.col(c).alias(f"q_{c}") for c in out.columns])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "found")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    factor: float = 64.0,
    k: int = 20,
    coordinates_from: float = COORDINATES_FROM,
    focus: int = FOCUS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` selects, the k other rows of highest product.

    Components are floor(factor * x); products are exact integers; equal scores go by smaller id, null ids last. Vectors
    that are null or hold a null or non-finite component take no part; an empty vector scores 0 with all, and components
    that one of two vectors lacks count as 0. A row with a null id is a candidate, and a query only if ``is_query`` is true
    for it. Rows that share an id are rows of their own: each is answered, and each may find the others. Fewer than k
    other rows give all of them; an empty table gives no rows. Other columns are ignored. A scaled component of more than
    32 bits or a product of more than 64 is an error.

    Queries meet buckets in blocks of 256 and up to 2,048 rows: first the longest ``HEAD`` candidates, which give every
    query a score to beat, then each bucket that some query of the block can still gain from.
    """
    spark = rows.sparkSession
    picked = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    whole = whole_vectors(picked, F.col("v"), factor, id=F.col("id"), asks=F.col("asks").cast("int"))
    keys = max(1, min(_MOST_KEYS, -(-whole.count() // BLOCK_ROWS)))
    by_length = whole.repartitionByRange(keys, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    buckets = stored(packed(by_length, ["row", "id"], {"top": ("double", lambda b: float(b.norm.max()))}), "norm-buckets")
    tops = sorted((r["top"], r["n"], r["key"]) for r in buckets.groupBy("key").agg(F.max("top").alias("top"), F.sum("n").alias("n")).collect())[::-1]
    before = np.cumsum([0, *(n for _, n, _ in tops)])
    head = [key for (_, _, key), n in zip(tops, before) if n < HEAD] or [0]
    asking = whole.filter("asks = 1").withColumns({"least": F.lit(int(LEAST)), "least_id": F.lit(int(LAST))})
    keyed = F.explode(F.array(*map(F.lit, head))).alias("key")
    with batch_rows(spark, PAIRS):
        first = stored(_hits(_query_blocks(asking).select("*", keyed), buckets, k, coordinates_from, focus), "head-hits")
        kth = _ranked(first, k).filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("s"), F.col("id").alias("i"))
        known = asking.join(kth, "row", "left").withColumns({"least": F.coalesce("s", "least"), "least_id": F.coalesce("i", "least_id")})
        blocks = known.repartitionByRange(keys, F.try_divide("least", "norm"), "row")
        rest = [(t, key) for t, _, key in tops if key not in set(head)]
        if rest:
            seen = F.filter(F.array(*[F.struct(F.lit(t).alias("top"), F.lit(key).alias("key")) for t, key in rest]), lambda x: x["top"] * (1 + _SLACK) >= F.col("q_reach"))
            asked = _query_blocks(blocks).select("*", F.explode(seen).alias("x")).select("*", F.col("x.key").alias("key")).drop("x")
            second = stored(_hits(asked, buckets, k, coordinates_from, focus), "bucket-hits")
            first = first.unionAll(second)
    named = whole.filter("asks = 1").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    out = _ranked(first, k).join(named, "query").select("query_id", "rank", unheld("id").alias("vec_id"), "score")
    release(buckets)
    return out


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_SOUND}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


@query("op13_norm_buckets", SQL)
def _(spark, sf):
    return top_products(table(spark, sf, "embeddings"), F.expr("vec_id % 20 = 0"))
