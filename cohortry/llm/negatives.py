"""Hard negatives by shared lists of anchor clusters, walked until nothing better can come.

Anchors are clustered by direction. For a cluster with centre c and radius r (the largest angle of a member to c), no
member's product with a candidate x can be above |u| |x| cos(max(0, angle(x, c) - r)). Candidates sorted by that bound
make one list for the whole cluster; a member reads it from the top and is done, with a proof, once the bound falls below
what it still needs. The list is kept in pieces, one for each block of candidates, whose heads tell the order of the
pieces: the first pieces give every member something to beat, and later ones are met only by blocks of members that
their heads can still serve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.common import query, release, stored, table
from cohortry.llm.vectors import BLOCK_ROWS, LAST, LEAST, PAIRS, Best, Block, Held, batch_rows, matrix_of, packed, products, unheld, whole_vectors
from cohortry.session import local_table

#: Anchors that the cluster centres are fitted on, by a hash of the row, and clusters.
SAMPLE, CLUSTERS = 4096, 32
#: Rows of a cluster's list that its members read first, and entries read between two looks at the bound.
HEAD, STEP = 4096, 256
_ANCHOR_ROWS = 128
_MOST_KEYS = 4096
_SLACK = 1e-6
_HITS = "anchor long, slot long, score long, id long, found long"


def _directions(v: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(v), width))
    out[:, : min(width, v.shape[1])] = v[:, :width]
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    return out / np.where(norm > 0, norm, 1.0)[:, None]


def fit_centres(v: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of a bounded sample by spherical k-means, begun at rows far from each other."""
    unit = _directions(v, v.shape[1])
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(clusters, len(unit)) and nearest.min() < 1 - _SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums**2).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    return centres


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_directions(v, centres.shape[1]) @ centres.T, -1, 1))


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angles = _angles(matrix_of(batch.column("v")), centres)
        own = angles.argmin(axis=1)
        more = [pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cluster", "angle"])


def bounds(block: Block, centre: np.ndarray, radius: float) -> np.ndarray:
    """What a member of length 1 can score at most with each candidate; a zero vector scores zero with all."""
    angle = _angles(block.v, centre[None])[:, 0]
    return block.norm * (np.cos(np.maximum(0, angle - radius - _SLACK)) + 1e-9)


def walk(anchors: Block, candidates: Block, order: np.ndarray, bound: np.ndarray, take, needs) -> int:
    """Read the candidates in ``order``; members leave when ``needs()`` (by anchor) is above what the list still offers.

    ``take(members, columns)`` scores candidates for members. Returns the entries read, summed over the members.
    """
    read = 0
    for begin in range(0, len(order), STEP):
        offered = anchors.norm * bound[order[begin]]
        offered += np.abs(offered) * 1e-9
        members = np.flatnonzero(needs() <= offered)
        if not len(members):
            break
        columns = order[begin : begin + STEP]
        take(members, columns)
        read += len(members) * len(columns)
    return read


def _positives(anchors: Block, candidates: Block, best: Best):
    def take(members, columns):
        scores = products(anchors, candidates, members, columns)
        fits = (anchors["label"][members][:, None] == candidates["label"][columns]) & (anchors["row"][members][:, None] != candidates["row"][columns])
        fits &= scores >= best.score[members][:, None]
        a, c = np.nonzero(fits)
        best.add(members[a], scores[a, c], candidates["id"][columns[c]], candidates["row"][columns[c]])

    return take, lambda: np.where(best.score > LEAST, best.score.astype(np.float64), -np.inf)


def _negatives(anchors: Block, candidates: Block, best: Best, slots: int):
    caps = np.stack([anchors[f"cap{i}"] for i in range(slots)], axis=1)
    floors = np.stack([anchors[f"floor{i}"] for i in range(slots)], axis=1)
    used = (caps != LAST) & (floors <= caps)

    def take(members, columns):
        scores = products(anchors, candidates, members, columns)
        other = anchors["label"][members][:, None] != candidates["label"][columns]
        for slot in range(slots):
            owners = members * slots + slot
            least = np.maximum(floors[members, slot], best.score[owners])
            fits = other & used[members, slot][:, None] & (scores <= caps[members, slot][:, None]) & (scores >= least[:, None])
            a, c = np.nonzero(fits)
            best.add(owners[a], scores[a, c], candidates["id"][columns[c]], candidates["row"][columns[c]])

    def needs():
        least = np.where(used, np.maximum(floors, best.score.reshape(-1, slots)).astype(np.float64), np.inf)
        return least.min(axis=1)

    return take, needs


def _walked(batches: Iterator[pa.RecordBatch], centres: np.ndarray, k: int, slots: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Positives where there are no slots, else negatives of each slot."""
    held, wide = Held(), max(1, slots)
    schema = [f.split()[0] for f in _HITS.split(", ")]
    for batch in batches:
        for cells in batch.to_pylist():
            anchors, candidates = Block.read(cells, names, "a_"), Block.read(cells, ["row", "id", "label"])
            centre = centres[cells["a_cluster"]]

            def begun(a=anchors):
                least = np.stack([a[f"s{i}"] for i in range(wide)], axis=1).ravel()
                ids = np.stack([a[f"i{i}"] for i in range(wide)], axis=1).ravel()
                return Best(len(a) * wide, k, np.where(least == LAST, LEAST, least), ids)

            best = held.of(bytes(anchors["row"][:1]), begun)
            bound = bounds(candidates, centre, float(_angles(anchors.v, centre[None]).max()))
            take, needs = _negatives(anchors, candidates, best, slots) if slots else _positives(anchors, candidates, best)
            walk(anchors, candidates, np.argsort(-bound, kind="stable"), bound, take, needs)
            owner, score, id, row = best.entries
            own = np.isin(row, candidates["row"])
            columns = [anchors["row"][owner[own] // wide], owner[own] % wide, score[own], id[own], row[own]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "found")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Lists:
    """The candidates in blocks of like direction, and the order in which each cluster reads them."""

    def __init__(self, placed: DataFrame, anchors: DataFrame, centres: np.ndarray, keys: int):
        self.spark, self.centres, self.keys = placed.sparkSession, centres, keys
        radius = np.zeros(len(centres))
        for r in anchors.groupBy("cluster").agg(F.max("angle").alias("r")).collect():
            radius[r["cluster"]] = r["r"]
        tops = lambda b: [float(bounds(b, c, r).max()) for c, r in zip(centres, radius)]
        near = placed.repartitionByRange(keys, "cluster", "angle", "row").sortWithinPartitions("cluster", "angle", "row")
        self.blocks = stored(packed(near, ["row", "id", "label"], {"tops": ("array<double>", tops)}), "anchor-lists")
        each = self.blocks.select("key", "n", F.posexplode("tops").alias("cluster", "top"))
        of_key = each.groupBy("cluster", "key").agg(F.max("top").alias("top"), F.sum("n").alias("n")).collect()
        self.head, self.rest = [], []  # at most clusters x keys pairs
        by_cluster: dict[int, list] = {}
        for r in of_key:
            by_cluster.setdefault(r["cluster"], []).append((r["top"], r["key"], r["n"]))
        for cluster, pieces in by_cluster.items():
            read = 0
            for top, key, n in sorted(pieces, reverse=True):
                (self.head if read < HEAD else self.rest).append((cluster, key, top))
                read += n

    def walked(self, anchors: DataFrame, pieces: list, k: int, slots: int) -> DataFrame:
        """Hits of the anchors in those pieces of their cluster's list that can still serve one of their block."""
        wide = max(1, slots)
        names = ["row", "label", *[f"{x}{i}" for x in ("s", "i") for i in range(wide)], *[f"{x}{i}" for x in ("cap", "floor") for i in range(slots)]]

        def reach(b: Block) -> float:
            best = Best(len(b) * wide, k, *[np.stack([b[f"{x}{i}"] for i in range(wide)], axis=1).ravel() for x in "si"])
            best.score[best.score == LAST] = LEAST
            needs = (_negatives(b, b, best, slots) if slots else _positives(b, b, best))[1]()
            return float(np.min(np.where(b.norm > 0, needs / np.where(b.norm > 0, b.norm, 1.0), np.where(needs <= 0, -np.inf, np.inf))))

        cluster = lambda b: int(b["cluster"][0])
        near = anchors.repartitionByRange(self.keys, "cluster", "angle", "row").sortWithinPartitions("cluster", "angle", "row")
        extra = {"reach": ("double", reach), "group": ("int", cluster)}
        blocks = packed(near, [*names, "cluster"], extra, group="cluster", most=_ANCHOR_ROWS).drop("key", "cluster")
        blocks = blocks.select(*[F.col(c).alias(f"a_{'cluster' if c == 'group' else c}") for c in blocks.columns])
        kinds = {"a_cluster": pa.int32(), "key": pa.int32(), "head": pa.float64()}
        asked = blocks.join(local_table(self.spark, kinds, pieces), "a_cluster")
        can_serve = lambda head: head + F.abs(head) * 1e-8 >= F.col("a_reach")
        pairs = asked.filter(can_serve(F.col("head"))).drop("head").join(self.blocks, "key").filter(can_serve(F.expr("tops[a_cluster]"))).drop("tops")
        with batch_rows(self.spark, PAIRS):
            return stored(pairs.mapInArrow(lambda b, c=self.centres: _walked(b, c, k, slots, names), _HITS), "anchor-hits")

    def found(self, anchors: DataFrame, k: int, slots: int) -> DataFrame:
        """The k best of each anchor and slot over the whole list."""
        wide = max(1, slots)
        empty = {f"s{i}": F.lit(int(LEAST)) for i in range(wide)} | {f"i{i}": F.lit(int(LAST)) for i in range(wide)}
        hits = self.walked(anchors.withColumns(empty), self.head, k, slots)
        if self.rest:
            full = _ranked(hits, k).filter(F.col("rank") == k).groupBy(F.col("anchor").alias("row")).agg(
                *[F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{x}{i}") for x, c in (("s", "score"), ("i", "id")) for i in range(wide)]
            )
            known = {f"s{i}": F.coalesce(f"s{i}", F.lit(int(LEAST))) for i in range(wide)} | {f"i{i}": F.coalesce(f"i{i}", F.lit(int(LAST))) for i in range(wide)}
            hits = hits.unionAll(self.walked(anchors.join(full, "row", "left").withColumns(known), self.rest, k, slots))
        return _ranked(hits, k)


def mine_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    factor: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    clusters: int = CLUSTERS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row that ``is_anchor`` selects, its first ``positives`` other rows of the same label; for each of those, the
    first ``negatives`` rows of another label whose score is at most the positive's and at least ``least_percent`` hundredths
    of it. Scores are exact inner products of floor(factor * x); higher ones come first, equal ones by smaller id, null ids
    last. Rows with a null label, a null vector, or a null or non-finite component take no part; an empty vector scores 0.
    Positives of negative score have no negatives. Rows that share an id are rows of their own. Anchors without a positive,
    or positives without a negative, give no rows, as does an empty table. Other columns are ignored. A scaled component of
    more than 32 bits or a score of more than 64 is an error.

    Centres are fitted on at most about ``SAMPLE`` anchors, chosen by a hash; every row is in the lists.
    """
    picked = rows.filter(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), is_anchor.alias("anchor")
    )
    numbers = {"id": F.col("id"), "label": F.col("label"), "anchor": F.coalesce(F.col("anchor").cast("int"), F.lit(0))}
    whole = whole_vectors(picked, F.col("v"), factor, **numbers)
    count, asking = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("anchor"), F.lit(0))).first()
    hashed = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(max(1, (SAMPLE << 20) // max(asking, 1)))
    sample = whole.filter((F.col("anchor") == 1) & hashed).select("v").toArrow()
    v = matrix_of(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((1, 1), np.int32)
    centres = fit_centres(v if v.shape[1] else np.zeros((1, 1), np.int32), clusters)
    placed = stored(whole.mapInArrow(lambda b: _placed(b, centres), f"{whole._jdf.schema().toDDL()}, cluster int, angle double"), "placed-vectors")
    anchors = placed.filter("anchor = 1").drop("anchor", "id")
    lists = _Lists(placed, anchors, centres, max(1, min(_MOST_KEYS, -(-count // BLOCK_ROWS))))
    first = stored(lists.found(anchors, positives, 0).select("anchor", F.col("rank").alias("slot"), "id", "score"), "positives")
    slot = lambda i, c: F.max(F.when(F.col("slot") == i + 1, c))
    floor = F.ceil(F.lit(least_percent).cast("decimal(20,0)") * F.col("score") / F.lit(100)).cast("long")
    caps = first.groupBy(F.col("anchor").alias("row")).agg(
        *[slot(i, F.col("score")).alias(f"cap{i}") for i in range(positives)], *[slot(i, floor).alias(f"floor{i}") for i in range(positives)]
    )
    found = lists.found(anchors.join(caps, "row"), negatives, positives).withColumn("slot", F.col("slot") + 1)
    named = whole.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pair = first.select("anchor", "slot", unheld("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("anchor", "slot", "rank", unheld("id").alias("negative_id"), F.col("score").alias("negative_score"))
    release(lists.blocks)
    return out.join(pair, ["anchor", "slot"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


_SOUND = "embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_SOUND}),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.l = c.l AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT a AS anchor_id, p AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 80 * ps <= 100 * score AND score <= ps
WINDOW w AS (PARTITION BY a, p ORDER BY score DESC, c) QUALIFY row_number() OVER w <= 5"""


@query("op11_anchor_lists", SQL)
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", label), F.expr("vec_id % 100 = 0"))
