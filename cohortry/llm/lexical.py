"""Ranked lexical search: short lists summed term at a time, long lists skipped document at a time.

Documents are dealt into segments of bounded size. A segment keeps, for every term of any item, the list of its documents
and how often each holds it. For one item and segment, the short lists are summed into accumulators (term at a time). The
accumulators then are one more list, bounded by their largest sum, beside the long lists, each bounded by its largest
contribution. Documents are then taken in order, window by window: those that occur in no other lists than the weakest
ones, whose bounds together cannot reach the score to beat, are skipped; what is left is looked up in the weak lists,
strongest first, and given up as soon as the rest cannot lift it to that score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cohortry.llm.common import buffer_of, gap_table, query, release, span_hashes, stored, table, text_slices, word_bounds, word_ranges
from cohortry.llm.vectors import LAST, Best, Held, batch_rows, unheld

#: Terms of items handled in one pass over the documents, 8 MB of hashes. More items are dealt into several passes.
TERMS = 1 << 20
#: A segment ends after so many documents or postings; an item block after so many terms.
SEGMENT_DOCS, SEGMENT_POSTINGS, ITEM_TERMS = 8192, 1 << 20, 1 << 16
#: Lists of at most this share of a segment's documents are summed first.
SHORT = 1 / 32
WINDOW = 1024
_HITS = "item long, score long, id long, found long"

_TERM = gap_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a slice, and each text's range among them."""
    raw, offsets = buffer_of(batch)
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    starts, ends = word_bounds(data, offsets, _TERM)
    return span_hashes(data, starts, ends).view(np.int64), word_ranges(starts, offsets)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        terms, ranges = _terms(batch)
        lists = [np.unique(terms[a:b]) for a, b in zip(ranges, ranges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(lists, pa.list_(pa.int64()))], ["item", "item_id", "terms"])


class _Postings:
    """What a segment collects of its documents."""

    def __init__(self):
        self.parts, self.ids, self.rows, self.sizes, self.postings = [], [], [], [], 0

    def add(self, terms: np.ndarray, ranges: np.ndarray, ids: np.ndarray, rows: np.ndarray, vocabulary: np.ndarray) -> None:
        sizes = np.diff(ranges)
        at = np.searchsorted(vocabulary, terms)
        at[at == len(vocabulary)] = 0
        known = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)[known] + sum(map(len, self.ids))
        pair, times = np.unique((at[known].astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64), return_counts=True)
        self.parts.append((pair, times))
        self.ids.append(ids)
        self.rows.append(rows)
        self.sizes.append(sizes)
        self.postings += len(pair)

    def docs(self) -> int:
        return sum(map(len, self.ids))

    def cells(self, vocabulary: np.ndarray) -> dict:
        pair = np.concatenate([p for p, _ in self.parts])
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], np.concatenate([t for _, t in self.parts])[order]
        code = (pair >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
        sizes = np.concatenate(self.sizes).astype(np.int64)
        out = {"docs": np.concatenate(self.ids), "rows": np.concatenate(self.rows), "sizes": sizes, "at": (pair & np.uint64(0xFFFFFFFF)).astype(np.int32), "times": times.astype(np.int32)}
        lengths = np.diff(np.append(first, len(code)))
        return {k: x.tobytes() for k, x in out.items()} | {"terms": vocabulary[code[first]], "lengths": lengths, "n": int((sizes > 0).sum()), "words": int(sizes.sum())}


_SEGMENT = "key int, docs binary, rows binary, sizes binary, at binary, times binary, terms array<long>, lengths array<long>, n long, words long"


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    many = pa.list_(pa.int64())
    types = {"key": pa.int32(), "terms": many, "lengths": many, "n": pa.int64(), "words": pa.int64()}
    schema = pa.schema([(f.split()[0], types.get(f.split()[0], pa.binary())) for f in _SEGMENT.split(", ")])
    key, held = TaskContext.get().partitionId(), _Postings()
    done = lambda: pa.RecordBatch.from_pylist([{"key": key, **held.cells(vocabulary)}], schema=schema)
    for batch in text_slices(batches):
        terms, ranges = _terms(batch)
        ids = np.asarray(pc.fill_null(batch.column("doc_id"), LAST))
        held.add(terms, ranges, ids, np.asarray(batch.column("row")), vocabulary)
        if held.docs() >= SEGMENT_DOCS or held.postings >= SEGMENT_POSTINGS:
            yield done()
            held = _Postings()
    if held.ids:
        yield done()


def _item_blocks(batches: Iterator[pa.RecordBatch], n: int, df: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Items with the weights of those of their terms that any document holds."""
    block, held, terms = 0, [], 0
    part = TaskContext.get().partitionId()

    def done():
        lists = [np.array([t for t in x if t in df], np.int64) for _, x in held]
        weights = [np.array([weight(n, df[int(t)]) for t in x], np.int64) for x in lists]
        cells = {"block": (part << 32) + block, "item": np.array([i for i, _ in held]), "sizes": np.array([len(x) for x in lists], np.int64), "term": np.concatenate(lists), "weight": np.concatenate(weights)}
        return pa.RecordBatch.from_pylist([{k: x if k == "block" else x.tobytes() for k, x in cells.items()}], schema=schema)

    for batch in batches:
        for item, x in zip(batch.column("item").to_pylist(), batch.column("terms").to_pylist()):
            held.append((item, x))
            terms += len(x)
            if terms >= ITEM_TERMS:
                yield done()
                block, held, terms = block + 1, [], 0
    if held:
        yield done()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def shares(times: np.ndarray, sizes: np.ndarray, n: int, words: int) -> np.ndarray:
    """Per posting (1000000000 * tf) div (1000 * tf + 20 * m), in whole numbers; very large tables take Python's."""
    kind = np.int64 if 50 * int(sizes.max(initial=0)) * n < 1 << 62 else object
    m = 100 - 50 + (50 * sizes.astype(kind) * n) // max(words, 1)
    tf = times.astype(kind)
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype(np.int64)


class Segment:
    def __init__(self, cells: dict, n: int, words: int):
        at = lambda c, kind=np.int64: np.frombuffer(cells[c], kind)
        self.docs, self.rows, self.at = at("docs"), at("rows"), at("at", np.int32)
        self.terms = np.asarray(cells["terms"], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(np.asarray(cells["lengths"], np.int64))])
        self.share = shares(at("times", np.int32), at("sizes")[self.at], n, words)
        self.most = np.maximum.reduceat(self.share, self.begins[:-1]) if len(self.terms) else np.empty(0, np.int64)
        self.sums = np.zeros(len(self.docs), np.int64)

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Places of the terms in this segment, -1 where it has none."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def list(self, place: int, weight: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, contributions and their largest."""
        a, b = self.begins[place], self.begins[place + 1]
        return self.at[a:b], weight * self.share[a:b], int(weight * self.most[place])

    def accumulated(self, lists: list) -> tuple[np.ndarray, np.ndarray, int]:
        """Term at a time: the lists as one, with the sums of their contributions."""
        for docs, share, _ in lists:
            self.sums[docs] += share
        docs = np.unique(np.concatenate([d for d, _, _ in lists]))
        sums = self.sums[docs]
        self.sums[docs] = 0
        return docs, sums, int(sums.max())


def rank_segment(segment: Segment, lists: list, best: Best, owner: int, short: float = SHORT, window: int = WINDOW) -> int:
    """Add the segment's documents for one item to ``best``; returns how many were scored."""
    limit, total = short * len(segment.docs), 0
    few, long_ = [x for x in lists if len(x[0]) <= limit], [x for x in lists if len(x[0]) > limit]
    if few:
        long_.append(segment.accumulated(few))
    long_.sort(key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in long_])
    places = [0] * len(long_)
    for begin in range(0, len(segment.docs), window):
        least = max(1, int(best.score[owner]))
        essential = int(np.searchsorted(reach, least))  # lists before it cannot reach the score together
        if essential == len(long_):
            break
        ends = [int(np.searchsorted(docs, begin + window)) for docs, _, _ in long_]
        sums = np.zeros(min(window, len(segment.docs) - begin), np.int64)
        for (docs, share, _), a, b in zip(long_[essential:], places[essential:], ends[essential:]):
            sums[docs[a:b] - begin] += share[a:b]
        found = np.flatnonzero(sums)
        score = sums[found]
        for k in range(essential - 1, -1, -1):
            going = score + reach[k] >= least
            found, score = found[going], score[going]
            if not len(found):
                break
            docs, share, _ = long_[k]
            docs, share = docs[places[k] : ends[k]], share[places[k] : ends[k]]
            if len(docs):
                at = np.searchsorted(docs, found + begin)
                at[at == len(docs)] = 0
                score = score + np.where(docs[at] == found + begin, share[at], 0)
        places = ends
        total += len(found)
        going = score >= least
        at = found[going] + begin
        best.add(np.full(len(at), owner), score[going], segment.docs[at], segment.rows[at])
    return total


def _ranked_segments(batches: Iterator[pa.RecordBatch], n: int, words: int, k: int) -> Iterator[pa.RecordBatch]:
    held, segments, names = Held(), Held(), [f.split()[0] for f in _HITS.split(", ")]
    for batch in batches:
        for cells in batch.to_pylist():
            segment = segments.of((cells["key"], cells["rows"][:8]), lambda c=cells: Segment(c, n, words))
            while len(segments) > 1:
                segments.popitem(last=False)
            items, sizes, term, weights = (np.frombuffer(cells[f"i_{c}"], np.int64) for c in ("item", "sizes", "term", "weight"))
            best = held.of(cells["i_block"], lambda m=len(items): Best(m, k))
            places, ends = segment.lists(term), np.cumsum(sizes)
            for owner, (begin, end) in enumerate(zip(ends - sizes, ends)):
                own = [segment.list(p, w) for p, w in zip(places[begin:end], weights[begin:end].tolist()) if p >= 0 and w > 0]
                if own:
                    rank_segment(segment, own, best, owner)
            yield best.lists(names, items, segment.rows)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 50,
    terms: int = TERMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest score above 0, ties by smaller doc_id.

    A score sums weight * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms, in whole numbers. Null and empty
    texts have no terms: such documents count nowhere, such items have no rows. A null doc_id goes last among equals.
    Rows that share an id are documents or items of their own. Empty tables give no rows; other columns are ignored. Very
    long texts are read whole, one at a time. Terms are told apart by 64-bit hashes.

    Documents are read once per ``terms`` item terms: the pass keeps the lists of terms that items have. Lists are per
    segment, so no list is ever gathered in one place; of a segment, only what beats its task's lists so far moves on.
    """
    spark = docs.sparkSession
    picked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    named = stored(picked.mapInArrow(_item_terms, "item long, item_id long, terms array<long>"), "item-terms")
    passes = max(1, -(-(named.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = None
    for part in range(passes):
        own = named.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == part) if passes > 1 else named
        vocabulary = np.sort(np.asarray(own.select(F.explode("terms").alias("t")).distinct().toArrow()["t"], dtype=np.int64))
        sent = spark.sparkContext.broadcast(vocabulary)
        segments = stored(numbered.mapInArrow(lambda b, v=sent: _segments(b, v.value), _SEGMENT), "segments")
        sent.unpersist()
        found = _of_items(segments, own, k)
        hits = found if hits is None else hits.unionAll(found)
        release(segments)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id", "found")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", unheld("id").alias("doc_id"), "score")


def _of_items(segments: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Statistics over all segments, then every block of items against every segment."""
    n, words, keys = segments.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("key"), F.lit(0)) + 1).first()
    counts = segments.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.lengths").alias("df")).toArrow()
    df = dict(zip(counts["term"].to_pylist(), counts["df"].to_pylist()))
    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("item", "sizes", "term", "weight")]])
    sent = items.sparkSession.sparkContext.broadcast(df)
    blocks = items.select("item", "terms").coalesce(1 + len(df) // ITEM_TERMS).mapInArrow(lambda b: _item_blocks(b, n, sent.value, schema), "block long, item binary, sizes binary, term binary, weight binary")
    blocks = stored(blocks, "item-blocks")
    asked = blocks.select(*[F.col(c).alias(f"i_{c}") for c in blocks.columns], F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("key"))
    with batch_rows(items.sparkSession, 2):
        # blocks are repeated for every key, which Spark's estimate does not see: never broadcast them
        found = stored(asked.hint("merge").join(segments, "key").mapInArrow(lambda b: _ranked_segments(b, n, words, k), _HITS), "segment-hits")
    release(blocks)
    sent.unpersist()
    return found


_CUT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_CUT} AS w FROM documents) WHERE len(w) > 0),
t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
q AS (SELECT DISTINCT item_id, unnest({_CUT}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), t GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50"""


@query("op12_hybrid_ranking", SQL)
def _(spark, sf):
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
