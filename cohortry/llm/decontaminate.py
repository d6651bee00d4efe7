"""Benchmark decontamination by a prefix-filtered set join with exact confirmation.

A window (ten consecutive item words, or a whole shorter item) is contained in a text only if every shingle of it is, so
its necessary prefix is one token: the shingle that is rarest over *all* documents. Documents are joined on that token
alone; a match is kept if the window fits between the text's first and last word around it (positional and length
bounds) and is then confirmed word by word.

The benchmark is handled in blocks of bounded size, whatever its whole size: a block is broadcast to the tasks, and
documents pass through one Arrow step per block that adds its hits, without any shuffle of texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from cohortry.llm.common import buffer_of, gap_table, query, release, span_hashes, stored, table, text_slices, window_hashes, word_bounds, word_ranges

WINDOW = 10  # words; the contract's value
_SHINGLE = 3  # words of the tokens that are joined on; shorter windows use their own length
_BLOCK_BYTES = 1 << 20  # benchmark text in one block on average: about 50 MB of Python objects in each task
# fixed values of the contract: word bytes are 0-9, a-z after folding A-Z, and every non-ASCII byte
_INSIDE = gap_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Words:
    """The words of all texts of a slice."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ranges: np.ndarray  # of each text, in words

    def window(self, first: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.raw[self.starts[k] : self.ends[k]] for k in range(first, first + n))


def words_of(batch: pa.RecordBatch, column: str = "text") -> Words:
    raw, offsets = buffer_of(batch, column)
    raw = raw.lower()  # bytes.lower folds A-Z only
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data, offsets, _INSIDE)
    return Words(raw, starts, ends, span_hashes(data, starts, ends), word_ranges(starts, offsets))


@dataclass
class Block:
    """Windows of some items: by full hash their words and items, and later by their rarest shingle."""

    words: dict[int, tuple[bytes, ...]] = field(default_factory=dict)
    items: dict[int, set[str]] = field(default_factory=lambda: defaultdict(set))
    shingles: dict[int, np.ndarray] = field(default_factory=dict)
    by_token: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def add(self, item: str, words: Words, first: int, stop: int) -> None:
        n = min(WINDOW, stop - first)
        for at in range(first, stop - n + 1) if n else ():
            own = words.hashes[at : at + n]
            key = int(window_hashes(own, n)[0])
            self.words[key] = words.window(at, n)
            self.items[key].add(item)
            self.shingles[key] = window_hashes(own, min(_SHINGLE, n))

    def widths(self) -> list[int]:
        return sorted({min(_SHINGLE, len(w)) for w in self.words.values()})

    def tokens(self) -> np.ndarray:
        return np.unique(np.concatenate(list(self.shingles.values())))

    def choose(self, counts: dict[int, int]) -> None:
        """Each window's necessary token: its rarest shingle, ties to the lower hash."""
        for key, own in self.shingles.items():
            at = min(range(len(own)), key=lambda i: (counts.get(int(own[i]), 0), int(own[i])))
            self.by_token[int(own[at])].append((key, at))
        self.shingles = {}


class _Known:
    """Membership of 64-bit hashes in a fixed set: a bit table first, then a binary search."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.sort(tokens)
        self.bits = max(12, int(len(tokens) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[tokens & np.uint64((1 << self.bits) - 1)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the known hashes."""
        maybe = np.flatnonzero(self.table[hashes & np.uint64((1 << self.bits) - 1)])
        at = np.minimum(np.searchsorted(self.tokens, hashes[maybe]), len(self.tokens) - 1)
        return maybe[self.tokens[at] == hashes[maybe]]


def _shingle_hits(words: Words, width: int, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word position, hash and text of every known shingle that lies inside one text."""
    hashes = window_hashes(words.hashes, width)
    at = known.find(hashes)
    owner = np.searchsorted(words.ranges, at, "right") - 1
    fits = at + width <= words.ranges[owner + 1]
    return at[fits], hashes[at[fits]], owner[fits]


def _counted(batches: Iterator[pa.RecordBatch], tokens: np.ndarray, widths: list[int]) -> Iterator[pa.RecordBatch]:
    known, total = _Known(tokens), np.zeros(len(tokens), np.int64)
    for batch in text_slices(batches):
        words = words_of(batch)
        for width in widths:
            _, hashes, _ = _shingle_hits(words, width, known)
            total += np.bincount(np.searchsorted(known.tokens, hashes), minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(known.tokens[seen].view(np.int64)), pa.array(total[seen])], names=["token", "n"])


_MATCH = StructType().add("n_words", LongType()).add("hits", ArrayType(LongType())).add("items", ArrayType(StringType()))


def _matched(batches: Iterator[pa.RecordBatch], block: Block, first: bool) -> Iterator[pa.RecordBatch]:
    """Add this block's hit ranges (word positions, flat pairs) and items to those of the blocks before.

    All other columns pass unchanged.
    """
    known, widths = _Known(np.array(sorted(block.by_token), np.uint64)), block.widths()
    for batch in text_slices(batches):
        words = words_of(batch)
        n = batch.num_rows
        hits: list[list[int]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        if not first:
            hits = [list(h or ()) for h in batch.column("hits").to_pylist()]
            items = [set(i or ()) for i in batch.column("items").to_pylist()]
        seen: set[tuple[int, int]] = set()
        for width in widths:
            for at, token, text in zip(*(x.tolist() for x in _shingle_hits(words, width, known))):
                low, high = int(words.ranges[text]), int(words.ranges[text + 1])
                for key, offset in block.by_token[token]:
                    own = block.words[key]
                    begin = at - offset
                    if min(len(own), _SHINGLE) != width or begin < low or begin + len(own) > high or (key, begin) in seen:
                        continue
                    if words.window(begin, len(own)) == own:
                        seen.add((key, begin))
                        hits[text] += [begin - low, begin - low + len(own)]
                        items[text] |= block.items[key]
        merged = [_merged(h) for h in hits]
        carried = [c for c in batch.schema.names if c not in _MATCH.names]
        columns = [*[batch.column(c) for c in carried], pa.array(np.diff(words.ranges), pa.int64())]
        columns += [pa.array(merged, pa.list_(pa.int64())), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*carried, *_MATCH.names])


def _merged(flat: list[int]) -> list[int]:
    out: list[int] = []
    for begin, end in sorted(zip(flat[::2], flat[1::2])):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = _BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's windows, block after block; its distinct rows are dealt to blocks by a hash, so a block is bounded on
    average, however many copies of a row there are."""
    rows = benchmark.select(
        F.coalesce(benchmark[item_col].cast("string"), F.lit("null")).alias("item"), benchmark[text_col].cast("string").alias("text")
    ).filter(F.col("text").isNotNull())
    rows = stored(rows.distinct(), "benchmark-rows")
    whole = rows.agg(F.sum(F.octet_length(F.encode("text", "UTF-8")))).first()[0] or 0
    n = -(-whole // block_bytes)
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        block = Block()
        for batch in text_slices(own.toArrow().to_batches()):
            words = words_of(batch)
            for i, item in enumerate(batch.column("item").to_pylist()):
                block.add(item, words, int(words.ranges[i]), int(words.ranges[i + 1]))
        if block.words:
            yield block
    release(rows)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, hits (merged word ranges, flat pairs), items (sorted as strings).

    A null text or one without words has no hits; an item without words or with a null text has no windows; an item with
    a null id is called "null". Repeated documents give repeated rows, repeated items count once per id. An empty
    benchmark leaves every document clean. Other columns of either table are ignored. Windows equal in words are one
    window with several items.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = _find(picked, benchmark_blocks(benchmark, item_col, item_text_col, block_bytes))
    return found.select("doc_id", "n_words", "hits", "items")


def _find(picked: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """The rows of ``picked`` (text and any columns not named as those of the match) with their n_words, hits and items."""
    spark, schema = picked.sparkSession, StructType([*picked.schema.fields, *_MATCH.fields])
    found, first = picked, True
    for block in blocks:
        tokens, widths = block.tokens(), block.widths()
        counted = picked.select("text").mapInArrow(lambda b, t=tokens, w=widths: _counted(b, t, w), "token long, n long")
        counts = {r["token"] & (1 << 64) - 1: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
        block.choose(counts)
        held = spark.sparkContext.broadcast(block)
        found = found.mapInArrow(lambda b, h=held, f=first: _matched(b, h.value, f), schema)
        first = False
    if first:  # nothing to look for: the same step with an empty block counts the words
        found = found.mapInArrow(lambda b: _matched(b, Block(by_token={0: []}), True), schema)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) in which ``find_contamination`` has no hit, with all their columns.

    Each row is judged by its own text, whatever its id.
    """
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")
    found = _find(docs.select("text", others), benchmark_blocks(benchmark, "item_id", "text", block_bytes))
    back = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.filter(F.size("hits") == 0).select(*back)


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ends = F.filter("hits", lambda x, i: i % 2 == 1)
    begins = F.filter("hits", lambda x, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return found.withColumn("n_hit", total(ends) - total(begins)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(_FOLDED)

SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_CUT} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op4_prefix_filtered_windows", SQL)
def _(spark, sf):
    return contamination_report(find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


def digest(items: list[str]) -> str:
    """The report's digest of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
