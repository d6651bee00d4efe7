"""Substring deduplication by content-defined chunking with a gear rolling hash.

A rolling gear hash over the last bytes is taken at every word end; a chunk ends where that hash is the least among the
word ends around it, so cuts depend on nearby content only and fall back into step a few words after an insertion. One to
three words again and again have no such least hash: there cuts follow the period, at a phase that its words give.
Chunks are known by digest. A digest met twice anywhere is repeated; a run of neighbouring repeated chunks that is
long enough in words is a repeated span. The first place of a chunk (least id, then position) keeps it.

Digests are counted with map-side combination before they are shuffled, so a passage that a third of all documents
share is one row per task. Only repeated chunks go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import WHITE, buffer_of, mixed, query, release, span_hashes, stored, table, text_slices, word_bounds

REACH = 3  # a cut is the least of this many word ends on either side: chunks have 4 words at least, 7 on average
_WINDOW = 16  # bytes that the gear hash looks back; a longer word is hashed whole
_STEP = 6  # words between cuts inside a periodic stretch: a multiple of its period of 1 to REACH words
_MOST = 64  # words of a chunk; what else has no cut is cut by count
LEAST_WORDS = 16  # of a repeated span. Of 51 shared words of prose, 41 are found in the median and under 16 in 1 of 1,000
_GEAR = np.random.default_rng(4242).integers(0, 1 << 63, 256, dtype=np.uint64)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The windowed gear hash at every byte: the sum of the last bytes' gear values, each shifted by its age."""
    out = _GEAR[data]
    width = 1
    while width < _WINDOW:  # sums over 1, 2, 4, ... bytes
        shifted = out[:-width] << np.uint64(width)
        out = out.copy()
        out[width:] += shifted
        width *= 2
    return mixed(out)


def periodic_cuts(value: np.ndarray, text: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The last words of chunks inside stretches that repeat 1 to REACH words, where the hash has no least value.

    A stretch is a run of word ends whose hash equals that of ``period`` words before. The first cut is where the least
    rotation of the period's hashes begins, wherever the run begins; then every _STEP words, so that all these chunks are
    the same bytes; the last is the end of the run. ``whole`` says that a word's window lies inside its text.
    """
    n = len(value)
    covered, cut = np.zeros(n, bool), np.zeros(n, bool)
    for period in range(1, REACH + 1):
        equal = np.zeros(n + 2, bool)  # with a border on either side
        equal[period + 1 : -1] = (value[period:] == value[:-period]) & (text[period:] == text[:-period]) & whole[:-period]
        equal[1:-1] &= ~covered
        begin, stop = np.flatnonzero(equal[1:] & ~equal[:-1]), np.flatnonzero(equal[:-1] & ~equal[1:])
        long = stop - begin >= _STEP
        begin, stop = begin[long], stop[long]
        phase = np.zeros(len(begin), np.int64)
        for k in range(1, period):
            better, open_ = np.zeros(len(begin), bool), np.ones(len(begin), bool)
            for j in range(period):
                a, b = value[begin + (k + j) % period], value[begin + (phase + j) % period]
                better |= open_ & (a < b)
                open_ &= a == b
            phase[better] = k
        first = begin + phase
        times = (stop - 1 - first) // _STEP + 1
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cut[np.repeat(first, times) + nth * _STEP] = True
        cut[stop - 1] = True
        edge = np.zeros(n + 1, np.int64)
        edge[begin] += 1
        edge[stop] -= 1
        covered |= np.cumsum(edge[:-1]) > 0
    return cut


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all texts: text, first byte, end byte and number of words of every chunk, in order.

    A chunk runs from a word's start to a word's end; the white space behind it belongs to no chunk.
    """
    starts, ends = word_bounds(data, offsets, WHITE)
    n = len(starts)
    if not n:
        return (np.empty(0, np.int64),) * 4
    text = np.searchsorted(offsets, starts, "right") - 1
    value = gear_hashes(data)[ends - 1]
    beyond = np.flatnonzero(ends - starts > _WINDOW)  # such words count whole, so that one end does not make them equal
    if len(beyond):
        sizes = (ends - starts)[beyond]
        stop = np.cumsum(sizes)
        value[beyond] = span_hashes(data[np.arange(stop[-1]) + np.repeat(starts[beyond] - stop + sizes, sizes)], stop - sizes, stop)
    cut = np.ones(n, bool)
    for k in range(1, REACH + 1):  # the first of equal values wins, so one word again and again has no cut here
        # beyond a text's ends there is nothing to compare with
        same = text[k:] == text[:-k]
        cut[k:] &= ~same | (value[k:] < value[:-k])
        cut[:-k] &= ~same | (value[:-k] <= value[k:])
    last = np.ones(n, bool)
    last[:-1] = text[1:] != text[:-1]
    first = np.ones(n, bool)
    first[1:] = last[:-1]
    # the edge of a text is no content, so nothing is cut within reach of its begin for lack of neighbours
    position = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    cut &= position >= REACH
    cut |= periodic_cuts(value, text, ends - _WINDOW >= offsets[text])
    cut |= last
    began = np.maximum.accumulate(np.where(np.concatenate([[True], cut[:-1]]), np.arange(n), 0))
    cut |= (np.arange(n) - began + 1) % _MOST == 0
    closing = np.flatnonzero(cut)
    opening = np.concatenate([[0], closing[:-1] + 1])
    return text[opening], starts[opening], ends[closing], closing - opening + 1


_CHUNK_DDL = "doc_id long, copy long, at int, digest long, digest2 long, start int, stop int, words int"
#: Another order of the byte values, under which the second half of a digest is taken.
_OTHER = np.random.default_rng(77).permutation(256).astype(np.uint8)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        raw, offsets = buffer_of(batch)
        data = np.frombuffer(raw, np.uint8)
        text, start, stop, words = chunk_bounds(data, offsets)
        if not len(text):
            continue
        digest = span_hashes(data, start, stop).view(np.int64)
        at = np.arange(len(text)) - np.searchsorted(text, text)
        ids, copies = (batch.column(c).take(pa.array(text)) for c in ("doc_id", "copy"))
        columns = [ids, copies, pa.array(at, pa.int32()), pa.array(digest), pa.array(span_hashes(_OTHER[data], start, stop).view(np.int64))]
        columns += [pa.array(x, pa.int32()) for x in (start - offsets[text], stop - offsets[text], words)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "at", "digest", "digest2", "start", "stop", "words"])


def chunks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, at, digest, digest2, start, stop, words): every chunk with its number, place in UTF-8 bytes and words.

    ``copy`` is a hash of the text: rows of one id that differ in their texts are documents of their own.
    """
    text = docs[text_col].cast("string")
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return picked.filter(F.col("doc_id").isNotNull()).mapInArrow(_chunked, _CHUNK_DDL)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per repeated span: doc_id, start, stop (UTF-8 bytes), n_words, n_chunks, first_doc_id, removed_words, removed.

    ``first_doc_id`` is the least document that holds a chunk of the span. ``removed`` says that chunks of the span are
    met earlier (in an earlier document, or further ahead in this one); ``removed_words`` counts their words. The first
    holder of a passage has a row, too, with ``removed`` false. Documents without a repeated span have no row: null,
    empty and short texts, texts met once, and rows with a null id. Rows with equal ids and texts are the same document;
    different texts under one id are documents of their own, with rows under that id each. Very long texts are read whole.
    Other columns are ignored. Digests are 128-bit hashes of a chunk's bytes. A stretch without a cut ends after 64 words.
    """
    chunks = chunks_of(docs, id_col, text_col)
    place = F.struct("doc_id", "copy", "at")
    repeated = chunks.groupBy("digest", "digest2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last")
    repeated = stored(repeated.select("digest", "digest2", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "copy", "at")]), "chunk-repeats")
    found = chunks.join(repeated, ["digest", "digest2"]).withColumn(
        "later", (F.col("doc_id") != F.col("first_doc_id")) | (F.col("copy") != F.col("first_copy")) | (F.col("at") != F.col("first_at"))
    )
    # per document the repeated chunks in order; neighbours make a run. A document's own chunks are bounded by its text
    item = F.struct("at", "start", "stop", "words", "first_doc_id", "later")
    docs_with = found.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set(item)).alias("run"))
    return docs_with.mapInArrow(lambda b: _runs(b, least_words), _SPAN_DDL)


_SPAN_DDL = "doc_id long, start long, stop long, n_words long, n_chunks long, first_doc_id long, removed_words long, removed boolean"


def _runs(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("run")
        flat = runs.flatten()
        at, start, stop, words, first, later = (np.asarray(flat.field(i)) for i in range(6))
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(runs)))
        if not len(at):
            continue
        opens = np.ones(len(at), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(opens)
        n_words = np.add.reduceat(words.astype(np.int64), begin)
        removed = np.add.reduceat(np.where(later, words, 0).astype(np.int64), begin)
        end = np.append(begin[1:], len(at))
        keep = n_words >= least_words
        ids = batch.column("doc_id").take(pa.array(owner[begin][keep]))
        values = [start[begin], stop[end - 1], n_words, end - begin, np.minimum.reduceat(first, begin), removed]
        columns = [ids, *[pa.array(v[keep], pa.int64()) for v in values], pa.array((removed > 0)[keep])]
        yield pa.RecordBatch.from_arrays(
            columns, names=["doc_id", "start", "stop", "n_words", "n_chunks", "first_doc_id", "removed_words", "removed"]
        )


@query("op10_gear_chunks")
def _(spark, sf):
    return repeated_spans(table(spark, sf, "documents"))
