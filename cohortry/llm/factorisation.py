"""A factorisation machine for text quality: hashed words, structure numbers and metadata with low-rank interactions.

Score = bias + sum of w_i x_i + half the sum over factors of ((sum of v_if x_i) squared - sum of (v_if x_i) squared),
which takes one pass over a text's features. The model is fitted in one task on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import query, table, text_slices
from cohortry.llm.quality import labelled_sample
from cohortry.llm.textstats import STRUCTURE, Stats, stats_of, structure_of

BITS = 16  # of a word's index
FACTORS = 8
SAMPLE = 4_000  # labelled rows that the model is fitted on, at most
THRESHOLD = 0.3  # fixed by the contract
_WORD_WEIGHT = 3.0  # a text's word shares add up to it, about the size of the other inputs together
_EPOCHS, _ROWS_AT_ONCE = 20, 128


def _metadata(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """(texts, 2 per column): log size and whether it is there."""
    out = [np.empty((batch.num_rows, 0))]
    for c in columns:
        raw = np.array([np.nan if x is None else float(x) for x in batch.column(c).to_pylist()])
        there = np.isfinite(raw)
        out.append(np.stack([np.log1p(np.maximum(np.where(there, raw, 0), 0)), there], axis=1))
    return np.concatenate(out, axis=1)


def inputs(batch: pa.RecordBatch, metadata: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, word features and their values, each once per row, and the dense numbers of every row."""
    s: Stats = stats_of(batch)
    index = (s.words >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(s.owner * (1 << BITS) + index, return_counts=True)
    rows = key >> BITS
    values = _WORD_WEIGHT * count / np.maximum(s.n_words, 1)[rows]
    return rows, key & ((1 << BITS) - 1), values, np.concatenate([structure_of(s), _metadata(batch, metadata)], axis=1)


class Machine:
    """Weights: of words first, then of dense numbers."""

    def __init__(self, dense: int, seed: int = 5):
        random = np.random.default_rng(seed)
        self.mean, self.scale, self.bias = np.zeros(dense), np.ones(dense), 0.0
        self.w = np.zeros((1 << BITS) + dense)
        self.v = random.normal(0, 0.05, ((1 << BITS) + dense, FACTORS))

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4)

    def sums(self, rows, words, values, dense) -> tuple[np.ndarray, np.ndarray]:
        """Margins and the factor sums of every row; rows ascend."""
        n, low = len(dense), 1 << BITS
        d, dv = self.scaled(dense), self.v[low:]
        linear = self.bias + d @ self.w[low:] + np.bincount(rows, self.w[words] * values, n)
        both, squares = d @ dv, (d**2) @ (dv**2)
        if len(rows):
            begin = np.flatnonzero(np.diff(rows, prepend=-1))
            at = rows[begin]
            part = self.v[words] * values[:, None]
            both[at] += np.add.reduceat(part, begin)
            squares[at] += np.add.reduceat(part**2, begin)
        return linear + 0.5 * (both**2 - squares).sum(axis=1), both

    def score(self, rows, words, values, dense) -> np.ndarray:
        margin, _ = self.sums(rows, words, values, dense)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def pack(self) -> bytes:
        return np.concatenate([[self.bias], self.mean, self.scale, self.w, self.v.ravel()]).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, blob: bytes, dense: int) -> Machine:
        a, out = np.frombuffer(blob, np.float32), cls(dense)
        out.bias, out.mean, out.scale = float(a[0]), a[1 : 1 + dense], a[1 + dense : 1 + 2 * dense]
        rest = a[1 + 2 * dense :]
        out.w, out.v = rest[: len(out.w)], rest[len(out.w) :].reshape(out.v.shape)
        return out


def fit(batch: pa.RecordBatch, labels: np.ndarray, metadata: Sequence[str], epochs: int = _EPOCHS) -> Machine:
    """Adam on the logistic loss over small groups of rows in a fixed shuffled order; one class alone gives its constant."""
    out = Machine(STRUCTURE + 2 * len(metadata))
    if len(set(labels.tolist())) < 2:
        out.bias, out.v[:] = 3.0 if not len(labels) or labels[0] else -3.0, 0
        return out
    parts, done = [], 0
    for piece in text_slices(iter([batch])):
        rows, words, values, dense = inputs(piece, metadata)
        parts.append((rows + done, words, values, dense))
        done += piece.num_rows
    rows, words, values, dense = (np.concatenate(x) for x in zip(*parts))
    begin = np.searchsorted(rows, np.arange(done + 1))
    out.mean, out.scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    out.bias = float(np.log((labels.mean() + 1e-3) / (1.001 - labels.mean())))
    low, order, step = 1 << BITS, np.random.default_rng(9), 0
    state = [np.zeros_like(x) for x in (out.w, out.w, out.v, out.v)]
    for _ in range(epochs):
        shuffled = order.permutation(done)
        for at in range(0, done, _ROWS_AT_ONCE):
            pick = shuffled[at : at + _ROWS_AT_ONCE]
            lengths = begin[pick + 1] - begin[pick]
            where = np.repeat(begin[pick] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            r, f, x, d = np.repeat(np.arange(len(pick)), lengths), words[where], values[where], dense[pick]
            margin, both = out.sums(r, f, x, d)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
            scaled = out.scaled(d)
            gw, gv = 1e-6 * out.w, 1e-5 * out.v
            gw[:low] += np.bincount(f, g[r] * x, low)
            gw[low:] += g @ scaled
            part = (g[r] * x)[:, None] * (both[r] - out.v[f] * x[:, None])
            for k in range(FACTORS):
                gv[:low, k] += np.bincount(f, part[:, k], low)
            gv[low:] += (scaled * g[:, None]).T @ both - out.v[low:] * (g @ scaled**2)[:, None]
            step += 1
            for value, slope, m, s in ((out.w, gw, *state[:2]), (out.v, gv, *state[2:])):
                m += 0.1 * (slope - m)
                s += 0.01 * (slope**2 - s)
                value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            out.bias -= 0.1 * g.sum()
    return out


def fit_machine(docs: DataFrame, labels: DataFrame, label: str, metadata: Sequence[str], rows: int = SAMPLE) -> bytes:
    """A packed machine (2.4 MB) from at most ``rows`` labelled rows, fitted in one task."""
    sample = labelled_sample(docs, labels, label, rows, metadata)

    def task(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "doc_id", "text"])
        batch = pa.RecordBatch.from_pandas(part[["text", *metadata]], preserve_index=False)
        return pd.DataFrame({"machine": [fit(batch, part["label"].to_numpy(float), metadata).pack()]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(task, "machine binary").collect()
    if found:
        return bytes(found[0]["machine"])
    return fit(pa.record_batch([pa.array([], pa.string())], names=["text"]), np.empty(0), metadata).pack()


_DDL = "doc_id long, held_out boolean, score double, predicted int"


def _scored(batches: Iterator[pa.RecordBatch], blob: bytes, metadata: Sequence[str]) -> Iterator[pa.RecordBatch]:
    machine = Machine.unpack(blob, STRUCTURE + 2 * len(metadata))
    for batch in text_slices(batches):
        score = machine.score(*inputs(batch, metadata))
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(score >= THRESHOLD).cast(pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Sequence[str] = ("n_chars",),
    rows: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability of label 1), predicted (score >= 0.3).

    Rows whose crc32(id as text) is divisible by 5 are held out of learning. Inputs are the text and the ``metadata``
    columns that ``docs`` has (numbers; null is an input of its own); labels and ids are none. A null or empty text is scored by its
    structure. Repeated rows get equal scores; a null id is not held out; an empty table gives an empty result; other
    columns are ignored. Without labels every score is the same.
    """
    metadata = [c for c in metadata if c in docs.columns]
    remainder = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5
    picked = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[F.col(c).cast("double").alias(c) for c in metadata]
    ).withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))
    learned = labels.filter(F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")) % 5 != 0)
    blob = docs.sparkSession.sparkContext.broadcast(fit_machine(picked, learned, label, metadata, rows))
    return picked.mapInArrow(lambda b: _scored(b, blob.value, metadata), _DDL)


@query("op6_factorisation_machine")
def _(spark, sf):
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
