"""Quality rules: fixed counts, and a logistic regression on hashed word and character n-grams.

The model is trained on a bounded sample of labelled rows, dealt to a fixed number of parts by a hash of the id: every part
fits a regression on four fifths of its rows, calibrates it on the last fifth, and gives one vector of weights; the parts'
calibrated scores are averaged, which is again one vector. So training does not depend on partitioning, and the driver
receives a few vectors of fixed size. Texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import query, table, text_slices, window_hashes
from cohortry.llm.textstats import Stats, stats_of

BITS = 17  # of a feature's index inside its family
FAMILIES = 3  # words, word pairs, runs of four bytes
THRESHOLD = 0.3  # of the calibrated probability of good quality, below which a text is rejected
SAMPLE = 4_000  # labelled rows that the model is fitted on, at most
PARTS = 4
_STEPS = 120
# fixed values of the contract
_LEAST_WORDS = 10
_REPEAT_PERCENT = 20


def _families(s: Stats) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every family: feature indices and their texts."""
    shift = np.uint64(64 - BITS)
    pairs = window_hashes(s.words, 2)
    inside = s.owner[: len(pairs)] == s.owner[len(s.words) - len(pairs) :]
    out = [((s.words >> shift).astype(np.int64), s.owner), ((pairs[inside] >> shift).astype(np.int64), s.owner[: len(pairs)][inside])]
    d = s.data.astype(np.uint32)
    n = max(0, len(d) - 3)
    text = np.repeat(np.arange(len(s.offsets) - 1), np.diff(s.offsets))
    runs = ((d[:n] * np.uint32(0x01000193) + d[1 : n + 1]) * np.uint32(0x85EBCA6B) + d[2 : n + 2]) * np.uint32(0xC2B2AE35) + d[3 : n + 3]
    runs = (runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    whole = text[:n] == text[3 : n + 3]
    out.append((runs[whole].astype(np.int64), text[:n][whole]))
    return [(index + (k << BITS), owner) for k, (index, owner) in enumerate(out)]


def margins(s: Stats, weights: np.ndarray, bias: float) -> np.ndarray:
    """The regression's sum: every family's mean weight over the text's n-grams."""
    n = len(s.n_words)
    total = np.full(n, bias)
    for index, owner in _families(s):
        count = np.bincount(owner, minlength=n)
        total += np.bincount(owner, weights[index], n) / np.maximum(count, 1)
    return total


def _sparse(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, features and values (share in the family) of texts, each feature once per row."""
    rows, features, values, done = [], [], [], 0
    for batch in batches:
        s = stats_of(batch)
        n = batch.num_rows
        for index, owner in _families(s):
            key, count = np.unique(owner * (FAMILIES << BITS) + index, return_counts=True)
            row = key // (FAMILIES << BITS)
            rows.append(row + done)
            features.append(key % (FAMILIES << BITS))
            values.append(count / np.maximum(np.bincount(owner, minlength=n), 1)[row])
        done += n
    return np.concatenate(rows), np.concatenate(features), np.concatenate(values), done


def fit_weights(texts: pd.Series, labels: np.ndarray, steps: int = _STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of one calibrated regression; with one class only, zero weights and that class."""
    dim = FAMILIES << BITS
    if len(set(labels.tolist())) < 2:
        return np.zeros(dim, np.float32), 4.0 if len(labels) and labels[0] else (-4.0 if len(labels) else 4.0)
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    rows, features, values, n = _sparse(text_slices(iter([batch])))
    used, features = np.unique(features, return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log((labels.mean() + 1e-3) / (1.001 - labels.mean())))
    first, second = np.zeros(len(used)), np.zeros(len(used))
    train = (~held).astype(float) / max(1, (~held).sum())
    for step in range(1, steps + 1):  # Adam on the whole part, with a little shrinking
        z = b + np.bincount(rows, w[features] * values, n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * train
        gradient = np.bincount(features, g[rows] * values, len(used)) + 1e-7 * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        b -= 0.5 * g.sum()
    z = b + np.bincount(rows, w[features] * values, n)
    scale, shift = _platt(z[held], labels[held]) if held.any() else (1.0, 0.0)
    out = np.zeros(dim, np.float32)
    out[used] = scale * w
    return out, float(scale * b + shift)


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of margins that make them log odds on held-out rows (damped Newton, smoothed targets)."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([z, np.ones(len(z))])

    def loss(p: np.ndarray) -> float:
        m = p @ x
        return float(np.sum(np.logaddexp(0, m) - target * m)) + 5e-4 * float(p @ p)

    p = np.zeros(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        hessian = (x * (q * (1 - q))) @ x.T + 1e-3 * np.eye(2)
        move, size = np.linalg.solve(hessian, x @ (q - target) + 1e-3 * p), 1.0
        while size > 1e-4 and loss(p - size * move) > loss(p):
            size /= 2
        p = p - size * move
    return max(float(p[0]), 0.05), float(p[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, more..., label, draw) of at most ``rows`` labelled ids, drawn by a hash of the id, so a retry draws the same.

    The drawn ids (at most ``rows``) are broadcast to the documents, so no text is shuffled for the join.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    drawn = known.withColumn("draw", F.xxhash64("doc_id", F.lit(11))).orderBy("draw", "doc_id").limit(rows)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), *more)
    return picked.join(F.broadcast(drawn), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from ``labels`` (doc_id, quality 0/1) of ``docs``. Without labelled rows everything is good."""
    sample = labelled_sample(docs, labels, "quality", rows).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "text"])
        w, b = fit_weights(part["text"], part["label"].to_numpy(float))
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [b], "n": [len(part)]})

    fitted = sample.groupBy("part").applyInPandas(fit, "weights binary, bias double, n long").collect()
    total = sum(r["n"] for r in fitted)
    if not total:
        return np.zeros(FAMILIES << BITS, np.float32), 4.0
    weights = sum(np.frombuffer(r["weights"], np.float32) * (r["n"] / total) for r in fitted)
    return weights.astype(np.float32), sum(r["bias"] * r["n"] for r in fitted) / total


_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def _judged(s: Stats, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (s.n_words < _LEAST_WORDS) | (100 * s.n_repeat_words > _REPEAT_PERCENT * s.n_words)
    probability = 1 / (1 + np.exp(-np.clip(margins(s, weights, bias), -30, 30)))
    return failed, ~failed & (probability >= THRESHOLD), probability


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        s = stats_of(batch)
        failed, kept, probability = _judged(s, weights, bias)
        counts = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
        columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], *[pa.array(c) for c in (failed, kept, probability)]]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _DDL.split(", ")])


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, kept, and the calibrated probability of good quality.

    A null or empty text has no words, so it fails the base rules. Repeated rows and null ids give rows like any other; an
    empty table gives an empty result; other columns are ignored. Without labels nothing is rejected beyond the base rules.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(picked, labels, rows))  # 1.5 MB
    return picked.mapInArrow(lambda b: _scored(b, *model.value), _DDL)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that ``judge_quality`` keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(_judged(stats_of(batch), *model.value)[1]))

    return docs.mapInArrow(keep, docs.schema)


@query("op5_ngram_quality")
def _(spark, sf):
    return judge_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
