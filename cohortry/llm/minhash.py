"""Near duplicates by MinHash: universal hash minima, bands, verification, components.

1. One Arrow pass turns each text into its set size, a set fingerprint and the minima of many universal hashes.
2. Texts with equal sets form a class; only its representative (least id) goes on. A class of any size is one row.
3. Band keys are grouped to their least member; every other member of the bucket is linked to that centre: a bucket
   of n rows gives n - 1 pairs. Pairs that pass the signature estimate are confirmed on full shingle sets.
4. Components of the confirmed pairs are found. A bucket whose members all lie in one component needs no more. In any
   other, members of different components are compared, too, block against block inside tasks, a pair in the first
   bucket that it shares: signatures first, then full sets of the rows that have a likely partner. Only links leave a task, and components that have met count as one. So no link that joins two components
   is lost, and a group of near copies never yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from cohortry.llm.common import (
    WHITE,
    bloom_filter,
    bloom_passes,
    bloom_places,
    buffer_of,
    mixed,
    query,
    release,
    span_hashes,
    stored,
    table,
    text_slices,
    window_hashes,
    word_bounds,
    word_ranges,
)
from cohortry.llm.graph import components

SHINGLE = 5  # words
BANDS, ROWS = 32, 4  # a pair at 0.75 misses every band with probability (1 - 0.75^4)^32 = 5e-6
_LOW = 0.55  # signature estimates below it are not confirmed: over 5 standard errors under 0.75 at 128 minima
_MEMBERS = 1024  # of a bucket in one block where only signatures are compared
_BLOCK = 1 << 20  # shingles of a bucket's members in one block, on average: 8 MB
_HASHED_AT_ONCE = 1 << 16  # shingles

_COEFFICIENTS = np.random.default_rng(77)
_A = _COEFFICIENTS.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _COEFFICIENTS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a slice, text after text, and where each text's begin (n + 1 places)."""
    raw, offsets = buffer_of(batch)
    data = np.frombuffer(raw.lower(), np.uint8)  # bytes.lower folds A-Z only
    starts, ends = word_bounds(data, offsets, WHITE)
    words = span_hashes(data, starts, ends)
    ranges = word_ranges(starts, offsets)
    counts = np.diff(ranges)
    owner = np.repeat(np.arange(len(counts)), counts)
    windows = window_hashes(words, SHINGLE)
    inside = owner[: len(windows)] == owner[SHINGLE - 1 :] if len(windows) else np.empty(0, bool)
    hashes, texts = windows[inside], owner[: len(windows)][inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = [window_hashes(words[ranges[i] : ranges[i + 1]], counts[i])[0] for i in short]
        hashes, texts = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([texts, short])
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    hashes, texts = hashes[fresh], texts[fresh]
    return hashes, np.searchsorted(texts, np.arange(len(counts) + 1))


def _signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Minima (texts x hashes, uint32) of multiply-shift hashes of every non-empty set; empty sets give the largest value."""
    n = len(begins) - 1
    out = np.full((n, len(_A)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(begins))
    i = 0
    while i < len(full):  # groups of texts whose shingles fit the cache
        j = max(i + 1, int(np.searchsorted(begins[full + 1], begins[full[i]] + _HASHED_AT_ONCE, "right")))
        low, high = begins[full[i]], begins[full[j - 1] + 1]
        x, at = hashes[low:high], begins[full[i:j]] - low
        for k, (a, b) in enumerate(zip(_A, _B)):
            out[full[i:j], k] = np.minimum.reduceat(((x * a + b) >> np.uint64(32)).astype(np.uint32), at)
        i = j
    return out


_SKETCH_DDL = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        hashes, begins = shingle_sets(batch)
        sizes = np.diff(begins)
        sums = []
        for salt in (1, 2):  # order-free fingerprints of the set
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes * np.uint64(2 * salt + 1) + np.uint64(salt)))])
            sums.append((running[begins[1:]] - running[begins[:-1]]).view(np.int64))
        signatures = _signatures(hashes, begins)
        blobs = [s.tobytes() if n else None for s, n in zip(signatures, sizes)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(blobs, pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles) of the rows that pass a Bloom filter."""
    for batch in batches:
        passing = bloom_passes(wanted, [np.asarray(batch.column(f"p{k}")) for k in range(3)])
        for part in text_slices(iter([batch.filter(pa.array(passing))])):
            hashes, begins = shingle_sets(part)
            arrays = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), arrays], names=["doc_id", "shingles"])


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, band, key): a 64-bit key for every band of every signature; the band's number is part of the key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, BANDS, ROWS)
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (batch.num_rows, 1))
        for k in range(ROWS):
            keys = mixed(keys + minima[:, :, k].astype(np.uint64))
        ids = np.repeat(np.asarray(batch.column("doc_id")), BANDS)
        bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        columns = [pa.array(ids), pa.array(bands), pa.array(keys.reshape(-1).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band", "key"])


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal minima of two signatures."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the named texts.

    A Bloom filter of the ids passes over most other texts where they are read, so only the sets wanted are shuffled.
    """
    wanted = stored(ids.distinct(), "near-wanted")
    words = bloom_filter(wanted, "doc_id")
    held = texts.sparkSession.sparkContext.broadcast(words)
    places = [p.alias(f"p{k}") for k, p in enumerate(bloom_places("doc_id", 64 * len(words)))]
    sets = texts.select("doc_id", "text", *places).mapInArrow(lambda b: _sets(b, held.value), "doc_id long, shingles array<long>")
    return sets.join(wanted, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; every pair is looked up, estimated and then counted."""
    likely = pairs
    for side in ("a", "b"):
        likely = likely.join(signatures.select(F.col("doc_id").alias(side), F.col("signature").alias(f"s_{side}")), side)
    likely = stored(likely.filter(agreement("s_a", "s_b") >= _LOW).select("a", "b"), "near-likely")
    ends = likely.select(F.col("a").alias("doc_id")).unionAll(likely.select(F.col("b").alias("doc_id")))
    held = stored(_sets_of(texts, ends), "near-sets")
    both = likely
    for side in ("a", "b"):
        both = both.join(held.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    shared = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - shared
    out = stored(both.filter(100 * shared >= percent * union).select("a", "b"), "near-links")
    release(held)
    release(likely)
    return out


def _tiled(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows of a bucket dealt to pairs of its ``blocks`` (i <= j, side 0 or 1): every two rows meet in one pair of blocks."""
    own = F.pmod(F.xxhash64("doc_id"), F.col(blocks))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumns({"i": i, "j": j, "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", blocks)


def _likely_pairs(block: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left row the right rows of other components (an array that the caller may change) that pass the size bound
    and the signature, and that do not agree in an earlier band: they are compared in that band's bucket."""
    side, size, root = block["side"].to_numpy(), block["n_shingles"].to_numpy(), block["component"].to_numpy().copy()
    minima = np.frombuffer(b"".join(block["signature"]), np.uint32).reshape(len(block), -1)
    one_block = block["i"].iloc[0] == block["j"].iloc[0]
    band = int(block["band"].iloc[0])
    left = np.flatnonzero(side == 0)
    right = left if one_block else np.flatnonzero(side == 1)
    for x in left:
        y = right[right > x] if one_block else right
        y = y[(root[y] != root[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        equal = minima[y] == minima[x]
        likely = equal.mean(axis=1) >= _LOW
        y, equal = y[likely], equal[likely]
        if len(y):
            y = y[equal.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(y):
            yield x, y, root


def _with_partners(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a block pair that have a likely partner in it."""
    marked = np.zeros(len(block), bool)
    for x, y, _ in _likely_pairs(block, percent):
        marked[x] = True
        marked[y] = True
    return block.loc[marked, ["key", "band", "doc_id"]]


def _links_between(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components found in one block pair of a bucket.

    Likely pairs are confirmed on their full sets here, so only links leave the task; two components that have met are
    one from then on, so fewer links than components are found.
    """
    ids, size, sets = block["doc_id"].to_numpy(), block["n_shingles"].to_numpy(), block["shingles"].to_numpy()
    found = []
    for x, others, root in _likely_pairs(block, percent):
        for y in others:
            if root[y] == root[x]:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (size[x] + size[y] - common):
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                root[root == root[y]] = root[x]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id reachable), kept.

    Words are runs without white space after folding A-Z; a set holds the distinct runs of five words, or the whole
    sequence if shorter. Rows with 100 * common >= percent * union are linked. Different texts under one id share its
    component. A null, empty or blank text has an empty
    set, is linked with nothing and kept. Repeated rows get equal results, and a row with a null id takes no part in links, has a null component and is kept. An empty table gives an empty
    result; other columns are ignored. Shingles are compared by 64-bit hashes, sets of equal texts by 128 bits.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketches = stored(picked.mapInArrow(_sketch, _SKETCH_DDL), "near-sketches")
    key = ["n_shingles", "set_a", "set_b"]
    members = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", *key)
    classes = stored(members.groupBy(*key).agg(F.min("doc_id").alias("class_id")), "near-classes")
    heads = sketches.join(classes, [*[sketches[k] == classes[k] for k in key], sketches["doc_id"] == classes["class_id"]], "left_semi")
    # one row per representative: an id repeated with one text has one signature
    heads = heads.groupBy("doc_id", *key).agg(F.first("signature").alias("signature"))
    heads = stored(heads.select("doc_id", "n_shingles", "signature"), "near-heads")
    keys = stored(heads.mapInArrow(_band_keys, "doc_id long, band int, key long"), "near-bands")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = stored(buckets, "near-buckets")
    placed = stored(keys.join(buckets, "key"), "near-placed")
    release(keys)
    head_texts = picked.filter(F.col("doc_id").isNotNull())
    star = placed.filter("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _confirmed(star, head_texts, heads, percent)
    found = stored(components(links), "near-components")

    # buckets with members in several components
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    grouped = placed.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", component)
    grouped = stored(grouped, "near-grouped")
    torn = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    torn = torn.filter("x != y").select("key", F.ceil(F.col("n") / _MEMBERS).alias("blocks"))
    inside = stored(grouped.join(torn, "key").join(heads, "doc_id"), "near-torn")
    marked = _tiled(inside, "blocks").groupBy("key", "i", "j").applyInPandas(
        lambda block: _with_partners(block, percent), "key long, band int, doc_id long"
    )
    marked = stored(marked.distinct(), "near-marked")
    rows = marked.join(grouped.select("key", "doc_id", "component"), ["key", "doc_id"]).join(heads, "doc_id")
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("n_shingles") / _BLOCK).alias("blocks"))
    full = rows.join(_sets_of(head_texts, marked.select("doc_id")), "doc_id").join(blocks, "key")
    extra = _tiled(full, "blocks").groupBy("key", "i", "j").applyInPandas(
        lambda block: _links_between(block, percent), "a long, b long"
    )
    extra = stored(extra.distinct(), "near-extra")
    if not extra.isEmpty():
        found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(extra)), "near-components")
    labels = classes.join(found, classes["class_id"] == found["node"], "left").select(
        *key, F.coalesce("component", "class_id").alias("__component")
    )
    labels = stored(labels, "near-labels")
    for spent in (placed, grouped, buckets, inside, marked, heads, classes, links, extra):
        release(spent)
    named = sketches.select("doc_id", *key).join(labels, key, "left")
    one = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("__component")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", one.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded
), sets AS (SELECT s, min(doc_id) AS head, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingled) WHERE len(s) > 0 GROUP BY s),
single AS (SELECT head, n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.head AS a, b.head AS b FROM single a JOIN single b ON a.g = b.g AND a.head <> b.head
  GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT head AS a, head AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM shingled d LEFT JOIN sets t ON list_sort(d.s) = t.s LEFT JOIN least l ON l.a = t.head"""


@query("op9_minhash_components", SQL)
def _(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))
