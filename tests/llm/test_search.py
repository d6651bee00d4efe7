"""Vector search, hard negatives and ranked lexical search against plain loops: ties, nulls, repeated rows, odd vectors."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import lexical, negatives, retrieval, vectors

WIDE = "vec_id long, embedding array<double>, label int, row long, score string, key int, n int, norm string, rank int, cluster int, v int"


def whole(x, factor):
    if x is None or any(c is None or not math.isfinite(c) for c in x):
        return None
    return [math.floor(factor * c) for c in x]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def last(i):
    return (i is None, i or 0)


def vector_rows(n: int, seed: int, dim: int = 6) -> list[tuple]:
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    hot = [pick.gauss(0, 1) for _ in range(dim)]
    out = []
    for i in range(n):
        kind = pick.random()
        c = pick.choice(centres)
        v = hot if kind < 0.33 else [x * pick.choice((0.2, 1, 3)) + pick.gauss(0, 0.2) for x in c] if kind < 0.9 else [0.0] * dim
        if kind > 0.98:
            v = v[:3]
        out.append((i, v, pick.choice([0, 1, 2, None])))
    out[5:5] = [(40, None, 1), (60, [1.0, None], 1), (80, [float("nan")] * dim, 1), (100, [float("inf")] * dim, 0), (120, [], 1), (None, hot, 1), (None, centres[0], 2)]
    return out + [out[0], out[20], (200, hot, 1), (200, hot, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, 1, "y", 3, 4, 5) for r in rows], WIDE).repartition(5)


def plain_search(rows, factor, k, step):
    known = [(i, w) for i, x, _ in rows if (w := whole(x, factor)) is not None]
    out = []
    for at, (q, v) in enumerate(known):
        if q is not None and q % step == 0:
            scores = sorted(((-dot(v, w), last(i), i) for j, (i, w) in enumerate(known) if j != at))[:k]
            out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(scores, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("coordinates_from", [0.0, 0.6, 2.0])
def test_search_equals_loops(spark, coordinates_from, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "HEAD", 20)
    rows = vector_rows(300, 3)
    got = retrieval.top_products(frame(spark, rows), F.expr("vec_id % 20 = 0"), k=7, coordinates_from=coordinates_from).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(rows, 64.0, 7, 20)


def test_bucket_pruning_keeps_all(spark):
    pick = np.random.default_rng(4)
    v = np.floor(64 * pick.normal(size=(400, 8))).astype(np.int32)
    norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    bucket = retrieval.Bucket.of(vectors.Block(v, norm, {"id": np.arange(400), "row": np.arange(400)}))
    for q in range(20):
        cosines = bucket.unit() @ (v[q] / norm[q])
        for least in (0.3, 0.7, 0.95):
            found = bucket.within(v[q] / norm[q], least, 3)
            assert set(np.flatnonzero(cosines >= least)) <= set(found.tolist())
        assert len(bucket.within(v[q] / norm[q], 0.95, 3)) < 200


def test_search_of_few_or_no_rows(spark):
    empty = frame(spark, [])
    assert retrieval.top_products(empty, F.expr("vec_id % 20 = 0")).collect() == []
    one = frame(spark, [(0, [1.0], 1)])
    assert retrieval.top_products(one, F.expr("vec_id % 20 = 0")).collect() == []
    two = frame(spark, [(0, [1.0, 2.0], 1), (1, [], 1)])
    assert [tuple(r) for r in retrieval.top_products(two, F.expr("vec_id % 20 = 0")).collect()] == [(0, 1, 1, 0)]


def test_large_products_stay_exact(spark):
    rows = [(0, [3e5, 1e5], 1), (1, [4e5 + 1 / 64, 2e5], 1), (2, [4e5, 2e5], 1), (3, [-4e5, 1.0], 1)]
    got = retrieval.top_products(frame(spark, rows), F.expr("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(rows, 64.0, 20, 20)
    with pytest.raises(Exception, match="32 bits"):
        retrieval.top_products(frame(spark, [(0, [1e12], 1)]), F.expr("true")).collect()


def plain_negatives(rows, factor, step, positives=5, count=5):
    known = [(i, w, label) for i, x, label in rows if label is not None and (w := whole(x, factor)) is not None]
    out = []
    for at, (a, v, label) in enumerate(known):
        if a is None or a % step:
            continue
        scored = [(-dot(v, w), last(i), i, other) for j, (i, w, other) in enumerate(known) if j != at]
        same = sorted(s[:3] for s in scored if s[3] == label)[:positives]
        rest = sorted(s[:3] for s in scored if s[3] != label)
        for p, _, pid in same:
            fits = [s for s in rest if 80 * -p <= 100 * -s[0] <= 100 * -p][:count]
            out += [(a, pid, rank, nid, -p, -n) for rank, (n, _, nid) in enumerate(fits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("clusters", [1, 5])
def test_negatives_equal_loops(spark, clusters, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    for name, value in (("HEAD", 20), ("STEP", 4), ("_ANCHOR_ROWS", 4)):
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows(300, 8)
    got = negatives.mine_negatives(frame(spark, rows), F.expr("vec_id % 20 = 0"), clusters=clusters).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_negatives(rows, 256.0, 20)
    assert len(got) > 100


def test_negatives_of_few_or_no_rows(spark):
    assert negatives.mine_negatives(frame(spark, []), F.expr("vec_id % 20 = 0")).collect() == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2), (3, [2.0, 2.0], 2), (4, [1.0, 1.0], None)]
    got = negatives.mine_negatives(frame(spark, rows), F.expr("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 256.0, 20)
    assert negatives.mine_negatives(frame(spark, rows[:1]), F.expr("vec_id % 20 = 0")).collect() == []
    assert negatives.mine_negatives(frame(spark, rows), F.expr("false")).collect() == []


def test_walk_ends_early_and_keeps_the_best():
    pick = np.random.default_rng(2)
    v = np.floor(256 * np.concatenate([pick.normal(0, 0.05, (50, 8)) + np.eye(8)[0], pick.normal(0, 0.05, (2000, 8)) - np.eye(8)[0]])).astype(np.int32)
    norm = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    numbers = {"row": np.arange(len(v)), "id": np.arange(len(v)), "label": np.zeros(len(v), np.int64)}
    anchors = vectors.Block(v[:4], norm[:4], {k: x[:4] for k, x in numbers.items()})
    candidates, best = vectors.Block(v, norm, numbers), vectors.Best(4, 5)
    centre = np.eye(8)[0]
    bound = negatives.bounds(candidates, centre, float(negatives._angles(anchors.v, centre[None]).max()))
    scores = v[:4].astype(np.int64) @ v.astype(np.int64).T
    assert (scores <= norm[:4, None] * bound + 1e-6).all()
    read = negatives.walk(anchors, candidates, np.argsort(-bound), bound, *negatives._positives(anchors, candidates, best))
    assert read <= 4 * negatives.STEP
    for a in range(4):
        want = sorted((-scores[a, c], c) for c in range(len(v)) if c != a)[:5]
        assert [(-s, i) for o, s, i in zip(*best.entries[:3]) if o == a] == want


# ---------------------------------------------------------------- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_rank(docs, items, k=50):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms if bag[t])
            if score > 0:
                scores.append((-score, last(i), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def text_rows(seed: int):
    pick = random.Random(seed)
    common, rare = ["the", "of", "The", "año", "x1"], [f"w{i}" for i in range(200)]
    doc = lambda: " ".join(pick.choice(common if pick.random() < 0.6 else rare) for _ in range(pick.choice((1, 5, 30, 200))))
    hot = doc()
    docs = [(i, hot if pick.random() < 0.33 else doc()) for i in range(300)]
    docs += [(7, None), (8, ""), (None, hot), (None, "w1 THE w2"), (9, " ,.-_ "), (3, hot), (3, hot), (11, "日本語\tw5-w6_w7 É é Ünder"), (12, "w9 " * 30_000 + "the")]
    items = [(1, "the of w1 w2 w3"), (2, "W5, w6! w7? é 日本語"), (3, None), (4, ""), (5, "nowhere to be found"), (None, "the w9"), (6, hot), (6, "w9 w9 w9"), (8, "the")]
    return docs, items


@pytest.mark.parametrize(("short", "window", "segment", "terms", "block"), [(1 / 32, 1024, 8192, 1 << 20, 1 << 16), (0.1, 8, 40, 8, 4), (0.0, 16, 64, 1 << 20, 1), (2.0, 16, 64, 1 << 20, 100)])
def test_ranking_equals_loops(spark, short, window, segment, terms, block, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(lexical, "ITEM_TERMS", block)
    monkeypatch.setattr(lexical.rank_segment, "__defaults__", (short, window))
    docs, items = text_rows(1)
    d = spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in docs], "doc_id long, text string, row int, item string, key string, n int, words int").repartition(4)
    i = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id int, terms string")
    got = lexical.rank_documents(d, i, k=20, terms=terms).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_rank(docs, items, 20)


def test_ranking_of_empty_tables(spark):
    docs, items = text_rows(2)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.rank_documents(d.limit(0), i).collect() == []
    assert lexical.rank_documents(d, i.limit(0)).collect() == []
    assert lexical.rank_documents(d.filter("text IS NULL"), i).collect() == []


def test_ranking_skips_documents():
    pick = np.random.default_rng(1)
    n = 4096
    docs = np.arange(n)
    everywhere = (docs, np.full(n, 5), 5)
    rare = (np.sort(pick.choice(n, 60, replace=False)), np.full(60, 1000), 1000)
    segment = type("S", (lexical.Segment,), {"__init__": lambda self: None})()
    segment.docs = segment.rows = docs
    segment.sums = np.zeros(n, np.int64)
    best = vectors.Best(1, 10)
    assert lexical.rank_segment(segment, [everywhere, rare], best, 0) < n / 2
    assert best.entries[2].tolist() == rare[0][:10].tolist()
    assert set(best.entries[1]) == {1005}
