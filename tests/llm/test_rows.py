"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for operators and stages."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortry.llm import chunks, decontaminate, factorisation, minhash, pieces, privacy, quality, secrets, sequences, sharding
from cohortry.session import shared_dir

LONG = " ".join(f"word{i % 977} text{i % 31}," for i in range(40_000)) + " mail a.b@c.de token = abcdef123456"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then some more words follow here", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \n\t ", "en"),
    (5, LONG, "de"),
    (6, "the quick brown fox jumps over the lazy dog and then some more words follow here", "en"),
    (6, "the quick brown fox jumps over the lazy dog and then some more words follow here", "en"),
    (None, "a row without an id, but with a phone +1 (212) 555-0153 and ten words at least", None),
    (None, None, None),
    (9, "ascii \x00 control, emoji 😀 and ñandú ▁ mark", "xx"),
]
CLASHING = "doc_id long, text string, lang string, shard int, slot long, kept boolean, n_words long, hits string, key int, signature string, part int, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, 7, 8, False, 9, "x", 1, "s", 2, None if t is None else len(t)) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (6, 1), (None, 1), (9, None), (1, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    texts = [(7, "Fox jumps over the lazy dog and then some more WORDS"), (8, None), (9, ""), (None, "emoji"), (7, "emoji"), (7, "emoji")]
    return spark.createDataFrame([(*t, "x") for t in texts], "item_id long, text string, hits string")


def test_secrets(docs, empty):
    rows = secrets.link_credentials(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"]: r["n_assign"] for r in rows}[5] == 1
    assert all(not r["spans"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert secrets.link_credentials(empty).collect() == []


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["size"] for r in rows)[:3] == [1, 1, 1]
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.shard_documents(empty).collect() == []


def test_overfull_ranges_are_cut_again(spark):
    """A third of the rows are one text under null ids, the rest are tiny beside a few long ones."""
    data = [(None, "copy")] * 400 + [(i, f"t{i}") for i in range(800)] + [(i, "long " * 5000) for i in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    rows = docs.select("*", F.xxhash64("text").alias("k"), F.length("text").cast("long").alias("size"))
    held = rows.select(F.lit(5).cast("long").alias("__key"), F.lit(1).cast("long").alias("__tie"), F.monotonically_increasing_id().alias("__row"), F.col("size").alias("__size")).cache()
    for least in (1, 4):
        dealt, totals = sharding.cut_ranges(held, least, 50, 32, 7)
        assert sum(n for _, _, n in totals) == 1204 and sum(b for _, b, _ in totals) == held.agg(F.sum("__size")).first()[0]
        assert max(n for _, _, n in totals) <= 100
        assert len(sharding.weighted_sample(dealt, F.col("__size"), sum(b for _, b, _ in totals), 60, 3)) <= 200
    out = sharding.shard_by_size(rows, F.col("k"), F.col("doc_id"), F.col("size"), shards=8, ranges=4, range_rows=50).collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in out) == sorted((d[0] is None, d[1]) for d in data)
    for shard in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    ordered = [r["k"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)


def test_tuples_as_bytes_sort_alike():
    draw = np.random.default_rng(1)
    parts = [draw.integers(-3, 3, 500), draw.integers(-(1 << 63), 1 << 62, 500) * draw.integers(0, 2, 500), draw.integers(-2, 2, 500) << 61]
    by_bytes = np.argsort(sharding.in_order(*parts), kind="stable")
    assert by_bytes.tolist() == sorted(range(500), key=lambda i: tuple(int(p[i]) for p in parts))


def test_sequences(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_dir(spark, "test-sequences")
    rows = sequences.read_sequences(sequences.write_sequences(docs, folder, path, files=3, length=16), folder).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:i]) for i in range(len(ordered))]
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered] == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 9]
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (2, 3))
    folder = shared_dir(spark, "test-sequences")
    assert sequences.read_sequences(sequences.write_sequences(empty, folder, path), folder).collect() == []


def test_decontaminate(docs, empty, benchmark):
    report = decontaminate.contamination_report(decontaminate.find_contamination(docs, benchmark)).collect()
    assert len(report) == len(ROWS)
    by_id = {r["doc_id"]: r for r in report if r["doc_id"] is not None}
    assert (by_id[1]["n_hit"], by_id[1]["n_items"]) == (11, 1)
    assert by_id[9]["items_sha256"] == decontaminate.digest(["7", "null"])
    assert not any(by_id[i]["contaminated"] for i in (2, 3, 4, 5))
    assert decontaminate.find_contamination(empty, benchmark).collect() == []
    clean = decontaminate.contamination_report(decontaminate.find_contamination(docs, benchmark.limit(0))).collect()
    assert len(clean) == len(ROWS) and not any(r["contaminated"] for r in clean)
    in_blocks = decontaminate.contamination_report(decontaminate.find_contamination(docs, benchmark, block_bytes=8)).collect()
    assert sorted(map(repr, in_blocks)) == sorted(map(repr, report))


def test_copies_of_a_benchmark_row_are_read_once(spark, monkeypatch):
    seen, plain = [], decontaminate.text_slices
    monkeypatch.setattr(decontaminate, "text_slices", lambda b: plain(seen.append(x.num_rows) or x for x in b))
    rows = [(1, "one item that many rows repeat word by word")] * 300 + [(k, f"another item with number {k}") for k in range(20)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    blocks = list(decontaminate.benchmark_blocks(bench, "item_id", "text", 100))
    assert sum(seen) == 21 and max(seen) < 15
    assert set().union(*(i for b in blocks for i in b.items.values())) == {str(k) for k in range(20)}


def test_quality(docs, empty, labels):
    rows = quality.judge_quality(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert quality.judge_quality(empty, labels).collect() == []
    unlabelled = quality.judge_quality(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)


def test_factorisation(docs, empty, labels):
    rows = factorisation.score_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert factorisation.score_quality(empty, labels).collect() == []
    assert len({r["score"] for r in factorisation.score_quality(docs, labels.limit(0)).collect()}) == 1
    assert len(factorisation.score_quality(docs.select("doc_id", "text"), labels).collect()) == len(ROWS)


def test_pieces(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode_texts(docs, path).collect()
    assert len(rows) == len(ROWS) and not any(r["n_unequal"] for r in rows)
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (2, 3))
    assert pieces.encode_texts(empty, path).collect() == []


def test_privacy(docs, empty):
    rows = privacy.find_personal_data(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"]: r["n_email"] for r in rows}[5] == 1
    assert sum(r["n_phone"] for r in rows) == 1
    assert privacy.find_personal_data(empty).collect() == []


def test_minhash(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] in (1, 6)} == {(1, 1, True), (6, 1, False)}
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] and r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(empty).collect() == []


def test_chunks(docs, empty):
    rows = chunks.repeated_spans(docs, least_words=8).collect()
    assert {r["doc_id"] for r in rows} - {5} == {1, 6}
    assert chunks.repeated_spans(empty).collect() == []


@pytest.fixture(scope="module")
def tables(spark, labels, benchmark):
    folder = shared_dir(spark, "test-tables")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, empty, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    out, none = stage(spark, docs, tables), stage(spark, empty, tables)
    assert none.collect() == []
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    every = [-1, -1, 1, 2, 3, 4, 5, 6, 6, 9]
    want = {
        "near duplicates": [-1, -1, 1, 2, 3, 4, 5, 9],
        "benchmark decontamination": [-1, -1, 2, 3, 4, 5],
        "personal data": every,
        "piece encoding": every,
    }
    if name in want:
        assert ids == want[name]
    else:
        assert not {2, 3, 4} & set(ids)
    if name == "personal data":
        text = {r["doc_id"]: r["text"] for r in rows}
        assert text[5].endswith("mail <EMAIL> token = abcdef123456") and text[2] is None
        assert "<PHONE>" in next(r["text"] for r in rows if r["doc_id"] is None and r["text"])


def test_contaminated_rows_go_whatever_their_id(spark, tables):
    hit, clean = "so the fox jumps over the lazy dog and then some more words came", "nothing of that kind is in here"
    rows = [(None, hit, "a", 1), (None, clean, "b", 2), (3, hit, "c", 3), (3, clean, None, 4), (4, clean, "e", None), (4, None, "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string, row int")
    out = corpus_pipeline.benchmark_removal(spark, docs, tables)
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(r) for r in rows if r[1] != hit)
    in_blocks = decontaminate.keep_clean(docs, spark.read.parquet(f"{tables}/benchmark.parquet"), 8)
    assert sorted(map(repr, in_blocks.collect())) == sorted(map(repr, out.collect()))
