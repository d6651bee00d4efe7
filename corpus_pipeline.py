"""Documents to training text: quality rules, near duplicates, benchmark passages, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its decisions take effect in the rows or
texts it returns. ``run`` writes each stage to the shared folder and reads it back, as a scheduler would.

Nulls, empty texts, repeated rows and other columns are treated as the operators' docstrings say: a null or empty text has
no words and is rejected by the first stage; rows with a null id are kept by the second and treated alike by the others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm.common import release, small_batches, stored, table
from cohortry.llm.decontaminate import keep_clean
from cohortry.llm.minhash import near_duplicates
from cohortry.llm.pieces import encode_texts
from cohortry.llm.privacy import redact
from cohortry.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the fixed counts or the n-gram regression's threshold go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the least id; of fully equal rows one stays."""
    small_batches(spark)
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, docs["doc_id"].cast("long") == F.col("kept_id"), "left_semi")
    return named.dropDuplicates().unionByName(docs.filter(F.col("doc_id").isNull()))


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go, whatever their id."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in the text."""
    small_batches(spark)
    return redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its piece ids, and the digest of the text decoded from them."""
    small_batches(spark)
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicate_removal),
    ("benchmark decontamination", benchmark_removal),
    ("personal data", personal_data_removal),
    ("piece encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            release(before)
        before = docs
    return docs


#: The trained stages (quality, personal data) have no SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None
