"""The corpus pipeline: from raw documents to packed token sequences.

Each stage works on all that the one before kept, and is written below `spark.checkpoint.dir` and read again, so a lost
executor repeats tasks of one stage only. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameglass.llm import exact_dedup, language, packing, quality, simhash
from frameglass.llm.queries import tokenizer
from frameglass.session import scratch_path

#: A document whose likeliest language has a smaller share of it is of no one language.
LEAST_SHARE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules, hard limits or a bad standing of their host reject go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that holds `LEAST_SHARE` of them, go; `lang` is what was inferred."""
    return language.keep_known(docs, min_score=LEAST_SHARE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal fingerprints the document with the smallest id stays."""
    return simhash.keep_one(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as pieces of sequences of at most 4096 ids, with their ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("packing", packed_sequences),
]

# Inferred languages, fingerprints and tokens have no SQL; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
