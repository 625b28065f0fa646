"""A corpus pipeline over ``documents``: language, quality, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. What it
returns is written to the shared folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import jaccard, language, packing, quality
from gaugeworks.session import checkpointed

NEAR_WORDS = 5
NEAR_PERCENT = 80
PACKING_WORDS = 120_000  # workers go through all stages, so they remember fewer words


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their labels teach."""
    return language.keep_known(docs, language.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules learned from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8."""
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, path, remember=PACKING_WORDS)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("packing", packed),
]

# learned languages and rules, and ids of a tokenizer: SQL cannot express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; the pieces that the last one packs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
