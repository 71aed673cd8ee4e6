"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next stage's documents. All stages but the last return the columns of
``documents``. Part of the ``llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellscope.llm import mixing, packing, pii, quality_rules, simhash
from cellscope.llm._common import documents, stored
from cellscope.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; lines that fail are gone from their texts."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.near_dedup(docs, size=5, bits=512, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

# Fingerprints, span classifiers and token ids have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
