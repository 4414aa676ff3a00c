"""Corpus cleaning as a chain of stages; each reads what its predecessor kept.

Stages take documents with ``doc_id``, ``text`` and any other columns, and all but the
last return the columns they got.  NULL texts count as empty; NULL and repeated keys are rows of their
own unless text and key are both equal, of which near-duplicate stages keep one; ties are settled by
key and text hash.  An empty table gives an empty one.  Columns named like a stage's result raise
``ValueError`` where the stage adds columns (``n_lines``, ``n_dropped``, ``n_tokens``, ``ids``, ``decoded``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.catalog.registry import table
from foldwise.llm import byte_bpe, decontam, line_dedup, order_minhash, quality
from foldwise.llm.common import stored
from foldwise.llm.queries import quality_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from ``labels`` outside the held-out keys; without labels nothing is rejected.  NULL and empty
    texts are scored like any other.
    """
    return quality.accepted(docs, quality_model(spark, docs, sf_dir))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all of its text goes.

    NULL and blank texts have no line to lose and stay.  A column ``n_chars``, where there is one, follows the text.
    """
    left = line_dedup.drop_repeated_lines(docs).where("n_dropped = 0 OR trim(text) != ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, the one of the least key.

    Texts without a word, NULL ones with them, are one group.
    """
    return order_minhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; NULL and empty texts and items hold nothing."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document (little-endian unsigned 32-bit), and the text they decode to; NULL as empty."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(docs, ranks, decoded="decoded")
    return found.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", fresh_lines),
    ("near_dedup", distinct_documents),
    ("decontamination", uncontaminated),
    ("byte_bpe", token_ids),
]

# Classifiers, sketches and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
