"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quotemill.llm import block_names, disclosure, packing, quality_rules, set_sketch
from quotemill.llm.queries import END_OF_PIECES, SEQUENCE_TOKENS
from quotemill.llm.tasks import read_table
from quotemill.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    rules = quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.drop_poor(docs, rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return block_names.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays."""
    return set_sketch.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal whom it belongs to, are replaced; ``n_chars`` follows the text."""
    return disclosure.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_OF_PIECES, SEQUENCE_TOKENS)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("pack", pack)]
# learned rules, sketches and tokenizers are beyond SQL; the tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
