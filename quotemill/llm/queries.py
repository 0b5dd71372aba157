"""The registered queries: each operator over its whole table with the parameters of production use."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    block_names, disclosure, divergence, dom_model, gated_reader, hypervectors, packing, prefix_bpe, quality_rules, set_sketch,
    token_counts, token_file, zone_search,
)
from .tasks import read_table

END_OF_TOKENS = 2
END_OF_PIECES = 0
SEQUENCE_TOKENS = 2048
TOKEN_LIMIT = 512


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_file.token_files(read_table(spark, sf_dir, "documents"), vocabulary, END_OF_TOKENS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary, END_OF_PIECES, SEQUENCE_TOKENS)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return dom_model.extract(pages, dom_model.learn_model(pages))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_copies(read_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.personal_data(read_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervectors.identify(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_copies(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary, TOKEN_LIMIT)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return prefix_bpe.check_codes(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_search.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_reader.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_file": op1_token_file,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_near_dedup": op4_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}
