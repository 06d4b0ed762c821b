"""The thin queries of the operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelcraft.llm import (ann, bpe, divergence, html_crf, line_dedup, mixing, ngram_join, pii, prefix_trie,
                            quality, suffix_dedup, token_files, toxicity)
from panelcraft.llm.store import Scratch, documents

def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("ids")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                                  special_ids=True)
    return token_files.with_crc(token_files.read_token_files(spark, path))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = prefix_trie.turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.branches(sequences))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_ngram_jaccard_join, op3_source_mixing, op4_toxicity, op5_nearest_neighbours, op6_line_dedup,
    op7_token_files, op8_html_extraction, op9_quality_rules, op10_personal_data,
    op11_conversation_trie, op12_source_divergence, op13_suffix_array_dedup)}
ORACLE_SQL = {"op3_source_mixing": mixing.ORACLE_SQL, "op5_nearest_neighbours": ann.ORACLE_SQL,
              "op6_line_dedup": line_dedup.ORACLE_SQL, "op11_conversation_trie": prefix_trie.ORACLE_SQL,
              "op12_source_divergence": divergence.ORACLE_SQL, "op13_suffix_array_dedup": suffix_dedup.ORACLE_SQL}
