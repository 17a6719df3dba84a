"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowlint.llm import ann, jaccard_join, langid, line_dedup, mixing, quality_rules, sentencepiece_viterbi, substring_dedup, token_store, warc
from sparrowlint.llm.common import documents


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_store.stored_documents(documents(spark, sf_dir), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return sentencepiece_viterbi.round_trip(documents(spark, sf_dir), model or public_tokenizers.path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_token_store, op3_sentencepiece, op4_language, op5_substring_dedup, op6_mix, op7_jaccard, op8_quality, op9_line_dedup, op10_revisits)}
ORACLES = {"op10_revisits": warc.REVISITS_SQL}
