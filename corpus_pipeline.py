"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

Language ID drops documents whose language is not found and sets ``lang``; line dedup
drops repeated lines; the n-gram Jaccard join keeps one document of each group of near
copies; mixing takes sources towards their target weights; the last stage gives ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowlint.llm import jaccard_join, langid, line_dedup, mixing, sentencepiece_viterbi
from sparrowlint.runtime import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

#: Learned and pseudorandom stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
