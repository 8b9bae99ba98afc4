"""Registered queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import best_two_fit, bottomk, chat_tree, ivfpq, license_patience, mixing, quality_mcd, secret_novelty, suffix_dedup, token_counts
from umbra.llm._common import table

#: The added conversation: control strings of common chat templates as plain text.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat_tree.read_back(*chat_tree.prefix_tree(rows.unionByName(extra), tokenizer), tokenizer)


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mcd.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_novelty.scan_secrets(table(spark, sf_dir, "documents"))


def op5_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ivfpq.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("removed")


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), thin=True)
    return out.select("doc_id", F.col("epoch").cast("int").alias("epoch"), "n_tokens")


def op10_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_patience.scan_licenses(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_tree, op2_quality_mcd, op3_token_counts, op4_secret_novelty, op5_ivfpq, op6_suffix_dedup, op7_best_two_fit, op8_bottomk, op9_mixing, op10_license_patience, pipeline)}

#: Nearest neighbours are approximate, and the other operators hash, encode or iterate: no SQL for those.
ORACLES: dict[str, str] = {}
