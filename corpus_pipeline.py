"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing; every stage reads what the last one wrote.

Documents have doc_id, text, lang, source and n_chars; further columns are dropped by the first stage, whatever their
names. Each stage says what it does with nulls, ties and repeated rows; an empty table gives an empty table, and very
long texts are handled whole, everywhere.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import best_two_fit, bottomk, mixing, quality_mcd, secret_novelty
from umbra.llm._common import checkpointed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts have no words and go; null lang and source are groups; rows that
    repeat are judged alike, each for itself."""
    return quality_mcd.keep_good(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Documents without an id or
    without words are in no group and stay; of rows that repeat an id one stays."""
    return bottomk.keep_first(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by markers, and n_chars follows the text; all rows stay, null texts and n_chars null."""
    out = secret_novelty.scan_secrets(docs, keep=("doc_id", "lang", "source", "n_chars"), redact=True)
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("n_chars").isNotNull(), F.length("redacted").cast("long")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights; one drawn in several epochs comes several times. Null lang and source
    are leaves; texts without tokens cost nothing and come once; rows that repeat are drawn alike."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4,096. A null text is an end id alone; rows that repeat are
    packed each for itself."""
    return best_two_fit.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("minhash near-dedup", near_dedup), ("secret scans", secrets), ("source mixing", mixture), ("best-fit packing", packing)]

#: Sketches, compression and tokenization have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages, tables in the shared checkpoint folder are written and read again,
    and each goes when the next is there. The last is read by the result and stays until the folder is cleared."""
    docs = table(spark, sf_dir, "documents")
    checkpointed(spark.range(0))  # makes sure that there is a shared folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
