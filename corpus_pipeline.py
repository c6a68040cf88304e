"""The corpus pipeline: documents through five operators of payproof.llm, each stage written as Parquet and read again.

Every stage works on all that the one before kept, and all but the last return the columns of documents.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.llm import bpe, minhash, mixing, quality, suffixes
from payproof.scale import shared_folder

LINKED = 80         # percent: near-duplicates on word shingles are linked from this similarity on
#: 51 words of prose take 205 bytes and more in samples of the test tables; a repeated passage goes if it has so many words, or 400 bytes.
REPEATED, PASSAGE = 200, 51
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.judged(docs, out="__quality").where("__quality.kept").drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of LINKED percent and more stays: the one with the smallest doc_id. Documents without doc_id stay; rows with
    one doc_id are one document and stay or go together."""
    gone = minhash.near_duplicates(docs, percent=LINKED).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of REPEATED that stand elsewhere too go, where they make up PASSAGE words or the 400 bytes of op7. Characters
    that a removal cut in two go with it, and so do documents of which nothing but white space is left; n_chars counts what is left."""
    return suffixes.without_repeats(docs, REPEATED, PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids of each document of the mix."""
    return bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "source", "lang"])


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_bytes), ("source mix", mixed), ("byte-level BPE", token_ids)]
#: Hashed n-gram weights, hash minima and token ids are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
