"""Corpus pipeline over ``documents``: language ID, exact dedup, near dedup, secret masking, packing.

Each stage takes what its predecessor kept and returns documents (the last: packed pieces).
``run`` applies all of them; the driver writes every stage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passlane.llm import exact_dedup, language, minhash, packing, secret_scan
from passlane.llm.queries import TOKENIZERS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or whose words' languages are uncertain go; mixed languages stay."""
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return minhash.drop_near_copies(docs, words=5, percent=80, rows=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; secrets in their texts are replaced."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json", capacity=2048)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: Trained models and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
