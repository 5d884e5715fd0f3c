"""Training-data pipeline over the documents table: language, near-duplicates, benchmark leaks, personal data, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import bpe, decontaminate, langid, pii, simhash
from veriframe.llm.common import stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter, and those whose two nearest languages can't be told apart."""
    model = langid.train(docs.filter(~langid.held_out(langid.HOLD)))
    own = "_" * (2 + max(len(c) for c in docs.columns))  # no column's name
    judged = langid.predict(docs, model, docs.columns, prefix=own)
    kept: Column = (F.col(f"{own}lang_pred") != "und") & ~F.col(f"{own}ambiguous")
    return judged.filter(kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group; word shingles of five, similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, and no others of their doc_id."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars is that of the new text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers)."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("token_ids", token_ids)]

ORACLE_SQL = None  # language models and byte-pair merges are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
