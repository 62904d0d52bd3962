"""From raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logsheaf.llm.decontamination import decontaminate
from logsheaf.llm.jaccard_join import deduplicated
from logsheaf.llm.language import train, with_language
from logsheaf.llm.packing import pack
from logsheaf.llm.secret_scan import new_ledger, redact
from logsheaf.llm.workload import TOKENIZER
from logsheaf.session import discard, materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return with_language(docs, train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return redact(docs, new_ledger(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents, packed into sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

# Tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each starts from the written result before.

    A written result goes when the next one is written; the last one stays, as packing reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        after = materialize(stage(spark, docs, sf_dir))
        if at:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
