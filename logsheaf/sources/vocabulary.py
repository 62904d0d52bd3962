"""Stored vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsheaf.schemas import VOCABULARY


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY).parquet(path)


def export_vocabulary_json(vocabulary: DataFrame, path: str) -> None:
    """JSON lines in id order, over as many files as the sort has parts."""
    vocabulary.orderBy("token_id").write.mode("overwrite").json(path)


def read_vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary from JSON lines; ids may be written as text.

    An id that is no integer reads as null, which the vocabulary check rejects.
    """
    return spark.read.schema("token string, token_id string").json(path).select(
        "token", F.col("token_id").try_cast("int").alias("token_id")
    )
