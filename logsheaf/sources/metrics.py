"""Counters of job runs, as an append-only table."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = "job string, event string, name string, value bigint"


def write_metrics(
    spark: SparkSession, path: str | None, job: str, event: str, values: Mapping[str, int]
) -> None:
    """Appends one row per counter; does nothing without a path."""
    if path:
        rows = [(job, event, name, int(value)) for name, value in values.items()]
        (
            spark.createDataFrame(rows, METRICS)
            .withColumn("at", F.current_timestamp())
            .coalesce(1)
            .write.mode("append")
            .parquet(path)
        )


def write_chunk_metrics(
    spark: SparkSession, path: str, job: str, chunks: str, kept: Collection[int] = ()
) -> None:
    """Appends two rows per chunk of the list at ``chunks`` but those ``kept``: chunks and sessions up to it.

    The list has one narrow row per chunk, so a window over all of them is small.
    """
    order = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    so_far = spark.read.parquet(chunks).withColumn("processed_sessions", F.sum("sessions").over(order))
    written = so_far.where(~F.col("chunk").isin(list(kept))) if kept else so_far
    values = F.create_map(
        F.lit("chunk_count"), F.col("chunk") + 1, F.lit("processed_sessions"), F.col("processed_sessions")
    )
    (
        written.select(
            F.lit(job).alias("job"), F.lit("chunk_written").alias("event"), F.explode(values).alias("name", "value")
        )
        .withColumn("at", F.current_timestamp())
        .write.mode("append")
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS + ", at timestamp").parquet(path)
