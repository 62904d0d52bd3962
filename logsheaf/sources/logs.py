"""Raw log lines from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per line: ``value``, and ``line_ord`` for the order of lines.

    Bytes that are not UTF-8 are replaced. ``line_ord`` sorts lines as they
    stand in the files, files by path; the row number alone would not, because
    Spark packs file blocks by size. The path stays null for a single file,
    where it decides nothing and would only widen every shuffled row.
    """
    lines = spark.read.text(list(paths))
    path = F.col("_metadata.file_path")
    if len(lines.inputFiles()) == 1:
        path = F.lit(None).cast("string")
    return lines.select(
        F.make_valid_utf8("value").alias("value"),
        F.struct(
            path.alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_ord"),
    )
