"""Time splits by day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.config import SPLIT_DAYS

Ranges = Mapping[str, tuple[int, int]]


def split_days(split: str, ranges: Ranges = SPLIT_DAYS) -> tuple[int, int]:
    if split not in ranges:
        raise ValueError(f"split must be one of {sorted(ranges)}")
    return ranges[split]


def in_split(sessions: DataFrame, split: str, ranges: Ranges = SPLIT_DAYS) -> DataFrame:
    """Sessions of the split's days; ``all`` keeps every day.

    On a table partitioned by day this prunes whole partitions.
    """
    first, last = split_days(split, ranges)
    if split == "all":
        return sessions
    return sessions.where(F.col("day").between(first, last))


def missing_days(sessions: DataFrame, split: str, ranges: Ranges = SPLIT_DAYS) -> DataFrame:
    """The days of the split that hold no session; none for ``all``."""
    first, last = split_days(split, ranges)
    expected = sessions.sparkSession.range(
        first, first if split == "all" else last + 1, numPartitions=1
    ).select(F.col("id").cast("int").alias("day"))
    observed = in_split(sessions, split, ranges).select("day").distinct()
    return expected.join(observed, "day", "left_anti")


def day_from_path(path: Column) -> Column:
    """The day in a ``day_NN.parquet`` file name; other names are an error."""
    digits = F.regexp_extract(path, r"day_(\d+)\.parquet$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("no day in file name: "), path)).cast("int")
    )
