"""From raw authentication log lines to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logsheaf.config import AUTH_COLUMNS_7, AUTH_COLUMNS_9, SECONDS_PER_DAY, SUCCESS_VALUES
from logsheaf.functions.text import floor_div, parse_int, strip


def day_index(time: Column, units_per_second: int = 1) -> Column:
    """The 1-based day of a time value counted from day 1."""
    return (floor_div(time, SECONDS_PER_DAY * units_per_second) + 1).cast("int")


def is_success(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin(*SUCCESS_VALUES), F.lit(False))


def _with_fields(lines: DataFrame, line: str) -> DataFrame:
    """Adds nine fields in place of the line, and the parsed time.

    Both are null for a malformed line.
    """
    parts = F.col("_parts")
    short = [
        F.get(parts, F.lit(AUTH_COLUMNS_7.index(name))) if name in AUTH_COLUMNS_7 else F.lit("UNKNOWN")
        for name in AUTH_COLUMNS_9
    ]
    fields = F.when(F.size(parts) == len(AUTH_COLUMNS_9), parts).when(
        F.size(parts) == len(AUTH_COLUMNS_7), F.array(*short)
    )
    return (
        lines.withColumn("_parts", F.split(strip(F.col(line)), ",", -1))
        .withColumn("_fields", fields)
        .drop("_parts", line)
        .withColumn("_time", parse_int(F.get("_fields", F.lit(0))))
        .withColumn("_day", day_index(F.col("_time")))
    )


def _line_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_lines"),
        F.count("_time").alias("parsed_lines"),
        F.count_if(F.col("_time").isNull()).alias("skipped_lines"),
    ]


def parse_auth_lines(
    lines: DataFrame, line: str = "value", observation: Observation | None = None
) -> DataFrame:
    """AUTH_EVENT rows of the well-formed lines; other lines are dropped.

    A line has nine or seven comma-separated fields without quoting, the first
    an integer time. Further input columns, such as ``line_ord``, stay.

    The ``observation`` receives the line counts while the rows pass, which
    saves a second reading of the text. Observing also keeps the filter above
    the split: pushed below it, the filter would split each line again. On a
    stream the counts go to query listeners under the name ``auth_lines``.
    """
    rest = [name for name in lines.columns if name != line]
    observer = "auth_lines" if lines.isStreaming else observation or Observation()
    split = _with_fields(lines, line).observe(observer, *_line_counts())
    named = [
        F.get("_fields", F.lit(position)).alias(name)
        for position, name in enumerate(AUTH_COLUMNS_9)
        if position > 0
    ]
    return (
        split.where(F.col("_time").isNotNull())
        .select(F.col("_time").alias("time"), *named, *rest, F.col("_day").alias("day"))
        .withColumns(
            {
                "user": F.col("src_user"),
                "host": F.col("src_computer"),
                "is_success": is_success(F.col("success")),
            }
        )
    )


def in_days(df: DataFrame, start_day: int, end_day: int) -> DataFrame:
    """Rows of the inclusive day range."""
    if start_day < 1:
        raise ValueError("start_day must be >= 1")
    if end_day < start_day:
        raise ValueError("end_day must be >= start_day")
    return df.where(F.col("day").between(start_day, end_day))


def parse_counters(lines: DataFrame, start_day: int, end_day: int, line: str = "value") -> DataFrame:
    """One row: total, parsed and skipped lines, kept events, days with events."""
    kept = F.col("_day").between(start_day, end_day)
    return (
        _with_fields(lines, line)
        .select("_time", F.when(kept, F.col("_day")).alias("_day"))
        .agg(
            *_line_counts(),
            F.count("_day").alias("bucketed_events"),
            F.countDistinct("_day").alias("processed_days"),
        )
    )
