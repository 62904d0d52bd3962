"""Exact global row positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf.session import materialize

_ROW_BITS = 33


def with_position(
    df: DataFrame, *order: Column, name: str = "position", weight: str | None = None
) -> DataFrame:
    """Adds the 0-based position of each row under the order ``order``.

    ``order`` must be total: rows with equal keys share a sort task. With
    ``weight``, a row stands for that many rows, and its position is the
    number of rows that come before.

    A distributed sort numbers the rows inside each task. The per-task counts,
    one row per task, give each task's first position. The sorted rows are
    written once, so both readings see the same numbering.
    """
    numbered = materialize(
        df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_row", _ROW_BITS))
    if weight is None:
        count, offset = F.count("*"), F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    else:
        earlier_rows = W.partitionBy("_task").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
        count, offset = F.sum(weight), F.coalesce(F.sum(weight).over(earlier_rows), F.lit(0))
    earlier_tasks = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("_task")
        .agg(count.alias("_rows"))
        .select("_task", F.coalesce(F.sum("_rows").over(earlier_tasks), F.lit(0)).alias("_start"))
    )
    return (
        numbered.withColumn("_offset", offset)
        .join(F.broadcast(starts), "_task")
        .withColumn(name, F.col("_start") + F.col("_offset"))
        .drop("_task", "_row", "_offset", "_start")
    )
