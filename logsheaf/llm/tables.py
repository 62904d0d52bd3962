"""Joins with tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A written table of narrow rows, marked for broadcasting up to ``rows`` of them.

    With ``weight``, say the length of a list in each row, its sum counts
    instead. Beyond that the join shuffles both sides, with the same result.
    """
    total = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if total <= rows else table


def spare(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no table has a column of that name."""
    taken = {column.lower() for table in tables for column in table.columns}
    while name in taken:
        name += "_"
    return name
