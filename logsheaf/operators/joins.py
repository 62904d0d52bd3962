"""Lookups of a hot-keyed large table in a table of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """In-memory size: the text bytes of all rows, and eight bytes per value."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    row = F.lit(8 * len(df.columns))
    for name in texts:
        row = row + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def lookup_join(
    large: DataFrame, small: DataFrame, on: str, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Left join of ``large`` with ``small``, whose ``on`` values are unique.

    ``small`` must be a written table, so that its size is cheap to read. Up
    to ``max_bytes`` it is broadcast. Beyond, both sides are shuffled and sorted, and
    adaptive execution splits a hot key of ``large`` over several tasks; each of
    them reads the one row of ``small`` again, and no other row is copied.
    """
    if estimated_bytes(small) <= max_bytes:
        return large.join(F.broadcast(small), on, "left")
    return large.join(small.hint("merge"), on, "left")
