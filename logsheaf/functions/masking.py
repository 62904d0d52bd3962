"""Masking of variable parts in log messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.config import MESSAGE_MASKS, MASK_NEEDLES


def with_masked(
    df: DataFrame,
    message: Column,
    name: str = "masked",
    masks: Sequence[tuple[str, str]] = MESSAGE_MASKS,
) -> DataFrame:
    """Adds ``message`` with every match of each mask, in order, as ``<NAME>``.

    ``(?U)`` makes Java's ``\\w``, ``\\d`` and ``\\b`` follow Unicode. A mask
    whose matches must hold a certain text only runs where that text occurs.
    The masks are separate columns, so that each one is evaluated once.
    """
    df = df.withColumn(name, message)
    for mask, pattern in masks:
        masked = F.regexp_replace(name, "(?U)" + pattern, f"<{mask}>")
        if mask in MASK_NEEDLES:
            holds = F.contains(F.col(name), F.lit(MASK_NEEDLES[mask]))
            masked = F.when(holds, masked).otherwise(F.col(name))
        df = df.withColumn(name, masked)
    return df
