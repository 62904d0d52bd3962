"""Chunks of token sequences: assignment, checks, manifest, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.config import TokenConfig
from logsheaf.operators.ranking import with_position

FILES, FILE_SESSIONS = 1_000, 10_000


def assign_chunks(sequences: DataFrame, chunk_size: int, *order: Column) -> DataFrame:
    """Adds ``chunk``: consecutive ``chunk_size`` rows under ``order`` share one.

    The rows are sorted and written once, so pass keys rather than sequences.
    """
    if chunk_size <= 0:
        raise ValueError("chunk_size must be > 0")
    positioned = with_position(sequences, *order, name="_position")
    return positioned.withColumn(
        "chunk", F.floor(F.col("_position") / chunk_size).cast("bigint")
    ).drop("_position")


def row_is_valid(max_len: int) -> Column:
    """Whether a stored sequence has its key and two arrays of full length."""
    return F.coalesce(
        F.col("session_id").isNotNull()
        & (F.size("input_ids") == max_len)
        & (F.size("attention_mask") == max_len),
        F.lit(False),
    )


def chunk_report(sequences: DataFrame, max_len: int) -> DataFrame:
    """One row per chunk: split, number, rows, invalid rows, event counts."""
    return sequences.groupBy("split", "chunk").agg(
        F.count("*").alias("sessions"),
        F.count_if(~row_is_valid(max_len)).alias("invalid_rows"),
        F.sum("n_unknown").alias("unknown_events"),
        F.sum("n_events").alias("total_events"),
    )


def numbered_chunks(sessions: DataFrame, chunk_size: int) -> DataFrame:
    """(day, session_id, chunk) of all sessions, in the order of days and ids.

    Chunks are numbered from 0 without gaps and hold ``chunk_size`` sessions
    each, the last one the rest, however the input is partitioned.
    """
    keys = sessions.select("day", "session_id")
    return assign_chunks(keys, chunk_size, F.col("day"), F.col("session_id"))


def chunks_per_file(n_chunks: int, chunk_size: int) -> int:
    """How many neighbouring chunks share a stored file: one, while chunks are few or large.

    Beyond ``FILES`` chunks, small ones share files of at most ``FILE_SESSIONS``
    sessions, so that the number of files follows the sessions.
    """
    return max(1, min(-(-n_chunks // FILES), FILE_SESSIONS // chunk_size))


def sound_chunks(expected: DataFrame, stored: DataFrame, max_len: int) -> DataFrame:
    """The chunks whose stored rows are valid and exactly the expected sessions.

    ``stored`` is read so that damaged files count as empty: a chunk that was cut
    off, lost or changed lacks rows that it should have.
    """
    keys = ["day", "session_id"]
    wanted = expected.groupBy("chunk").agg(F.count("*").alias("expected"))
    placed = expected.withColumnRenamed("chunk", "_chunk")
    right = F.coalesce((F.col("_chunk") == F.col("chunk")) & row_is_valid(max_len), F.lit(False))
    found = (
        stored.join(placed, keys, "left")
        .groupBy("chunk")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(~right).alias("wrong"),
            F.count_distinct(*keys).alias("sessions"),
        )
    )
    whole = (F.col("rows") == F.col("expected")) & (F.col("sessions") == F.col("expected"))
    return wanted.join(found, "chunk").where(whole & (F.col("wrong") == 0)).select("chunk")


def valid_days(sequences: DataFrame, max_len: int) -> DataFrame:
    """The days whose stored sequences are all valid."""
    return (
        sequences.groupBy("day")
        .agg(F.bool_and(row_is_valid(max_len)).alias("valid"))
        .where("valid")
        .select("day")
    )


def manifest(sequences: DataFrame, config: TokenConfig) -> DataFrame:
    """One row: chunks, sessions, sequence length, unknown and all events."""
    return chunk_report(sequences, config.max_len).agg(
        F.count("*").alias("chunk_count"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("session_count"),
        F.lit(config.max_len).alias("max_len"),
        F.coalesce(F.sum("unknown_events"), F.lit(0)).alias("unknown_events"),
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("invalid_rows"), F.lit(0)).alias("invalid_rows"),
    )


def is_complete(manifest_row: DataFrame, expected_sessions: int) -> bool:
    """Whether a manifest covers the expected sessions without a bad row."""
    row = manifest_row.first()
    return (
        row is not None
        and row["session_count"] == expected_sessions
        and row["invalid_rows"] == 0
        and row["chunk_count"] > 0
    )


def pending(sessions: DataFrame, done: DataFrame) -> DataFrame:
    """Sessions that have no stored sequence yet."""
    return sessions.join(done.select("day", "session_id"), ["day", "session_id"], "left_anti")
