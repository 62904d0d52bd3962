"""Frequency-ranked token vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsheaf.config import SPECIAL_TOKENS, TOKEN_ID_LIMITS, TokenConfig
from logsheaf.functions.tokens import session_tokens
from logsheaf.operators.ranking import with_position
from logsheaf.schemas import VOCABULARY


def token_counts(sessions: DataFrame) -> DataFrame:
    """How often each token occurs over all session events.

    Overlapping sessions count their shared events each. Counting combines on
    the map side, so a token that dominates costs one row per task.
    """
    return (
        sessions.select(F.explode(session_tokens(sessions.schema)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("count"))
    )


def special_rows(spark: SparkSession, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    if len(set(specials)) != len(specials):
        raise ValueError("special tokens must be unique")
    return spark.createDataFrame([(t, i) for i, t in enumerate(specials)], VOCABULARY)


def rank_tokens(
    counts: DataFrame,
    config: TokenConfig = TokenConfig(),
    specials: Sequence[str] = SPECIAL_TOKENS,
    size: int | None = None,
) -> DataFrame:
    """The vocabulary of ``counts``: specials first, then tokens by rank.

    Tokens seen at least ``min_freq`` times get the following ids by falling
    count, then by token. One that equals a special takes no id. ``size``
    keeps only the first ids.
    """
    frequent = counts.where(
        (F.col("count") >= config.min_freq) & ~F.col("token").isin(*specials)
    )
    learned = with_position(frequent, F.desc("count"), F.col("token")).select(
        "token", (F.col("position") + len(specials)).cast("int").alias("token_id")
    )
    vocabulary = special_rows(counts.sparkSession, specials).unionByName(learned)
    return vocabulary if size is None else vocabulary.where(F.col("token_id") < size)


def vocabulary_stats(vocabulary: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """One row: size, largest id, missing specials, repeated ids and tokens."""
    return vocabulary.agg(
        F.count("*").alias("size"),
        F.max("token_id").alias("max_token_id"),
        (
            F.lit(len(specials))
            - F.countDistinct(F.when(F.col("token").isin(*specials), F.col("token")))
        ).alias("missing_specials"),
        (F.count("*") - F.countDistinct("token_id")).alias("repeated_ids"),
        (F.count("*") - F.countDistinct("token")).alias("repeated_tokens"),
    )


def check_vocabulary(
    vocabulary: DataFrame,
    token_id_dtype: str = "int32",
    min_size: int = 6,
    specials: Sequence[str] = SPECIAL_TOKENS,
) -> None:
    """Raises when the vocabulary cannot be used for encoding."""
    stats = vocabulary_stats(vocabulary, specials).first()
    if stats["missing_specials"]:
        raise ValueError("vocabulary lacks a required special token")
    if stats["repeated_ids"] or stats["repeated_tokens"]:
        raise ValueError("vocabulary holds a token or an id twice, or an id that is not an integer")
    if stats["size"] < min_size:
        raise ValueError(f"{stats['size']} tokens in all, fewer than {min_size}")
    if stats["max_token_id"] > TOKEN_ID_LIMITS[token_id_dtype]:
        raise ValueError(f"id {stats['max_token_id']} is beyond {token_id_dtype}")


def special_ids(vocabulary: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> dict[str, int]:
    """The ids of the special tokens."""
    found = {
        row["token"]: row["token_id"]
        for row in vocabulary.where(F.col("token").isin(*specials))
        .groupBy("token")
        .agg(F.min("token_id").alias("token_id"))
        .collect()
    }
    missing = [token for token in specials if token not in found]
    if missing:
        raise ValueError(f"vocabulary lacks required special tokens: {missing}")
    return found
