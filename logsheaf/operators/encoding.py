"""Token ids, fixed-length sequences, masks and their decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.config import TOKEN_ID_SPARK_TYPES, TokenConfig
from logsheaf.functions.tokens import session_tokens
from logsheaf.operators.joins import BROADCAST_BYTES, lookup_join
from logsheaf.operators.vocabulary import special_ids

KEYS = ("day", "session_id")
TASK_SESSIONS = 10_000


def _keys(df: DataFrame) -> list[str]:
    return [name for name in KEYS if name in df.columns]


def encode_events(
    sessions: DataFrame,
    vocabulary: DataFrame,
    max_bytes: int = BROADCAST_BYTES,
    specials: dict[str, int] | None = None,
) -> DataFrame:
    """One row per session event: its position, token and token id.

    Sessions without events keep one row with null position.
    """
    unk = (specials or special_ids(vocabulary))["[UNK]"]
    events = sessions.select(
        *_keys(sessions), F.posexplode_outer(session_tokens(sessions.schema)).alias("pos", "token")
    )
    return lookup_join(events, vocabulary.select("token", "token_id"), "token", max_bytes).withColumn(
        "token_id", F.when(F.col("pos").isNotNull(), F.coalesce("token_id", F.lit(unk)))
    )


def encode_sessions(
    sessions: DataFrame,
    vocabulary: DataFrame,
    max_bytes: int = BROADCAST_BYTES,
    specials: dict[str, int] | None = None,
) -> DataFrame:
    """Per session: ordered ``token_ids``, ``n_events`` and ``n_unknown``.

    Events of one session stand in one task, so their ids are collected there
    first; the shuffle carries one short row per session.
    """
    specials = specials or special_ids(vocabulary)
    encoded = encode_events(sessions, vocabulary, max_bytes, specials)
    known_position = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))
    return (
        encoded.groupBy(*_keys(sessions))
        .agg(
            F.array_sort(F.collect_list(known_position)).alias("_ids"),
            F.count("pos").alias("n_events"),
            F.count_if(F.col("token_id") == specials["[UNK]"]).alias("n_unknown"),
        )
        .withColumn("token_ids", F.transform("_ids", lambda row: row["token_id"]))
        .drop("_ids")
    )


def trimmed(ids: Column, config: TokenConfig) -> Column:
    """At most ``max_len - 2`` ids: the last ones, or the first ones."""
    room = config.max_len - 2
    if config.truncation_side == "right":
        return F.slice(ids, 1, room)
    return F.slice(ids, F.greatest(F.size(ids) - room, F.lit(0)) + 1, F.lit(room))


def to_sequences(
    encoded: DataFrame, specials: dict[str, int], config: TokenConfig = TokenConfig()
) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` of exactly ``max_len`` items."""
    id_type = TOKEN_ID_SPARK_TYPES[config.token_id_dtype]

    def constant(token: str) -> Column:
        return F.lit(specials[token]).cast("int")

    used = F.size("_ids") + 2
    return (
        encoded.withColumn("_ids", trimmed(F.col("token_ids"), config))
        .withColumn(
            "input_ids",
            F.concat(
                F.array(constant("[CLS]")),
                "_ids",
                F.array(constant("[SEP]")),
                F.array_repeat(constant("[PAD]"), F.lit(config.max_len) - used),
            ).cast(f"array<{id_type}>"),
        )
        .withColumn(
            "attention_mask",
            F.concat(
                F.array_repeat(F.lit(1), used),
                F.array_repeat(F.lit(0), F.lit(config.max_len) - used),
            ).cast("array<tinyint>"),
        )
        .drop("_ids")
    )


def attention_mask(ids: Column, pad_id: int) -> Column:
    """1 for each id but padding, which gives 0."""
    return F.transform(ids, lambda i: F.when(i == pad_id, 0).otherwise(1).cast("tinyint"))


def tokenize(
    sessions: DataFrame,
    vocabulary: DataFrame,
    config: TokenConfig = TokenConfig(),
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Sessions as padded sequences, with counts taken before trimming."""
    specials = special_ids(vocabulary)
    encoded = encode_sessions(sessions, vocabulary, max_bytes, specials)
    return to_sequences(encoded, specials, config).drop("token_ids")


def padded(
    sessions: DataFrame,
    vocabulary: DataFrame,
    chunks: DataFrame,
    n_chunks: int,
    config: TokenConfig = TokenConfig(),
    per_file: int = 1,
) -> DataFrame:
    """``tokenize`` for writing: the short ids of a file go to one task, in order, and are padded there.

    ``chunks`` (day, session_id, chunk) names the ``n_chunks`` chunks to write,
    ``per_file`` neighbours to a file. A task holds one file, or several small
    ones of about ``TASK_SESSIONS`` sessions in all, so that tasks follow the
    sessions and not the chunks.
    """
    specials = special_ids(vocabulary)
    keys = ["day", "session_id"]
    wanted = sessions.join(chunks.select(*keys), keys, "left_semi")
    encoded = encode_sessions(wanted, vocabulary, specials=specials).join(chunks, keys)
    least = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-n_chunks // per_file), max(least, -(-chunks.count() // TASK_SESSIONS))))
    file = F.floor(F.col("chunk") / per_file)
    dealt = encoded.repartitionById(tasks, F.pmod(file, F.lit(tasks)).cast("int"))
    return to_sequences(dealt.sortWithinPartitions("chunk", *keys), specials, config).drop("token_ids")


def decode(
    sequences: DataFrame,
    vocabulary: DataFrame,
    ids: str = "input_ids",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per sequence the ordered ``tokens`` of its ids; unknown ids read [UNK]."""
    items = sequences.select(
        *_keys(sequences), F.posexplode_outer(F.col(ids).cast("array<int>")).alias("pos", "token_id")
    )
    named = lookup_join(items, vocabulary.select("token_id", "token"), "token_id", max_bytes)
    row = F.struct("pos", F.coalesce("token", F.lit("[UNK]")).alias("token"))
    return (
        named.groupBy(*_keys(sequences))
        .agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), row))).alias("_tokens"))
        .withColumn("tokens", F.transform("_tokens", lambda r: r["token"]))
        .drop("_tokens")
    )


def unknown_rate(encoded: DataFrame) -> DataFrame:
    """One row: unknown events and all events of encoded sessions."""
    return encoded.agg(
        F.coalesce(F.sum("n_unknown"), F.lit(0)).alias("unknown_events"),
        F.coalesce(F.sum("n_events"), F.lit(0)).alias("total_events"),
    )
