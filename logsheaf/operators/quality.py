"""Data-quality reports and guards over events and sessions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.config import SPECIAL_TOKENS
from logsheaf.functions.tokens import (
    event_token,
    is_placeholder,
    token_event_type,
    token_events,
)


def _n_events(sessions: DataFrame) -> Column:
    """Events per session, from one nested field, so that no other is read."""
    name = sessions.schema["events"].dataType.elementType.fieldNames()[0]
    return F.coalesce(F.greatest(F.size(F.col(f"events.{name}")), F.lit(0)), F.lit(0))


def coerce_events(sessions: DataFrame, event_type: T.StructType, column: str = "events") -> DataFrame:
    """Reads events that arrive as JSON text of any shape, or as typed lists.

    Null gives an empty list. Text that is not a list gives an empty list and
    counts in ``invalid_event_containers``; list elements that are no objects
    are left out and count in ``dropped_events``. In typed lists only null
    elements can be malformed.
    """
    if isinstance(sessions.schema[column].dataType, T.ArrayType):
        kept = F.filter(column, lambda event: event.isNotNull())
        lost = F.coalesce(F.size(column) - F.size(kept), F.lit(0))
        return sessions.withColumns(
            {
                "invalid_event_containers": F.lit(0),
                "dropped_events": lost,
                column: F.coalesce(kept, F.array()),
            }
        )
    array = F.array().cast(T.ArrayType(event_type))
    ddl = event_type.simpleString()
    raw, value, items, kept = F.col(column), F.col("_value"), F.col("_items"), F.col("_kept")
    return (
        sessions.withColumn("_value", F.try_parse_json(raw))
        .withColumn("_items", F.try_variant_get(value, "$", "array<variant>"))
        .withColumn(
            "_kept", F.filter(items, lambda item: F.schema_of_variant(item).startswith("OBJECT"))
        )
        .withColumns(
            {
                "invalid_event_containers": F.when(
                    raw.isNotNull()
                    & items.isNull()
                    & (value.isNull() | (F.schema_of_variant(value) != "VOID")),
                    1,
                ).otherwise(0),
                "dropped_events": F.coalesce(F.size(items) - F.size(kept), F.lit(0)),
                column: F.coalesce(
                    F.transform(kept, lambda item: F.try_variant_get(item, "$", ddl)), array
                ),
            }
        )
        .drop("_value", "_items", "_kept")
    )


def malformed_counters(coerced: DataFrame) -> DataFrame:
    """One row: invalid containers and dropped events."""
    return coerced.agg(
        F.coalesce(F.sum("invalid_event_containers"), F.lit(0)).alias("invalid_event_containers"),
        F.coalesce(F.sum("dropped_events"), F.lit(0)).alias("dropped_events"),
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row: sessions, sessions with events, events over all sessions."""
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(_n_events(sessions) > 0).alias("non_empty_sessions"),
        F.coalesce(F.sum(_n_events(sessions)), F.lit(0)).alias("total_events"),
    )


def rows_per_day(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.groupBy("day").agg(F.count("*").alias(name))


def token_quality(sessions: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: events, placeholder event ids, distinct tokens."""
    event_type = token_event_type(sessions.schema)
    has_id = "event_id" in event_type.fieldNames()
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    event = F.col("event")
    return sessions.select(F.explode(token_events(sessions.schema)).alias("event")).select(
        (is_placeholder(event["event_id"]) if has_id else F.lit(True)).alias("placeholder"),
        event_token(event, event_type).alias("token"),
    ).agg(
        F.count("*").alias("total_events"),
        F.count_if("placeholder").alias("missing_event_ids"),
        distinct("token").alias("distinct_tokens"),
    )


# 2**14 registers: the estimate's standard error is below one percent.
SKETCH_SIZE = 14


def token_sketches(sessions: DataFrame) -> DataFrame:
    """One row per day, to be stored beside it: (day, total_events, missing_event_ids, sketch).

    The sketch counts distinct tokens; those of any days join without reading events again.
    """
    event_type = token_event_type(sessions.schema)
    has_id = "event_id" in event_type.fieldNames()
    event = F.col("event")
    return (
        sessions.select("day", F.explode(token_events(sessions.schema)).alias("event"))
        .select(
            "day",
            (is_placeholder(event["event_id"]) if has_id else F.lit(True)).alias("placeholder"),
            event_token(event, event_type).alias("token"),
        )
        .groupBy("day")
        .agg(
            F.count("*").alias("total_events"),
            F.count_if("placeholder").alias("missing_event_ids"),
            F.hll_sketch_agg("token", SKETCH_SIZE).alias("sketch"),
        )
    )


def quality_of_days(sketches: DataFrame) -> DataFrame:
    """``token_quality`` of the days of stored sketches, distinct tokens estimated."""
    return sketches.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("missing_event_ids"), F.lit(0)).alias("missing_event_ids"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_tokens"),
    )


def token_warnings(quality: DataFrame, vocabulary_size: int, min_distinct: int = 50) -> list[str]:
    """Texts that describe a suspicious token space; empty when it looks sound."""
    row = quality.first()
    learned = max(0, vocabulary_size - len(SPECIAL_TOKENS))
    found = []
    if row["total_events"] and row["missing_event_ids"]:
        found.append(
            f"{row['missing_event_ids']} of {row['total_events']} events have no id of their own"
        )
    if row["total_events"] >= min_distinct and learned < min_distinct:
        found.append(
            f"only {learned} tokens learned, where the events show {row['distinct_tokens']}"
        )
    return found


def require_events(sessions: DataFrame) -> None:
    """Raises when no session holds an event."""
    if sessions.where(_n_events(sessions) > 0).isEmpty():
        raise RuntimeError("no session holds any event")


def id_collisions(events: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Pseudonymous ids that stand for several names: (kind, id, names).

    ``pairs`` names each id column and that of its ``identity_check``. No name is
    kept or read. Distinct pairs combine on the map side.
    """
    found = None
    for id, check in pairs.items():
        distinct = events.where(F.col(check).isNotNull()).select(F.col(id).alias("id"), F.col(check).alias("check"))
        rows = (
            distinct.distinct()
            .groupBy("id")
            .agg(F.count("*").alias("names"))
            .where(F.col("names") > 1)
            .select(F.lit(id).alias("kind"), "id", "names")
        )
        found = rows if found is None else found.unionByName(rows)
    return found
