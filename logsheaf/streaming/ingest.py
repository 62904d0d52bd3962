"""Cleaning of raw log events; the same functions serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logsheaf.functions.wire import encode_json
from logsheaf.sources.kafka import DEFAULT_TOPIC, parted_values, topic_records, write_topic

# Lines of health probes, and envelope columns of the shipper.
PROBE_LINES = ("GET /health", "GET /ready", "POST /metrics")
ENVELOPE = ("host", "agent", "ecs", "input", "tags")

DEFAULT_DATASET = "raw_logs"

# (?m) lets ^ and $ match at each line, (?d) makes \n the only line end. Java's
# ^ then no longer matches in an empty text, hence \A\z.
_BLANK_LINE = r"(?md)^\s*$|\A\z"
_PROBE_LINE = "(?md)^(?:" + "|".join(PROBE_LINES) + ")$"


def drop_blank(events: DataFrame, message: str = "message") -> DataFrame:
    """Drops events whose message is missing or holds a blank line."""
    return events.where(F.col(message).isNotNull() & ~F.col(message).rlike(_BLANK_LINE))


def tag_original(
    events: DataFrame, message: str = "message", dataset: str = DEFAULT_DATASET
) -> DataFrame:
    """Moves the message to ``event.original`` and adds ``event.dataset``."""
    original, name = F.col(message), F.lit(dataset)
    if "event" in events.columns and isinstance(events.schema["event"].dataType, T.StructType):
        event = F.col("event").withField("original", original).withField("dataset", name)
    else:
        event = F.struct(original.alias("original"), name.alias("dataset"))
    return events.withColumn("event", event).drop(message)


def drop_probes(events: DataFrame) -> DataFrame:
    """Drops events with a line that is exactly a health probe."""
    return events.where(~F.col("event.original").rlike(_PROBE_LINE))


def drop_envelope(events: DataFrame) -> DataFrame:
    return events.drop(*ENVELOPE)


def clean(
    events: DataFrame, message: str = "message", dataset: str = DEFAULT_DATASET
) -> DataFrame:
    """All ingest steps in order."""
    tagged = tag_original(drop_blank(events, message), message, dataset)
    return drop_envelope(drop_probes(tagged))


def run_to_files(events: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Processes all available events of a stream into files, exactly once."""
    return (
        events.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_parted(
    records: DataFrame, schema: T.StructType, path: str, refused_path: str, checkpoint: str
) -> StreamingQuery:
    """Processes all available records: events go to ``path``, values that are none to ``refused_path``.

    Each micro-batch writes its own folder ``batch=<id>`` in both places, so one
    that is run again after a crash replaces what it wrote, and nothing is
    stored twice. The checkpoint and both places belong together.
    """

    def store(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for rows, place in zip(parted_values(held, schema), (path, refused_path)):
                rows.write.mode("overwrite").parquet(f"{place}/batch={number}")
        finally:
            held.unpersist()

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_to_topic(
    events: DataFrame, servers: str, checkpoint: str, topic: str = DEFAULT_TOPIC, **extra: str
) -> StreamingQuery:
    """Cleans a stream of raw log events and writes it to a topic; ``extra`` are producer settings."""
    return write_topic(clean(events), servers, checkpoint, topic, **extra)


def consume_topic(
    spark: SparkSession,
    servers: str,
    schema: T.StructType,
    path: str,
    refused_path: str,
    checkpoint: str,
    topic: str = DEFAULT_TOPIC,
    **extra: str,
) -> StreamingQuery:
    """Passes the events of a topic on, unchanged, into files; values that are no event go aside.

    ``extra`` holds reader options such as ``startingOffsets``,
    ``maxOffsetsPerTrigger`` and ``kafka.security.protocol``.
    """
    records = topic_records(spark, servers, topic, **extra)
    return run_parted(records, schema, path, refused_path, checkpoint)


def run_as_json(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Like ``run_to_files``, with one JSON text per event, as on the wire."""
    return run_to_files(encode_json(events), path, checkpoint, "text")
