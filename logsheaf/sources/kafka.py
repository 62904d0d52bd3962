"""Kafka topics with JSON values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logsheaf.functions.wire import decode_checked, decode_json, encode_json

DEFAULT_TOPIC = "raw-logs"


# What a topic tells about each value, kept with the values that are refused.
ORIGIN = ("topic", "partition", "offset", "timestamp")


def kafka_options(servers: str, topic: str = DEFAULT_TOPIC, **extra: str) -> dict[str, str]:
    """Reader options; ``extra`` holds offsets, rates and, as ``kafka.*``, security settings."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, **extra}


def decode_values(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns that the JSON text in ``value`` holds."""
    return records.select(decode_json(F.col("value"), schema).alias("_event")).select("_event.*")


def parted_values(records: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Events of the fit JSON texts in ``value``, and the others: text, and where it came from."""
    event, fit = decode_checked(F.col("value"), schema)
    marked = records.withColumns({"_event": event, "_fit": fit})
    origin = [name for name in ORIGIN if name in records.columns]
    refused = marked.where(~F.col("_fit")).select(F.col("value").cast("string").alias("value"), *origin)
    return marked.where("_fit").select("_event.*"), refused


def topic_records(
    spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC, **extra: str
) -> DataFrame:
    """A streaming DataFrame of a topic's records, values undecoded."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **extra)).load()


def read_topic(
    spark: SparkSession, servers: str, schema: T.StructType, topic: str = DEFAULT_TOPIC, **extra: str
) -> DataFrame:
    """A streaming DataFrame of a topic's events; values that are no event give null columns."""
    return decode_values(topic_records(spark, servers, topic, **extra), schema)


def write_topic(
    events: DataFrame, servers: str, checkpoint: str, topic: str = DEFAULT_TOPIC, **extra: str
) -> StreamingQuery:
    """Starts writing each event as one JSON value; ``extra`` holds producer settings as ``kafka.*``."""
    return (
        encode_json(events)
        .writeStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "topic": topic, **extra})
        .option("checkpointLocation", checkpoint)
        .start()
    )
