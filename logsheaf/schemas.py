"""Declared schemas of the stored and exchanged tables."""

from pyspark.sql import types as T

LINE_ORDER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

AUTH_EVENT = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("src_user", T.StringType()),
        T.StructField("dst_user", T.StringType()),
        T.StructField("src_computer", T.StringType()),
        T.StructField("dst_computer", T.StringType()),
        T.StructField("auth_type", T.StringType()),
        T.StructField("logon_type", T.StringType()),
        T.StructField("auth_orientation", T.StringType()),
        T.StructField("success", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("is_success", T.BooleanType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("line_ord", LINE_ORDER),
    ]
)

SESSION_EVENT = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("auth_type", T.StringType()),
        T.StructField("logon_type", T.StringType()),
        T.StructField("auth_orientation", T.StringType()),
        T.StructField("success", T.StringType()),
        T.StructField("is_success", T.BooleanType()),
        T.StructField("template_id", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
    ]
)

SESSION = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("host_id", T.StringType()),
        T.StructField("start_ts", T.LongType()),
        T.StructField("end_ts", T.LongType()),
        T.StructField("events", T.ArrayType(SESSION_EVENT)),
        T.StructField("label", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
    ]
)

TEMPLATE = T.StructType(
    [
        T.StructField("signature", T.StringType()),
        T.StructField("template_id", T.IntegerType()),
        T.StructField("template", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("first_seen", T.LongType()),
        T.StructField("n_events", T.LongType()),
    ]
)

TEMPLATE_ALIAS = T.StructType(
    [
        T.StructField("template_id", T.IntegerType()),
        T.StructField("merged_into", T.IntegerType()),
    ]
)

VOCABULARY = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("token_id", T.IntegerType()),
    ]
)

LOGS_RAW = T.StructType(
    [
        T.StructField("@timestamp", T.TimestampType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("source_ip", T.StringType()),
    ]
)

# The field names of parsed logs, alerts and risk profiles.
LOGS_PARSED = T.StructType(
    [
        T.StructField("@timestamp", T.TimestampType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("template_id", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("parsed_fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("log_level", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("@timestamp", T.TimestampType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("template_id", T.StringType()),
        T.StructField(
            "mitre",
            T.StructType(
                [
                    T.StructField("tactic", T.StringType()),
                    T.StructField("technique", T.StringType()),
                    T.StructField("technique_id", T.StringType()),
                ]
            ),
        ),
        T.StructField("model_version", T.StringType()),
    ]
)

RISK_PROFILES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("anomaly_count", T.IntegerType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
