"""Event tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.config import PLACEHOLDER_EVENT_IDS
from logsheaf.functions.text import strip, to_text

TOKEN_FIELDS = ("event_id", "auth_type", "logon_type")


def event_token(event: Column, event_type: T.StructType) -> Column:
    """``event_id_authtype_logontype`` of an event struct.

    A field the schema lacks reads ``NA``; a null value reads ``None``.
    """
    known = {field.name: field.dataType for field in event_type.fields}
    parts = [
        F.coalesce(to_text(event[name], known[name]), F.lit("None"))
        if name in known
        else F.lit("NA")
        for name in TOKEN_FIELDS
    ]
    return F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2])


def token_event_type(schema: T.StructType, column: str = "events") -> T.StructType:
    """The fields of the nested events that tokens need, at least one field."""
    fields = schema[column].dataType.elementType.fields
    return T.StructType([f for f in fields if f.name in TOKEN_FIELDS] or fields[:1])


def token_events(schema: T.StructType, column: str = "events") -> Column:
    """The events reduced to ``token_event_type``, without null ones; empty for no events."""
    names = token_event_type(schema, column).fieldNames()
    present = F.filter(F.col(column), lambda event: event.isNotNull())
    kept = F.transform(present, lambda event: F.struct(*(event[name].alias(name) for name in names)))
    return F.coalesce(kept, F.array())


def token_schema(schema: T.StructType, column: str = "events") -> T.StructType:
    """``schema`` with only those event fields that tokens need, for scans that skip the others."""
    narrow = T.ArrayType(token_event_type(schema, column))
    return T.StructType(
        [T.StructField(f.name, narrow) if f.name == column else f for f in schema.fields]
    )


def session_tokens(schema: T.StructType, column: str = "events") -> Column:
    """The tokens of a session's events, in order; empty for null events."""
    event_type = token_event_type(schema, column)
    return F.transform(
        token_events(schema, column), lambda event: event_token(event, event_type)
    )


def is_placeholder(event_id: Column) -> Column:
    """Whether an event id is missing or a stand-in."""
    return event_id.isNull() | strip(event_id.cast("string")).isin(*PLACEHOLDER_EVENT_IDS)
