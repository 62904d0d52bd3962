"""JSON values on the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_json(df: DataFrame, value: str = "value") -> DataFrame:
    """One JSON text per row, from all columns."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns])).alias(value))


def decode_json(value: Column, schema: T.StructType) -> Column:
    """The struct a JSON text holds."""
    return F.from_json(value.cast("string"), schema)


def decode_checked(value: Column, schema: T.StructType) -> tuple[Column, Column]:
    """The struct a JSON text holds, and whether the text is fit for it.

    Unfit are null, broken texts, other values than objects, and objects with a
    value of another type than the schema's.
    """
    broken = "_broken"
    while broken in schema.names:
        broken += "_"
    marked = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    parsed = F.from_json(
        value.cast("string"), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    )
    event = F.struct(*[parsed[f"`{name}`" if "." in name else name].alias(name) for name in schema.names])
    return event, parsed.isNotNull() & parsed[broken].isNull()
