"""Text and number coercion with Python's rules, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Python's str.strip() removes; none lies above U+3000.
PYTHON_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def parse_int(text: Column) -> Column:
    """The integer a text stands for, or null. Digit groups may use ``_``."""
    bare = strip(text)
    grouped = F.when(
        F.contains(bare, F.lit("_")) & bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)+$"),
        F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint"),
    )
    return F.coalesce(bare.try_cast("bigint"), grouped)


def to_int(column: Column, data_type: T.DataType) -> Column:
    """``column`` as LONG, or null where it holds no integer."""
    if isinstance(data_type, T.StringType):
        return parse_int(column)
    return column.try_cast("bigint")


def to_text(column: Column, data_type: T.DataType) -> Column:
    """``column`` as text; booleans print as True and False."""
    if isinstance(data_type, T.BooleanType):
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    return column.cast("string")


def truthy(column: Column, data_type: T.DataType) -> Column:
    """``column`` as text where it is not null, empty, zero or false."""
    text = to_text(column, data_type)
    if isinstance(data_type, T.BooleanType):
        return F.when(column, text)
    if isinstance(data_type, T.NumericType):
        return F.when(column != 0, text)
    return F.when(text != "", text)


def floor_div(numerator: Column, divisor: int) -> Column:
    """Whole-number division that rounds down, also below zero."""
    return ((numerator - F.pmod(numerator, F.lit(divisor))) / divisor).cast("bigint")
