"""Pseudonymous user and host ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.config import HOST_CANDIDATES, USER_CANDIDATES
from logsheaf.functions.text import strip, truthy


def pseudonym(raw: Column, hex_chars: int = 8) -> Column:
    """The first hex characters of SHA-256; ``UNKNOWN`` for null or blank."""
    bare = F.nullif(strip(raw.cast("string")), F.lit(""))
    return F.coalesce(F.substring(F.sha2(bare, 256), 1, hex_chars), F.lit("UNKNOWN"))


def identity_check(raw: Column) -> Column:
    """64 more bits of the hash behind a pseudonym, to tell apart names that share it; null for none."""
    bare = F.nullif(strip(raw.cast("string")), F.lit(""))
    return F.conv(F.substring(F.sha2(bare, 256), 49, 16), 16, -10).cast("bigint")


def first_present(schema: T.StructType, candidates: Sequence[str]) -> Column:
    """The first candidate column with a usable value, else ``UNKNOWN``.

    A blank but non-empty text counts as a value; ``pseudonym`` later maps it
    to the literal ``UNKNOWN``, while an absent one hashes that word.
    """
    known = {field.name: field.dataType for field in schema.fields}
    present = [truthy(F.col(name), known[name]) for name in candidates if name in known]
    return F.coalesce(*present, F.lit("UNKNOWN"))


def user_key(schema: T.StructType, hex_chars: int = 8) -> Column:
    return pseudonym(first_present(schema, USER_CANDIDATES), hex_chars)


def host_key(schema: T.StructType, hex_chars: int = 8) -> Column:
    return pseudonym(first_present(schema, HOST_CANDIDATES), hex_chars)


def user_check(schema: T.StructType) -> Column:
    return identity_check(first_present(schema, USER_CANDIDATES))


def host_check(schema: T.StructType) -> Column:
    return identity_check(first_present(schema, HOST_CANDIDATES))
