"""Stored sessions, one partition per day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.operators.sessions import session_id
from logsheaf.operators.splits import day_from_path
from logsheaf.schemas import SESSION
from logsheaf.sources import versions


def _stored_days(spark: SparkSession, path: str) -> dict[str, str]:
    """Version by day, also of a folder that was written without versions."""
    stored = versions.parts(spark, path)
    if stored is None:
        names = (name for name in versions.listed(spark, path) if name.startswith("day="))
        stored = dict.fromkeys(names, versions.UNVERSIONED)
    return stored


def write_sessions(sessions: DataFrame, path: str, days: Iterable[int] = ()) -> None:
    """Replaces the days that occur in ``sessions``, and empties others of ``days``; the rest stays.

    Readers see either all of that or nothing (see ``versions``). The rebalance
    hint gathers each day into files of the advisory partition size and splits
    a day that is much larger, so that the number of files follows the data
    and not tasks times days.
    """
    spark, version, written = sessions.sparkSession, versions.new_version(), Observation()
    stored = _stored_days(spark, path)
    (
        sessions.hint("rebalance", "day")
        .observe(written, F.collect_set("day").alias("days"))
        .write.option("compression", "snappy")
        .partitionBy("day")
        .parquet(versions.folder(path, version))
    )
    present = {f"day={day}" for day in written.get["days"]}
    touched = present | {f"day={day}" for day in days}
    kept = {day: of for day, of in stored.items() if day not in touched}
    versions.commit(spark, path, kept | dict.fromkeys(present, version))


def read_sessions(spark: SparkSession, path: str, schema: T.StructType = SESSION) -> DataFrame:
    """Sessions under ``path``; a damaged file is an error."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "false")
    stored = versions.parts(spark, path)
    if stored is None:
        return reader.parquet(path)
    reader = reader.option("basePath", path)
    found = None
    # Days written without versions lie at another depth than the others.
    for old in (False, True):
        days = [
            f"{versions.folder(path, of)}/{day}"
            for day, of in sorted(stored.items())
            if (of == versions.UNVERSIONED) == old
        ]
        if days:
            rows = reader.parquet(*days).select(*schema.names)
            found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found


def read_session_shards(spark: SparkSession, *paths: str, schema: T.StructType = SESSION) -> DataFrame:
    """Sessions from single files named ``day_NN.parquet``.

    Sessions without an id get the one that follows from their key.
    """
    stored = T.StructType([f for f in schema.fields if f.name != "day"])
    shards = spark.read.schema(stored).option("ignoreCorruptFiles", "false").parquet(*paths)
    dated = shards.withColumn("day", day_from_path(F.col("_metadata.file_path")))
    return dated.withColumn("session_id", F.coalesce("session_id", session_id())).select(*schema.names)


def shard_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per day; the scan reads no session column."""
    return sessions.groupBy("day").agg(F.count("*").alias("sessions"))
