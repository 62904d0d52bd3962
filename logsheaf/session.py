"""Spark session defaults, and written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Session windows keep at most max_tokens rows each; a threshold above
    # that lets Spark apply the limit on the map side of the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # The JVM does not compile methods beyond this size; Spark then splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Groups that collect_list holds in memory before it sorts instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    # collect_list over rows already sorted by its key needs no second sort.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


# Removes an execution's shuffle files when it ends; they serve no later one.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions that keep each near 128 MiB; adaptive execution merges small ones.

    Events shuffle in about the size of their text, and 200 is Spark's own
    default for small inputs.
    """
    return max(200, -(-input_bytes // SHUFFLE_PARTITION_BYTES))


def planned_bytes(df: DataFrame) -> int:
    """What Spark's plan statistics give as the size of ``df``; for scans, that of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """Has shuffles start with enough partitions for the input, then restores the setting.

    A larger setting of the user stays. Adaptive execution merges small
    partitions but cannot go beyond the number it starts with.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if -(-input_bytes // SHUFFLE_PARTITION_BYTES) > int(before):
        spark.conf.set(key, str(shuffle_partitions(input_bytes)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def build_session(
    app_name: str = "logsheaf",
    master: str | None = None,
    input_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them.

    ``input_bytes``, the size of the logs to process, sets the number of
    shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    sized = {}
    if input_bytes is not None:
        sized["spark.sql.shuffle.partitions"] = str(shuffle_partitions(input_bytes))
    for key, value in {**DEFAULTS, **sized, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``. A temporary folder stands in
    only in local mode, where the one machine is the whole cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="logsheaf-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/logsheaf/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new place for one of this application's intermediate tables."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Later readers start from files, so a lost executor never triggers the work
    above again, and Spark knows the true size when it chooses a join. The
    shuffle files behind the table are removed once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        if partition_by:
            df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it takes it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at ``path``."""
    files, target = file_system(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Removes what is stored at ``path``, if anything."""
    files, target = file_system(spark, path)
    files.delete(target, True)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote."""
    spark = table.sparkSession
    marker = "/logsheaf/" + spark.sparkContext.applicationId + "/"
    for file in table.inputFiles()[:1]:
        if marker in file:
            root, inner = file.split(marker, 1)
            files, target = file_system(spark, root + marker + inner.split("/", 1)[0])
            files.delete(target, True)
