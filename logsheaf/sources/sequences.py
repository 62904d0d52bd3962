"""Stored token sequences, in numbered chunks of fixed size."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.config import TOKEN_ID_SPARK_TYPES, TokenConfig
from logsheaf.sources import versions


def sequence_schema(token_id_dtype: str = "int32") -> T.StructType:
    return T.StructType.fromDDL(
        "session_id string, n_events bigint, n_unknown bigint, "
        f"input_ids array<{TOKEN_ID_SPARK_TYPES[token_id_dtype]}>, "
        "attention_mask array<tinyint>, day int"
    )


# The chunk of a row, in files that hold several chunks and bear the first one's number.
NUMBER = "chunk_number"


def _part(split: str, chunk: int) -> str:
    return f"split={split}/chunk={chunk:06}"


def _per_file(version: str) -> int:
    """How many neighbouring chunks share a file of this version."""
    return int(version.partition("-")[2] or 1)


def _first(chunk: int, version: str) -> int:
    """The number that the file of ``chunk`` bears."""
    return chunk - chunk % _per_file(version)


def stored_chunks(spark: SparkSession, path: str, split: str) -> dict[int, str]:
    """Version by number of the chunks of a split."""
    stored, start = versions.parts(spark, path) or {}, f"split={split}/chunk="
    return {int(part[len(start) :]): of for part, of in stored.items() if part.startswith(start)}


def in_whole_files(spark: SparkSession, path: str, split: str, chunks: Collection[int]) -> list[int]:
    """Those of ``chunks`` whose stored file holds no other chunk than these."""
    stored, chosen = stored_chunks(spark, path, split), set(chunks)
    broken = {(of, _first(chunk, of)) for chunk, of in stored.items() if chunk not in chosen}
    return [c for c in chunks if c in stored and (stored[c], _first(c, stored[c])) not in broken]


def write_chunks(
    sequences: DataFrame,
    path: str,
    config: TokenConfig,
    split: str = "all",
    kept: Collection[int] = (),
    per_file: int = 1,
) -> None:
    """Writes sequences, one file per ``chunk``, as the split's output together with the chunks ``kept``.

    ``per_file`` neighbouring chunks share a file; all rows of a file must lie in
    one partition, and ``kept`` must hold all chunks of a file or none. The new chunks replace those
    of their numbers, and all others of the split that are not kept go, in one
    step (see ``versions``). Other splits stay. As nobody reads a version before its
    pointer stands, tasks put their files in place themselves, not the driver.
    """
    spark, version, written = sequences.sparkSession, versions.new_version(), Observation()
    if len(in_whole_files(spark, path, split, kept)) < len(kept):
        raise ValueError("chunks to keep must be stored, and all chunks of their files be kept")
    columns = [F.col(name) for name in sequence_schema(config.token_id_dtype).fieldNames()]
    number = F.col("chunk")
    if per_file > 1:
        version = f"{version}-{per_file}"
        columns.append(number.alias(NUMBER))
        number = number - F.pmod(number, F.lit(per_file))
    (
        sequences.observe(written, F.collect_set("chunk").alias("chunks"))
        .select(*columns, F.format_string("%06d", number).alias("chunk"))
        .write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .partitionBy("chunk")
        .parquet(f"{versions.folder(path, version)}/split={split}")
    )
    before = stored_chunks(spark, path, split)
    others = {
        part: of
        for part, of in (versions.parts(spark, path) or {}).items()
        if not part.startswith(f"split={split}/")
    }
    same = {_part(split, chunk): before[chunk] for chunk in kept}
    new = {_part(split, int(chunk)): version for chunk in written.get["chunks"]}
    versions.commit(spark, path, others | same | new)


def write_single(sequences: DataFrame, path: str, config: TokenConfig) -> None:
    """Writes sequences by day without a limit of rows per file."""
    columns = sequence_schema(config.token_id_dtype).fieldNames()
    sequences.select(*columns).hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    """Replaces a small report beside the sequences."""
    table.write.mode("overwrite").parquet(path)


def read_sequences(
    spark: SparkSession,
    path: str,
    token_id_dtype: str = "int32",
    split: str | None = None,
    damaged: str = "error",
) -> DataFrame:
    """Stored sequences with their ``split`` and ``chunk``, of one split or of all.

    A damaged or lost file is an error, or, with ``damaged="skip"``, counts as one
    without rows. Sequences stored as a single artifact have neither split nor chunk.
    """
    schema = sequence_schema(token_id_dtype)
    skip = str(damaged == "skip").lower()
    reader = spark.read.option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip)
    stored = versions.parts(spark, path)
    if stored is None:
        rows = reader.schema(schema).parquet(path)
        return rows.withColumns({"split": F.lit(None).cast("string"), "chunk": F.lit(None).cast("bigint")})
    chosen = {part: of for part, of in stored.items() if split is None or part.startswith(f"split={split}/")}
    names_of = defaultdict(set)
    for part, of in chosen.items():
        group, name = part.split("/")
        names_of[of, group].add(f"chunk={_first(int(name.partition('=')[2]), of):06}")
    columns = [*schema.fieldNames(), "split", F.coalesce(NUMBER, F.col("chunk").cast("bigint")).alias("chunk")]
    placed = T.StructType(schema.fields).add(NUMBER, "long").add("split", "string").add("chunk", "string")
    files = []
    for (of, group), names in sorted(names_of.items()):
        folder = f"{versions.folder(path, of)}/{group}"
        there = {name for name in versions.listed(spark, folder) if name.startswith("chunk=")}
        if names == there:
            # One path, which Spark lists in parallel, for all files of a version.
            files.append(folder)
        else:
            files += [f"{folder}/{name}" for name in sorted(names & there if damaged == "skip" else names)]
    if not files:
        return spark.createDataFrame([], placed).select(*columns)
    return reader.schema(placed).option("basePath", path).parquet(*files).select(*columns)
