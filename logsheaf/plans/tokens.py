"""The tokens job: stored sessions in, vocabulary and sequences out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsheaf.config import SPLIT_DAYS, TokenConfig
from logsheaf.functions.tokens import token_schema
from logsheaf.operators.chunks import (
    chunk_report,
    chunks_per_file,
    is_complete,
    manifest,
    numbered_chunks,
    sound_chunks,
)
from logsheaf.operators.encoding import padded
from logsheaf.operators.quality import quality_of_days, require_events, token_sketches, token_warnings
from logsheaf.operators.splits import Ranges, in_split, missing_days
from logsheaf.operators.vocabulary import check_vocabulary, rank_tokens, token_counts
from logsheaf.schemas import SESSION
from logsheaf.session import materialize, planned_bytes, sized_shuffles, table_exists
from logsheaf.sources.metrics import write_chunk_metrics, write_metrics
from logsheaf.sources.sequences import (
    in_whole_files,
    read_sequences,
    stored_chunks,
    write_chunks,
    write_table,
)
from logsheaf.sources.sessions import read_session_shards, read_sessions
from logsheaf.sources.vocabulary import read_vocabulary, write_vocabulary


@dataclass(frozen=True)
class TokensResult:
    """What a run wrote, and whether there was anything left to do."""

    vocabulary: DataFrame
    sequences: DataFrame
    manifest: DataFrame
    skipped: bool
    warnings: list[str] = field(default_factory=list)


def learn_vocabulary(
    sessions: DataFrame, path: str, config: TokenConfig = TokenConfig(), reuse: bool = False
) -> DataFrame:
    """Builds and stores the vocabulary of ``sessions``, or reuses a stored one."""
    spark = sessions.sparkSession
    if not (reuse and table_exists(spark, path)):
        write_vocabulary(rank_tokens(token_counts(sessions), config), path)
    return read_vocabulary(spark, path)


def session_checks(sessions: DataFrame) -> dict[str, int]:
    """Counts of sessions and of what the job passes over; wrong keys are an error."""
    events = F.col("events")
    row = sessions.agg(
        F.count("*").alias("session_count"),
        F.count_distinct("day", "session_id").alias("keys"),
        F.count_if(events.isNull()).alias("invalid_event_containers"),
        F.coalesce(F.sum(F.size(F.filter(events, lambda e: e.isNull()))), F.lit(0)).alias("dropped_events"),
    ).first()
    if row["keys"] != row["session_count"]:
        raise ValueError(
            f"{row['session_count'] - row['keys']} sessions have no id or that of another session"
        )
    return {k: v for k, v in row.asDict().items() if k != "keys"}


def run_tokens(
    spark: SparkSession,
    sessions_path: str | list[str],
    vocabulary_path: str,
    sequences_path: str,
    split: str = "train",
    config: TokenConfig = TokenConfig(),
    vocabulary_in: str | None = None,
    reuse_vocabulary: bool = False,
    resume: bool = False,
    ranges: Ranges = SPLIT_DAYS,
    metrics_path: str | None = None,
) -> TokensResult:
    """Encodes one split, with a new vocabulary or that of another split.

    ``sessions_path`` is a folder of stored sessions, or a list of single
    files named ``day_NN.parquet``, whose sessions may lack ids. Null events
    are passed over and counted.

    The output of a split is numbered chunks of ``chunk_size`` sessions, in the
    order of days and session ids, one file each; of more than 1,000 chunks, small
    neighbours share a file (see ``chunks_per_file``). It is replaced in one step
    when all is written: days that have no session any more go with it, and a
    run that stops early leaves the old output as it was.

    A resumed run keeps the vocabulary and the chunks that hold exactly their
    sessions and can be read, and writes every other chunk anew, also one whose
    file is damaged or lost, with those that share its file. All counts are over the whole output of the split;
    they and the list of chunks are stored at ``<sequences_path>_manifest`` and
    ``<sequences_path>_chunks``, and the token quality of each day at
    ``<sequences_path>_days``, whose sketches join for any range of days. Start,
    skip, resume, token quality, each written chunk and completion append their
    counters to the table at ``metrics_path``.
    """
    schema = token_schema(SESSION)
    if isinstance(sessions_path, str):
        stored_sessions = read_sessions(spark, sessions_path, schema)
    else:
        stored_sessions = read_session_shards(spark, *sessions_path, schema=schema)
    sessions = in_split(stored_sessions, split, ranges)
    with sized_shuffles(spark, planned_bytes(sessions)):
        return _run(
            sessions, vocabulary_path, sequences_path, split, config, vocabulary_in,
            reuse_vocabulary, resume, ranges, metrics_path,
        )


def _run(
    sessions: DataFrame,
    vocabulary_path: str,
    sequences_path: str,
    split: str,
    config: TokenConfig,
    vocabulary_in: str | None,
    reuse_vocabulary: bool,
    resume: bool,
    ranges: Ranges,
    metrics_path: str | None,
) -> TokensResult:
    spark = sessions.sparkSession

    def record(event: str, values: dict[str, int]) -> None:
        write_metrics(spark, metrics_path, f"tokens {split}", event, values)

    checks = session_checks(sessions)
    total = checks["session_count"]
    if not total:
        raise RuntimeError(f"no sessions in split {split}")
    require_events(sessions)
    absent = missing_days(sessions, split, ranges).count()
    record("start", {**checks, "missing_days": absent})

    chunks = materialize(numbered_chunks(sessions, config.chunk_size))
    n_chunks = -(-total // config.chunk_size)
    resumed = resume and bool(stored_chunks(spark, sequences_path, split))
    resumed = resumed and table_exists(spark, vocabulary_in or vocabulary_path)
    sound: list[int] = []
    if resumed:
        stored = read_sequences(spark, sequences_path, config.token_id_dtype, split, damaged="skip")
        sound = [row["chunk"] for row in sound_chunks(chunks, stored, config.max_len).collect()]
        whole = len(sound) == n_chunks == len(stored_chunks(spark, sequences_path, split))
        if whole and table_exists(spark, f"{sequences_path}_manifest"):
            record("skip_complete", {"session_count": total})
            stored = read_sequences(spark, sequences_path, config.token_id_dtype, split)
            vocabulary = read_vocabulary(spark, vocabulary_in or vocabulary_path)
            return TokensResult(vocabulary, stored, manifest(stored, config), True)
        sound = in_whole_files(spark, sequences_path, split, sound)
        record("resume", {"session_count": total, "sound_chunks": len(sound)})

    if vocabulary_in:
        vocabulary = read_vocabulary(spark, vocabulary_in)
    else:
        vocabulary = learn_vocabulary(
            sessions, vocabulary_path, config, reuse_vocabulary or resumed
        )
    check_vocabulary(vocabulary, config.token_id_dtype)
    write_table(token_sketches(sessions), f"{sequences_path}_days")
    quality = materialize(quality_of_days(spark.read.parquet(f"{sequences_path}_days")))
    record("token_quality", quality.first().asDict())
    warnings = token_warnings(quality, vocabulary.count())

    todo = chunks
    if sound:
        done = spark.createDataFrame([(chunk,) for chunk in sound], "chunk bigint")
        todo = chunks.join(done, "chunk", "left_anti")
    per_file = chunks_per_file(n_chunks - len(sound), config.chunk_size)
    sequences = padded(sessions, vocabulary, todo, n_chunks - len(sound), config, per_file)
    write_chunks(sequences, sequences_path, config, split, sound, per_file)

    stored = read_sequences(spark, sequences_path, config.token_id_dtype, split)
    write_table(chunk_report(stored, config.max_len), f"{sequences_path}_chunks")
    write_table(manifest(stored, config), f"{sequences_path}_manifest")
    if metrics_path:
        write_chunk_metrics(spark, metrics_path, f"tokens {split}", f"{sequences_path}_chunks", sound)
    report = spark.read.parquet(f"{sequences_path}_manifest")
    if not is_complete(report, total):
        raise RuntimeError(f"the sequences of split {split} do not cover its {total} sessions")
    record("complete", report.first().asDict())
    return TokensResult(vocabulary, stored, report, False, warnings)
