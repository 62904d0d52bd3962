"""The sessions job: log lines in, templates and stored sessions out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logsheaf.config import SessionConfig
from logsheaf.functions.identity import host_check, host_key, user_check, user_key
from logsheaf.operators.merging import extend_merged, resolved
from logsheaf.operators.parse import in_days, parse_auth_lines
from logsheaf.operators.quality import id_collisions, rows_per_day
from logsheaf.operators.sessions import GROUP, build_sessions, prepare_events
from logsheaf.operators.templates import (
    assign_template_ids,
    enrich,
    mine_signatures,
    recounted,
    with_auth_signature,
)
from logsheaf.schemas import SESSION_EVENT, TEMPLATE, TEMPLATE_ALIAS
from logsheaf.session import discard, materialize, planned_bytes, sized_shuffles, table_exists
from logsheaf.sources.logs import read_log_lines
from logsheaf.sources.metrics import write_metrics
from logsheaf.sources.sessions import read_sessions, write_sessions


CHECKS = {"user_id": "user_check", "host_id": "host_check"}


@dataclass(frozen=True)
class SessionsResult:
    """What a run wrote, its counters, and events and sessions per day."""

    sessions: DataFrame
    templates: DataFrame
    counters: dict[str, int]
    per_day: DataFrame


def stage_events(events: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """Parsed events with signature and pseudonymous ids, written once.

    Mining, hot-group detection and sessions each read only the columns they
    need from there, and no raw identity is kept.
    """
    keyed = events.withColumns(
        {
            "user_id": user_key(events.schema, config.id_hex_chars),
            "host_id": host_key(events.schema, config.id_hex_chars),
            **{name: check(events.schema) for name, check in zip(CHECKS.values(), (user_check, host_check))},
        }
    )
    return materialize(
        with_auth_signature(keyed).select(
            *GROUP,
            *CHECKS.values(),
            "time",
            "auth_type",
            "logon_type",
            "auth_orientation",
            "success",
            "is_success",
            "signature",
            "line_ord",
        )
    )


def sessions_of(
    staged: DataFrame, templates: DataFrame, config: SessionConfig = SessionConfig()
) -> DataFrame:
    """Sessions of staged events, with the ids of ``templates``."""
    events = enrich(staged, templates).select(
        *GROUP, *SESSION_EVENT.fieldNames(), "line_ord"
    )
    return build_sessions(
        prepare_events(events, config, ["line_ord"], keyed=True), config, keys=staged
    )


def read_aliases(spark: SparkSession, templates_path: str) -> DataFrame:
    """Template ids that met an older one, in all runs so far."""
    path = f"{templates_path}_aliases"
    if table_exists(spark, path):
        return spark.read.schema(TEMPLATE_ALIAS).parquet(path)
    return spark.createDataFrame([], TEMPLATE_ALIAS)


def extend_templates(mined: DataFrame, path: str, config: SessionConfig = SessionConfig()) -> DataFrame:
    """Adds the new signatures of ``mined`` to the stored templates; all of them.

    Ids only grow. With ``merge_similar`` the ids that met are stored first, at
    ``<path>_aliases``: a run that stops in between finds the same again.
    """
    spark = mined.sparkSession
    known = spark.read.schema(TEMPLATE).parquet(path) if table_exists(spark, path) else None
    if config.merge_similar:
        fresh, met = extend_merged(
            mined, known, read_aliases(spark, path),
            config.similarity, config.prefix_tokens, config.max_children,
        )
        met.write.mode("append").parquet(f"{path}_aliases")
    else:
        fresh = assign_template_ids(mined, known)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(TEMPLATE).parquet(path)


def write_template_counts(staged: DataFrame, path: str) -> DataFrame:
    """Replaces the days of ``staged`` in the counts (day, signature, n_events); all days' sums."""
    spark = staged.sparkSession
    (
        staged.groupBy("day", "signature")
        .agg(F.count("*").alias("n_events"))
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
    stored = spark.read.schema("signature string, n_events bigint, day int").parquet(path)
    return stored.groupBy("signature").agg(F.sum("n_events").alias("n_events"))


def run_sessions(
    spark: SparkSession,
    inputs: list[str],
    sessions_path: str,
    templates_path: str,
    start_day: int = 1,
    end_day: int = 58,
    config: SessionConfig = SessionConfig(),
    metrics_path: str | None = None,
) -> SessionsResult:
    """Builds the sessions of a day range and extends the stored templates.

    Every processed day is replaced, also by nothing where it has no session
    any more. Template ids only grow; their events are counted per day in a
    table beside, whose processed days are replaced too. The counters of
    the run are also appended to the table at ``metrics_path``.
    """
    lines = read_log_lines(spark, *inputs)
    with sized_shuffles(spark, planned_bytes(lines)):
        return _run(
            spark, lines, sessions_path, templates_path, start_day, end_day, config, metrics_path
        )


def _run(
    spark: SparkSession,
    lines: DataFrame,
    sessions_path: str,
    templates_path: str,
    start_day: int,
    end_day: int,
    config: SessionConfig,
    metrics_path: str | None,
) -> SessionsResult:
    counts = Observation()
    events = parse_auth_lines(lines, observation=counts)
    staged = stage_events(in_days(events, start_day, end_day), config)

    ids = extend_templates(mine_signatures(staged), templates_path, config)
    named = resolved(ids, read_aliases(spark, templates_path)) if config.merge_similar else ids
    templates = recounted(named, write_template_counts(staged, f"{templates_path}_counts"))

    days = [row["day"] for row in staged.select("day").distinct().collect()]
    write_sessions(sessions_of(staged, ids, config), sessions_path, days)

    stored = in_days(read_sessions(spark, sessions_path), start_day, end_day)
    per_day = materialize(
        rows_per_day(staged, "events")
        .join(rows_per_day(stored, "sessions"), "day", "left")
        .fillna(0, ["sessions"])
    )
    totals = per_day.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("bucketed_events"),
        F.count("*").alias("processed_days"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("written_sessions"),
    ).first()
    id_collisions(staged, CHECKS).write.mode("overwrite").parquet(f"{templates_path}_collisions")
    colliding = spark.read.parquet(f"{templates_path}_collisions").count()
    discard(staged)
    counters = {**counts.get, **totals.asDict(), "colliding_ids": colliding}
    write_metrics(spark, metrics_path, "sessions", "complete", counters)
    return SessionsResult(stored, templates, counters, per_day)
