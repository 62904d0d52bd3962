"""Log, alert and risk tables, partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.operators.joins import lookup_join
from logsheaf.operators.scoring import folded_states, is_anomaly, severity
from logsheaf.schemas import ALERTS, LOGS_PARSED, LOGS_RAW, RISK_PROFILES
from logsheaf.sources import versions

TABLES = {
    "logs_raw": (LOGS_RAW, "@timestamp"),
    "logs_parsed": (LOGS_PARSED, "@timestamp"),
    "alerts": (ALERTS, "@timestamp"),
    "risk_profiles": (RISK_PROFILES, "updated_at"),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns; absent ones become null."""
    schema, _ = TABLES[table]
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def write_records(df: DataFrame, table: str, path: str, mode: str = "append") -> None:
    _, timestamp = TABLES[table]
    (
        conform(df, table)
        .withColumn("date", F.to_date(F.col(f"`{timestamp}`")))
        .hint("rebalance", "date")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_records(spark: SparkSession, table: str, path: str) -> DataFrame:
    schema, _ = TABLES[table]
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.DateType())])).parquet(
        path
    )


def parsed_log_records(events: DataFrame, templates: DataFrame, message: str, timestamp: str) -> DataFrame:
    """LOGS_PARSED rows of enriched events joined to their templates.

    Sensitive fields are not copied into ``parsed_fields``.
    """

    texts = templates.select("signature", "template")
    fields = ("auth_type", "logon_type", "auth_orientation", "success")
    pairs = [part for name in fields for part in (F.lit(name), F.col(name))]
    return conform(
        lookup_join(events, texts, "signature").select(
            F.col(timestamp).alias("@timestamp"),
            F.col(message).alias("raw_message"),
            F.col("template_id").cast("string").alias("template_id"),
            "template",
            F.create_map(*pairs).alias("parsed_fields"),
        ),
        "logs_parsed",
    )


def alert_records(
    scored: DataFrame,
    timestamp: str,
    score: str,
    technique_id: str,
    message: str | None = None,
    model_version: str | None = None,
) -> DataFrame:
    """ALERTS rows of scored events."""

    none = F.lit(None).cast("string")
    return conform(
        scored.select(
            F.col(timestamp).alias("@timestamp"),
            F.col(score).alias("anomaly_score"),
            severity(F.col(score)).alias("severity"),
            is_anomaly(F.col(score)).alias("is_anomaly"),
            (F.col(message) if message else none).alias("raw_message"),
            (F.col("template_id") if "template_id" in scored.columns else none).alias("template_id"),
            F.struct(
                none.alias("tactic"), none.alias("technique"), F.col(technique_id).alias("technique_id")
            ).alias("mitre"),
            F.lit(model_version).cast("string").alias("model_version"),
        ),
        "alerts",
    )


RISK_STATE = "entity_id string, n_scores bigint, decayed double, n_anomalies bigint, last_time bigint"


def read_risk_states(spark: SparkSession, path: str) -> DataFrame:
    """Risk states of all runs so far; none before the first."""
    stored = (versions.parts(spark, path) or {}).get("states")
    if stored is None:
        return spark.createDataFrame([], RISK_STATE)
    return spark.read.schema(RISK_STATE).parquet(versions.folder(path, stored))


def fold_risk_states(states: DataFrame, path: str, run: str) -> DataFrame:
    """Folds the states of a run's scores into the stored ones, once; the states after it.

    The new table and the note that ``run`` is in it come in one step, so a run
    that is repeated, or stopped before, changes nothing. Scores of a run
    count as later than those of the runs before.
    """
    spark = states.sparkSession
    stored = versions.parts(spark, path) or {}
    if f"run={run}" not in stored:
        version = versions.new_version()
        folded = folded_states(read_risk_states(spark, path), states)
        folded.write.parquet(versions.folder(path, version))
        runs = {part: version for part in stored if part.startswith("run=")}
        versions.commit(spark, path, {**runs, "states": version, f"run={run}": version})
    return read_risk_states(spark, path)
