"""Overlapping sliding-window sessions per user, host and day."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf.config import SENSITIVE_FIELDS, SessionConfig
from logsheaf.functions.identity import host_key, user_key
from logsheaf.functions.text import floor_div, to_int, to_text
from logsheaf.operators.parse import day_index
from logsheaf.session import materialize

GROUP = ("day", "user_id", "host_id")
WINDOW = (*GROUP, "start_ts")


def event_time(events: DataFrame) -> Column:
    """The first of ``time`` and ``timestamp`` that holds an integer."""
    known = {field.name: field.dataType for field in events.schema.fields}
    candidates = [to_int(F.col(n), known[n]) for n in ("time", "timestamp") if n in known]
    if not candidates:
        raise ValueError("events need a time or timestamp column")
    return F.coalesce(*candidates)


def filled_event_id(events: DataFrame) -> Column:
    """``event_id``, or the template id as text, or ``UNK``."""
    known = {field.name: field.dataType for field in events.schema.fields}
    fallback = F.lit("UNK")
    if "template_id" in known:
        fallback = F.coalesce(F.col("template_id").cast("string"), F.lit("UNK"))
    if "event_id" not in known:
        return fallback
    event_id = to_text(F.col("event_id"), known["event_id"])
    return F.when(event_id.isNull() | (event_id == ""), fallback).otherwise(event_id)


def prepare_events(
    events: DataFrame,
    config: SessionConfig = SessionConfig(),
    tie_break: Sequence[str] = (),
    keyed: bool = False,
) -> DataFrame:
    """Timed, pseudonymous events: day, user_id, host_id, time, order, event.

    Rows without a usable time are dropped. ``event`` holds the remaining
    columns without any sensitive name; the ``tie_break`` columns order equal
    times and are not stored. The day comes from ``day`` if present. ``keyed``
    says that ``user_id`` and ``host_id`` already hold the pseudonyms.
    """
    own = {*SENSITIVE_FIELDS, *tie_break, *GROUP, "timestamp" if "time" in events.columns else ""}
    added = {"_time": event_time(events), "_event_id": filled_event_id(events)}
    if not keyed:
        added["user_id"] = user_key(events.schema, config.id_hex_chars)
        added["host_id"] = host_key(events.schema, config.id_hex_chars)
    timed = events.withColumns(added).where(F.col("_time").isNotNull())
    if "day" not in events.columns:
        timed = timed.withColumn("day", day_index(F.col("_time"), config.units_per_second))
    payload = [F.col("_time").alias("time")]
    payload += [F.col(n) for n in events.columns if n not in own | {"time", "event_id"}]
    payload.append(F.col("_event_id").alias("event_id"))
    return timed.select(
        *GROUP,
        F.col("_time").alias("time"),
        F.struct(*[F.col(n) for n in tie_break] or [F.lit(0).alias("none")]).alias("order"),
        F.struct(*payload).alias("event"),
    )


def hot_groups(keys: DataFrame, config: SessionConfig) -> DataFrame | None:
    """The largest groups with their first time, at most ``max_hot_groups``.

    ``keys`` holds the group columns and ``time``. Counting combines on the map
    side, so only one narrow row per group and task is shuffled. Every group
    left out holds fewer than ``hot_group_rows`` rows, or no more than
    total/``max_hot_groups`` of them. None when there is no such group.
    """
    if config.hot_group_rows is None or keys.count() < config.hot_group_rows:
        return None
    hot = materialize(
        keys.groupBy(*GROUP)
        .agg(F.min("time").alias("anchor"), F.count("*").alias("_rows"))
        .where(F.col("_rows") >= config.hot_group_rows)
        .orderBy(F.desc("_rows"), *GROUP)
        .limit(config.max_hot_groups)
        .drop("_rows")
    )
    return None if hot.isEmpty() else hot


def _windows_of(anchored: DataFrame, config: SessionConfig) -> DataFrame:
    """One row per event and window that holds it.

    Windows start at the group's first event and advance by the stride; the
    window numbers of an event follow from its distance to that anchor.
    """
    distance = F.col("time") - F.col("anchor")
    size, stride = config.window_units, config.stride_units
    return (
        anchored.withColumn(
            "_first", F.greatest(F.lit(0), floor_div(distance - size, stride) + 1)
        )
        .withColumn("_last", floor_div(distance, stride))
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("_k", F.explode(F.sequence("_first", "_last")))
        .withColumn("start_ts", F.col("anchor") + F.col("_k") * F.lit(stride))
        .drop("_first", "_last", "_k", "anchor")
    )


def _anchor_in_place(prepared: DataFrame) -> DataFrame:
    return prepared.withColumn("anchor", F.min("time").over(W.partitionBy(*GROUP)))


def _per_window(
    prepared: DataFrame, keys: DataFrame, config: SessionConfig, finish: Callable
) -> DataFrame:
    """Applies ``finish``, a grouping per window, to all windows.

    Ordinary groups shuffle once on the group key: anchoring, windowing and
    the grouping per window share that partitioning. Hot groups take their
    anchors from a bounded broadcast instead, so that their rows spread over
    the windows and are never gathered as one group. Each side is finished
    before the union, which would hide its partitioning.
    """
    hot = hot_groups(keys, config)
    if hot is None:
        return finish(_windows_of(_anchor_in_place(prepared), config))
    hot = F.broadcast(hot)
    ordinary = prepared.join(hot, list(GROUP), "left_anti")
    heavy = prepared.join(hot, list(GROUP))
    return finish(_windows_of(_anchor_in_place(ordinary), config)).unionByName(
        finish(_windows_of(heavy, config))
    )


def session_windows(prepared: DataFrame, config: SessionConfig = SessionConfig()) -> DataFrame:
    """Window bounds and event counts, without the events themselves."""

    def count(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*WINDOW).agg(F.count("*").alias("n_events"))

    narrow = prepared.select(*GROUP, "time")
    return (
        _per_window(narrow, narrow, config, count)
        .where(F.col("n_events") >= config.min_events)
        .withColumn("end_ts", F.col("start_ts") + F.lit(config.window_units))
    )


def session_id() -> Column:
    """A stable id from the session key, equal on every run."""
    return F.sha2(F.concat_ws("|", *[F.col(n).cast("string") for n in WINDOW]), 256)


def build_sessions(
    prepared: DataFrame, config: SessionConfig = SessionConfig(), keys: DataFrame | None = None
) -> DataFrame:
    """SESSION rows: windows of at least ``min_events`` events, time ordered.

    ``keys`` may name a cheaper source of the same groups and times, from
    which large groups are found.

    Each window ranks its events from the newest and keeps only as many as the
    result can need, ``max_tokens`` or ``min_events``, before collecting them.
    Spark applies that limit ahead of the shuffle too, so the largest window
    still sends no more than this number of rows per task.
    """
    keep = max(config.max_tokens, config.min_events)
    newest_first = W.partitionBy(*WINDOW).orderBy(F.desc("time"), F.desc("order"))

    def collect(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_rank", F.row_number().over(newest_first))
            .where(F.col("_rank") <= keep)
            .groupBy(*WINDOW)
            .agg(F.collect_list(F.struct((-F.col("_rank")).alias("pos"), "event")).alias("_rows"))
            .where(F.size("_rows") >= config.min_events)
        )

    ordered = F.array_sort("_rows")
    if config.min_events > config.max_tokens:
        ordered = F.filter(ordered, lambda row: row["pos"] >= -config.max_tokens)
    return _per_window(prepared, prepared if keys is None else keys, config, collect).select(
        session_id().alias("session_id"),
        "user_id",
        "host_id",
        "start_ts",
        (F.col("start_ts") + F.lit(config.window_units)).alias("end_ts"),
        F.transform(ordered, lambda row: row["event"]).alias("events"),
        F.lit(None).cast("int").alias("label"),
        "day",
    )
