"""Scores, severity, user risk and alert levels from declared settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf import config as C
from logsheaf.operators.joins import lookup_join
from logsheaf.operators.ranking import with_position


def anomaly_score(
    reconstruction: Column,
    embedding: Column,
    weights: tuple[float, float] = (C.RECONSTRUCTION_WEIGHT, C.EMBEDDING_WEIGHT),
) -> Column:
    return reconstruction * weights[0] + embedding * weights[1]


def is_anomaly(score: Column, threshold: float = C.ANOMALY_THRESHOLD) -> Column:
    return score >= threshold


def severity(score: Column, bands: Sequence[tuple[str, float]] = C.SEVERITY_BANDS) -> Column:
    """The name of the first band whose lower bound the score reaches."""
    ordered = sorted(bands, key=lambda band: -band[1])
    (name, bound), *others = ordered[:-1]
    result = F.when(score >= bound, name)
    for name, bound in others:
        result = result.when(score >= bound, name)
    return result.otherwise(ordered[-1][0])


def risk_states(
    scores: DataFrame,
    entity: str,
    time: str,
    score: str,
    order: Sequence[str] = (),
    bucket_seconds: int = 60,
    decay: float = C.RISK_DECAY,
    weight: float = C.RISK_ANOMALY_WEIGHT,
    threshold: float = C.ANOMALY_THRESHOLD,
) -> DataFrame:
    """Per entity what its risk needs of these scores: their number and decayed sum.

    The risk is ``r = decay * r + weight * score`` in time order. A score that
    ``j`` later scores follow contributes ``weight * score * decay^j``. Each entity
    and time bucket is summed by itself first; then the short list of bucket
    sums decays by the number of later scores. An entity with very many
    scores so spreads over its buckets. ``time`` holds epoch seconds; ``order``
    breaks ties.
    """
    keyed = scores.withColumn("_bucket", F.floor(F.col(time) / bucket_seconds))
    later = W.partitionBy(entity, "_bucket").orderBy(F.desc(time), *[F.desc(c) for c in order])
    buckets = (
        keyed.withColumn("_later", F.row_number().over(later) - 1)
        .groupBy(entity, "_bucket")
        .agg(
            F.sum(F.lit(weight) * F.col(score) * F.pow(F.lit(decay), F.col("_later"))).alias("_sum"),
            F.count("*").alias("_n"),
            F.count_if(F.col(score) >= threshold).alias("_anomalies"),
            F.max(time).alias("_last"),
        )
    )
    after = (
        W.partitionBy(entity).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        buckets.withColumn("_after", F.coalesce(F.sum("_n").over(after), F.lit(0)))
        .groupBy(F.col(entity).cast("string").alias("entity_id"))
        .agg(
            F.sum("_n").alias("n_scores"),
            F.sum(F.col("_sum") * F.pow(F.lit(decay), F.col("_after"))).alias("decayed"),
            F.sum("_anomalies").alias("n_anomalies"),
            F.max("_last").cast("bigint").alias("last_time"),
        )
    )


def folded_states(earlier: DataFrame, later: DataFrame, decay: float = C.RISK_DECAY) -> DataFrame:
    """The states of both sets of scores, of which those of ``later`` came after the others.

    Folding is associative, so runs may be folded in any grouping.
    """
    new = later.select("entity_id", *(F.col(c).alias(f"_{c}") for c in later.columns if c != "entity_id"))
    count = F.coalesce("_n_scores", F.lit(0))
    return earlier.join(new, "entity_id", "full").select(
        "entity_id",
        (F.coalesce("n_scores", F.lit(0)) + count).alias("n_scores"),
        (
            F.coalesce("decayed", F.lit(0.0)) * F.pow(F.lit(decay), count) + F.coalesce("_decayed", F.lit(0.0))
        ).alias("decayed"),
        (F.coalesce("n_anomalies", F.lit(0)) + F.coalesce("_n_anomalies", F.lit(0))).alias("n_anomalies"),
        F.greatest("last_time", "_last_time").alias("last_time"),
    )


def profiles_of(states: DataFrame, entity_type: str) -> DataFrame:
    """RISK_PROFILES rows of risk states."""
    return states.select(
        "entity_id",
        F.lit(entity_type).alias("entity_type"),
        F.col("decayed").alias("risk_score"),
        F.col("n_anomalies").cast("int").alias("anomaly_count"),
        F.timestamp_seconds("last_time").alias("last_seen"),
        F.current_timestamp().alias("updated_at"),
    )


def risk_profiles(
    scores: DataFrame,
    entity: str,
    entity_type: str,
    time: str,
    score: str,
    order: Sequence[str] = (),
    bucket_seconds: int = 60,
    decay: float = C.RISK_DECAY,
    weight: float = C.RISK_ANOMALY_WEIGHT,
    threshold: float = C.ANOMALY_THRESHOLD,
) -> DataFrame:
    """Per entity its risk, anomalies and last time, from all scores at once (see ``risk_states``)."""
    states = risk_states(scores, entity, time, score, order, bucket_seconds, decay, weight, threshold)
    return profiles_of(states, entity_type)


def technique_bonus(technique_id: Column, bonus: Mapping[str, float] = C.TECHNIQUE_BONUS) -> Column:
    """The declared bonus of a technique, 0 for any other."""
    result = F.lit(None).cast("double")
    for name, value in bonus.items():
        result = F.when(technique_id == name, value).otherwise(result)
    return F.coalesce(result, F.lit(0.0))


def alert_severity(
    anomaly: Column,
    user_risk: Column,
    technique: Column,
    weights: tuple[float, float, float] = (
        C.ALERT_ANOMALY_WEIGHT,
        C.ALERT_USER_RISK_WEIGHT,
        C.ALERT_TECHNIQUE_WEIGHT,
    ),
) -> Column:
    """Weighted sum; an entity without a risk profile counts as 0."""
    return (
        anomaly * weights[0]
        + F.coalesce(user_risk, F.lit(0.0)) * weights[1]
        + technique * weights[2]
    )


def with_alert_severity(
    scored: DataFrame, profiles: DataFrame, entity: str, score: str, technique_id: str
) -> DataFrame:
    """Adds ``alert_severity`` from a score, the entity's risk and a technique.

    ``profiles`` is a written RISK_PROFILES table, joined by its checked size:
    one entity may own a large part of all scores.
    """
    risk = profiles.select(F.col("entity_id").alias(entity), F.col("risk_score").alias("_risk"))
    return (
        lookup_join(scored, risk, entity)
        .withColumn(
            "alert_severity",
            alert_severity(F.col(score), F.col("_risk"), technique_bonus(F.col(technique_id))),
        )
        .drop("_risk")
    )


def score_percentiles(
    scores: DataFrame, score: str, percentiles: Mapping[str, float] = C.ALERT_PERCENTILES
) -> dict[str, float]:
    """Exact interpolated percentiles of a score, by name.

    A percentile sketch gives a lower bound, in one pass that combines on the
    map side. Only the distinct scores at or above it, with their counts, are
    sorted, over all tasks. Should the bound lie too high, as it can for a
    handful of scores, all distinct scores are sorted.
    """
    accuracy = 10_000
    values = scores.select(F.col(score).alias("v")).where(F.col("v").isNotNull())
    floor = max(0.0, min(percentiles.values()) / 100 - 5 / accuracy)
    total, bound = values.agg(F.count("*"), F.percentile_approx("v", floor, accuracy)).first()
    if not total:
        raise ValueError("no scores to rank")
    return _percentiles(values, total, values.where(F.col("v") >= bound), percentiles)


def score_sketches(scores: DataFrame, score: str, day: str = "day") -> DataFrame:
    """One row per day, to be stored beside it: (day, n, highest, sketch), a KLL sketch of its scores.

    Days may be joined by any later run; null scores do not count.
    """
    value = F.col(score).cast("double")
    return (
        scores.where(value.isNotNull())
        .groupBy(F.col(day).alias("day"))
        .agg(F.count("*").alias("n"), F.max(value).alias("highest"), F.kll_sketch_agg_double(value).alias("sketch"))
    )


# A KLL sketch of the default size errs in rank by less than this share.
SKETCH_ERROR = 0.02


def percentiles_of_days(
    scores: DataFrame,
    sketches: DataFrame,
    score: str,
    percentiles: Mapping[str, float] = C.ALERT_PERCENTILES,
    day: str = "day",
) -> dict[str, float]:
    """The same percentiles from stored sketches, reading only days that reach the tail.

    The joined sketch bounds the tail from below; of the scores, partitioned
    by day, only the days whose highest score reaches the bound are read.
    """
    floor = max(0.0, min(percentiles.values()) / 100 - SKETCH_ERROR)
    merged = F.kll_merge_agg_double("sketch")
    total, bound = sketches.agg(
        F.sum("n"), F.kll_sketch_get_quantile_double(merged, F.lit(floor))
    ).first()
    if not total:
        raise ValueError("no scores to rank")
    days = [row["day"] for row in sketches.where(F.col("highest") >= bound).select("day").collect()]
    values = scores.select(day, F.col(score).alias("v")).where(F.col("v").isNotNull())
    tail = values.where(F.col(day).isin(days) & (F.col("v") >= bound)).select("v")
    return _percentiles(values.select("v"), total, tail, percentiles)


def _percentiles(
    values: DataFrame, total: int, tail: DataFrame, percentiles: Mapping[str, float]
) -> dict[str, float]:
    """Percentiles of ``total`` values from the highest of them; from all, should those be too few."""
    targets = {name: p / 100 * (total - 1) for name, p in percentiles.items()}
    ranks = {min(int(t) + step, total - 1) for t in targets.values() for step in (0, 1)}
    # Positions count from the top, so nothing below the bound is needed.
    from_top = [total - 1 - rank for rank in sorted(ranks)]

    def scores_at_ranks(candidates: DataFrame) -> dict[int, float]:
        counted = candidates.groupBy("v").agg(F.count("*").alias("n"))
        first, end = F.col("position"), F.col("position") + F.col("n")
        holds = [(first <= rank) & (end > rank) for rank in from_top]
        rows = (
            with_position(counted, F.desc("v"), weight="n")
            .where(reduce(or_, holds))
            .select("v", first, end.alias("end"))
            .collect()
        )
        return {
            total - 1 - rank: row["v"]
            for row in rows
            for rank in from_top
            if row["position"] <= rank < row["end"]
        }

    found = scores_at_ranks(tail)
    if len(found) < len(ranks):
        found = scores_at_ranks(values)

    def between(target: float) -> float:
        low, high = found[int(target)], found[min(int(target) + 1, total - 1)]
        return low + (high - low) * (target - int(target))

    return {name: between(target) for name, target in targets.items()}


def alert_levels(
    scores: DataFrame, score: str, percentiles: Mapping[str, float] = C.ALERT_PERCENTILES
) -> DataFrame:
    """Adds ``level``: the highest percentile level a score reaches, or none."""
    limits = score_percentiles(scores, score, percentiles)
    level = F.lit("none")
    for name in sorted(percentiles, key=percentiles.get):
        level = F.when(F.col(score) >= limits[name], name).otherwise(level)
    return scores.withColumn("level", level)


def masked_examples(
    sequences: DataFrame,
    specials: Mapping[str, int],
    vocabulary_size: int,
    seed: int = 0,
    probability: float = C.MASK_PROBABILITY,
    mask_share: float = C.MASK_TOKEN_SHARE,
    random_share: float = C.MASK_RANDOM_SHARE,
) -> DataFrame:
    """Adds ``masked_ids`` and ``labels`` (-100 where nothing is predicted).

    Choices follow from an MD5 of the session id, the position and the seed, so
    that they are the same on every run and engine. Special tokens are never
    chosen.
    """
    first_learned = max(specials.values()) + 1
    choices = max(vocabulary_size - first_learned, 1)

    def drawn(position: Column, salt: int) -> Column:
        name = F.concat_ws("|", "session_id", position.cast("string"), F.lit(f"{seed}|{salt}"))
        return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint")

    def draw(position: Column, salt: int) -> Column:
        return drawn(position, salt) % 1_000_000 / 1_000_000

    def chosen(token: Column, position: Column) -> Column:
        return ~token.isin(*specials.values()) & (draw(position, 0) < probability)

    def replacement(token: Column, position: Column) -> Column:
        kind = draw(position, 1)
        other = drawn(position, 2) % choices
        return (
            F.when(kind < mask_share, F.lit(specials["[MASK]"]))
            .when(kind < mask_share + random_share, (other + first_learned).cast("int"))
            .otherwise(token.cast("int"))
        )

    return sequences.withColumns(
        {
            "masked_ids": F.transform(
                "input_ids",
                lambda t, i: F.when(chosen(t, i), replacement(t, i)).otherwise(t.cast("int")),
            ),
            "labels": F.transform(
                "input_ids", lambda t, i: F.when(chosen(t, i), t.cast("int")).otherwise(-100)
            ),
        }
    )
