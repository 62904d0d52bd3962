import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsheaf.operators import scoring
from logsheaf.session import materialize
from logsheaf.sources.records import (
    TABLES,
    alert_records,
    fold_risk_states,
    read_records,
    read_risk_states,
    write_records,
)


def test_severity_and_threshold(spark):
    df = spark.createDataFrame([(x,) for x in (0.95, 0.9, 0.8, 0.75, 0.6, 0.5, 0.1)], "s double").coalesce(1)
    got = [tuple(r) for r in df.select(scoring.severity(F.col("s")), scoring.is_anomaly(F.col("s"))).collect()]
    assert got == [
        ("critical", True), ("critical", True), ("high", True), ("high", True),
        ("medium", False), ("medium", False), ("low", False),
    ]


@pytest.mark.parametrize("bucket", [1, 60, 3600, 10**9])
def test_risk_matches_loop(spark, bucket):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", "c", "c", "c"]), draw.randrange(5000), i, draw.random()) for i in range(800)]
    df = spark.createDataFrame(rows, "e string, t bigint, i int, s double").repartition(6)
    got = scoring.risk_profiles(df, "e", "user", "t", "s", ["i"], bucket_seconds=bucket).collect()
    for row in got:
        risk = 0.0
        mine = sorted((t, i, s) for e, t, i, s in rows if e == row["entity_id"])
        for _, _, score in mine:
            risk = 0.95 * risk + 0.05 * score
        assert row["risk_score"] == pytest.approx(risk, abs=1e-12)
        assert row["anomaly_count"] == sum(s >= 0.75 for _, _, s in mine)


def test_percentiles_match_numpy(spark):
    import numpy as np

    draw = random.Random(8)
    for values in (
        [draw.random() for _ in range(5000)],
        [draw.choice([0.1, 0.5, 0.9]) for _ in range(3000)],
        [1.0],
        [2.0, 1.0],
    ):
        df = spark.createDataFrame([(v,) for v in values], "s double").repartition(5)
        got = scoring.score_percentiles(df, "s")
        for name, percent in (("P1", 99.9), ("P2", 99.0), ("P3", 97.0)):
            assert got[name] == pytest.approx(float(np.percentile(values, percent)), abs=1e-12)
    with pytest.raises(ValueError):
        scoring.score_percentiles(df.where("s < 0"), "s")


def test_alert_severity(spark):
    df = spark.createDataFrame([(0.8, 0.5, "T1003"), (0.8, None, "T0")], "a double, r double, t string").coalesce(1)
    value = scoring.alert_severity(F.col("a"), F.col("r"), scoring.technique_bonus(F.col("t")))
    assert [r[0] for r in df.select(value).collect()] == [pytest.approx(0.61), pytest.approx(0.4)]


def test_masked_examples(spark):
    special = {"[CLS]": 0, "[SEP]": 1, "[MASK]": 2, "[PAD]": 3, "[UNK]": 4}
    rows = [(f"s{i}", [0] + [5 + (i + j) % 50 for j in range(60)] + [1, 3, 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id string, input_ids array<int>")
    got = scoring.masked_examples(df, special, 55).collect()
    again = scoring.masked_examples(df.repartition(7), special, 55).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    chosen = masked = same = 0
    for row in got:
        for old, new, label in zip(row["input_ids"], row["masked_ids"], row["labels"]):
            if label == -100:
                assert new == old
                continue
            assert label == old and old > 4
            chosen, masked, same = chosen + 1, masked + (new == 2), same + (new == old)
            assert new == 2 or 5 <= new < 55
    assert 0.13 < chosen / (300 * 60) < 0.17
    assert 0.75 < masked / chosen < 0.85 and 0.07 < same / chosen < 0.15


def test_record_tables(spark, tmp_path):
    df = spark.createDataFrame([(0.8, "T1003", "m")], "score double, technique string, text string")
    alerts = alert_records(df.withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp")), "ts", "score", "technique", "text")
    write_records(alerts, "alerts", str(tmp_path / "alerts"))
    back = read_records(spark, "alerts", str(tmp_path / "alerts"))
    row = back.first()
    assert (row["severity"], row["is_anomaly"], row["mitre"]["technique_id"], str(row["date"])) == (
        "high", True, "T1003", "2024-01-02",
    )
    risk = scoring.risk_profiles(
        spark.createDataFrame([("u", 5, 0.9)], "e string, t bigint, s double"), "e", "user", "t", "s"
    )
    write_records(risk, "risk_profiles", str(tmp_path / "risk"))
    assert read_records(spark, "risk_profiles", str(tmp_path / "risk")).count() == 1
    for table, (schema, stamp) in TABLES.items():
        assert stamp in schema.fieldNames(), table


def test_percentiles_of_days_read_only_the_tail(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(day, float(v)) for day in range(1, 6) for v in rng.random(400) * (1 if day == 4 else 0.5)]
    path = str(tmp_path / "scores")
    spark.createDataFrame(rows, "day int, score double").write.partitionBy("day").parquet(path)
    scores = spark.read.parquet(path)
    sketches = materialize(scoring.score_sketches(scores, "score"))
    wanted = {"P1": 99.9, "P2": 99.0, "P3": 97.0}
    want = {name: float(np.percentile([v for _, v in rows], p)) for name, p in wanted.items()}
    for day in (1, 2, 3, 5):
        for file in glob.glob(f"{path}/day={day}/*.parquet"):
            with open(file, "wb") as broken:
                broken.write(b"never read")
    spark.catalog.refreshByPath(path)
    got = scoring.percentiles_of_days(scores, sketches, "score", wanted)
    assert got == pytest.approx(want)


def test_risk_states_fold_in_any_grouping(spark, tmp_path):
    rng = random.Random(13)
    rows = [(rng.choice("abc"), t, rng.random(), t // 30) for t in range(150)]
    scores = spark.createDataFrame(rows, "entity string, time bigint, score double, run int")
    parts = [
        materialize(scoring.risk_states(scores.where(F.col("run") == run), "entity", "time", "score"))
        for run in range(5)
    ]
    left = parts[0]
    for part in parts[1:]:
        left = scoring.folded_states(left, part)
    right = scoring.folded_states(
        parts[0], scoring.folded_states(scoring.folded_states(parts[1], parts[2]), scoring.folded_states(parts[3], parts[4]))
    )
    whole = scoring.risk_states(scores, "entity", "time", "score")

    def plain(states):
        return sorted((r["entity_id"], r["n_scores"], round(r["decayed"], 9), r["n_anomalies"], r["last_time"]) for r in states.collect())

    assert plain(left) == plain(right) == plain(whole)
    for run in (0, 1, 1, 0):
        fold_risk_states(parts[run], str(tmp_path / "risk"), str(run))
    assert plain(read_risk_states(spark, str(tmp_path / "risk"))) == plain(scoring.folded_states(parts[0], parts[1]))
