import pytest
from pyspark.sql import types as T

from logsheaf.config import TRAINING_SESSIONS, TRAINING_SPLIT_DAYS
from logsheaf.functions.tokens import token_schema
from logsheaf.operators.quality import (
    coerce_events,
    malformed_counters,
    require_events,
    session_summary,
    token_quality,
    token_warnings,
)
from logsheaf.operators.vocabulary import token_counts
from logsheaf.operators.splits import day_from_path, in_split, missing_days, split_days
from pyspark.sql import functions as F

EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "auth_type", "logon_type")])
SESSIONS = "day int, events array<struct<event_id:string,auth_type:string,logon_type:string>>"


def test_malformed_events(spark):
    texts = [
        '[{"event_id": "A", "auth_type": "Kerberos"}, "text", 3]',
        '"a text"',
        None,
        "not json",
        '{"event_id": "A"}',
        "[]",
        '[null, {"event_id": 5}]',
        "null",
    ]
    df = coerce_events(spark.createDataFrame([(t,) for t in texts], "events string").coalesce(1), EVENT)
    rows = df.collect()
    assert [len(r["events"]) for r in rows] == [1, 0, 0, 0, 0, 0, 1, 0]
    assert [r["dropped_events"] for r in rows] == [2, 0, 0, 0, 0, 0, 1, 0]
    assert [r["invalid_event_containers"] for r in rows] == [0, 1, 0, 1, 1, 0, 0, 0]
    assert rows[0]["events"][0].asDict() == {"event_id": "A", "auth_type": "Kerberos", "logon_type": None}
    assert tuple(malformed_counters(df).first()) == (3, 3)


def sessions(spark, *rows):
    return spark.createDataFrame(list(rows), SESSIONS)


def test_summary_and_guard(spark):
    df = sessions(spark, (1, [("A", "K", "N")]), (1, []), (2, None))
    assert tuple(session_summary(df).first()) == (3, 1, 1)
    require_events(df)
    with pytest.raises(RuntimeError):
        require_events(df.where("day = 2"))


def test_token_warnings(spark):
    few = sessions(spark, (1, [(None, "K", "N"), ("UNK", "K", "N"), (" NA ", "K", "N"), ("1", "K", "N")]))
    row = token_quality(few)
    assert tuple(row.first()) == (4, 3, 4)
    assert len(token_warnings(row, 6)) == 1
    many = token_quality(sessions(spark, (1, [(str(i), "K", "N") for i in range(50)])))
    assert tuple(many.first()) == (50, 0, 50)
    assert "tokens learned" in token_warnings(many, 6)[0]
    assert token_warnings(many, 55) == []
    assert token_quality(few, approximate=True).first()["distinct_tokens"] == 4


def test_splits(spark):
    df = sessions(spark, *[(d, []) for d in (1, 40, 41, 50, 51, 58, 60)])
    days = {name: sorted(r["day"] for r in in_split(df, name).collect()) for name in ("train", "val", "test", "all")}
    assert days == {"train": [1, 40], "val": [41, 50], "test": [51, 58], "all": [1, 40, 41, 50, 51, 58, 60]}
    assert sorted(r["day"] for r in missing_days(df, "val").collect()) == list(range(42, 50))
    assert missing_days(df, "all").count() == 0
    with pytest.raises(ValueError):
        split_days("other")


def test_day_from_path(spark):
    df = spark.createDataFrame([("file:/x/day_07.parquet",)], "p string")
    assert df.select(day_from_path(F.col("p"))).first()[0] == 7
    with pytest.raises(Exception, match="no day"):
        spark.createDataFrame([("x.parquet",)], "p string").select(day_from_path(F.col("p"))).collect()


def test_declared_training_settings(spark):
    df = sessions(spark, *[(d, []) for d in (50, 51, 55, 56, 58)])
    days = {n: sorted(r["day"] for r in in_split(df, n, TRAINING_SPLIT_DAYS).collect()) for n in TRAINING_SPLIT_DAYS}
    assert days == {"pretrain": [50], "finetune": [51, 55], "test": [56, 58]}
    assert (TRAINING_SESSIONS.min_events, TRAINING_SESSIONS.max_tokens) == (3, 500)


def test_null_elements_of_typed_lists(spark):
    df = coerce_events(sessions(spark, (1, [("A", "K", "N"), None]), (1, None)).coalesce(1), EVENT)
    assert [(len(r["events"]), r["dropped_events"]) for r in df.collect()] == [(1, 1), (0, 0)]


def test_only_token_fields_are_read(spark, tmp_path):
    rows = [(1, [(5, "A", "K", "N", True), None])]
    ddl = "day int, events array<struct<time:bigint,event_id:string,auth_type:string,logon_type:string,ok:boolean>>"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))

    def read(df):
        return df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]

    narrow = spark.read.schema(token_schema(stored.schema)).parquet(str(tmp_path / "s"))
    for df in (token_quality(narrow), token_counts(narrow)):
        assert "event_id" in read(df) and "time" not in read(df) and "ok" not in read(df)
    assert "event_id" not in read(session_summary(stored))
    for df in (stored, narrow):
        assert [tuple(r) for r in token_counts(df).collect()] == [("A_K_N", 1)]
