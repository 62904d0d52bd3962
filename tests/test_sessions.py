import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logsheaf import SessionConfig
from logsheaf.operators.sessions import build_sessions, hot_groups, prepare_events, session_windows

EVENT = "user string, host string, time bigint, event_id string, ord int"


def frame(spark, rows):
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], EVENT)


def sessions_of(events, config):
    return build_sessions(prepare_events(events, config, ["ord"]), config)


def shape(sessions):
    return sorted(
        (r["day"], r["user_id"], r["host_id"], r["start_ts"], r["end_ts"], tuple(e["event_id"] for e in r["events"]))
        for r in sessions.collect()
    )


def brute(rows, size, stride, least, most):
    """Windows by a plain loop; groups are given by user, host and day."""
    groups = {}
    for order, (user, host, time, event_id) in enumerate(rows):
        groups.setdefault((time // 86400 + 1, user, host), []).append((time, order, event_id))
    found = []
    for (day, user, host), events in groups.items():
        events.sort()
        start = events[0][0]
        while start <= events[-1][0]:
            inside = [e for e in events if start <= e[0] < start + size]
            if len(inside) >= least:
                found.append((day, user, host, start, tuple(e[2] for e in inside[-most:])))
            start += stride
    return found


def test_grouping(spark):
    rows = [("alice", "pc1", t, f"a{t}") for t in (0, 300, 900)]
    rows += [("alice", "pc2", t, f"b{t}") for t in (0, 200, 400)]
    rows += [("bob", "pc9", t, f"c{t}") for t in (0, 600)]
    got = shape(sessions_of(frame(spark, rows), SessionConfig()))
    assert [(g[3], g[4], len(g[5])) for g in got] == [(0, 1800, 3), (0, 1800, 3)]
    assert len({g[1] for g in got}) == 1 and len({g[2] for g in got}) == 2


def test_overlap(spark):
    rows = [("u", "h", t, str(t)) for t in (0, 600, 1200, 1500, 1800, 2100, 2400)]
    got = shape(sessions_of(frame(spark, rows), SessionConfig()))
    assert [(g[3], len(g[5])) for g in got] == [(0, 4), (900, 5), (1800, 3)]


def test_sparse_and_last_n(spark):
    assert shape(sessions_of(frame(spark, [("u", "h", 0, "a"), ("u", "h", 1, "b")]), SessionConfig())) == []
    rows = [("u", "h", t, str(t)) for t in range(10)]
    config = SessionConfig(window_mins=60, stride_mins=60, min_events=1, max_tokens=5)
    assert [g[5] for g in shape(sessions_of(frame(spark, rows), config))] == [("5", "6", "7", "8", "9")]


@pytest.mark.parametrize("field", ["window_mins", "stride_mins", "min_events", "max_tokens"])
def test_bad_parameters(field):
    with pytest.raises(ValueError):
        SessionConfig(**{field: 0})
    with pytest.raises(ValueError):
        SessionConfig(timestamp_unit="minutes")


def test_sensitive_fields_are_dropped_and_event_id_filled(spark):
    rows = [("a", "b", "c", "d", "e", "f", ["p"], 42, "K", "N", t) for t in range(3)]
    ddl = (
        "user string, host string, src_user string, dst_user string, src_computer string, "
        "dst_computer string, template_params array<string>, template_id int, auth_type string, "
        "logon_type string, time bigint"
    )
    session = sessions_of(
        spark.createDataFrame(rows, ddl).withColumn("ord", F.col("time")), SessionConfig()
    ).first()
    assert set(session["events"][0].asDict()) == {"time", "template_id", "auth_type", "logon_type", "event_id"}
    assert [e["event_id"] for e in session["events"]] == ["42"] * 3


def test_time_from_text_or_timestamp(spark):
    rows = [("x", 5), (" 7 ", 1), (None, 9), ("1.5", None)]
    df = spark.createDataFrame(rows, "time string, timestamp bigint")
    got = prepare_events(df.withColumn("user", F.lit("u"))).select("time").collect()
    assert sorted(r["time"] for r in got) == [5, 7, 9]


def test_equal_times_keep_order(spark):
    rows = [("u", "h", 0, f"A{i}") for i in range(3)] + [("v", "g", 100 + i, f"B{i}") for i in range(3)]
    for parts in (1, 3, 7):
        got = shape(sessions_of(frame(spark, rows).repartition(parts), SessionConfig()))
        assert sorted(g[5] for g in got) == [("A0", "A1", "A2"), ("B0", "B1", "B2")]


@pytest.mark.parametrize(
    "window,stride,least,most", [(30, 15, 3, 512), (20, 50, 1, 4), (37, 11, 2, 3), (60, 60, 5, 2)]
)
def test_matches_plain_loop(spark, window, stride, least, most):
    draw = random.Random(window)
    rows = [
        (draw.choice(["u1", "u2", "u3", "hot", "hot", "hot"]), draw.choice("ab"), draw.randrange(0, 260_000, 60), str(i))
        for i in range(900)
    ]
    config = SessionConfig(window_mins=window, stride_mins=stride, min_events=least, max_tokens=most)
    events = frame(spark, rows)
    want = sorted((d, s, e) for d, _, _, s, e in brute(rows, window * 60, stride * 60, least, most))
    plain = shape(sessions_of(events, config))
    assert sorted((g[0], g[3], g[5]) for g in plain) == want
    # The route of large groups gives the same sessions, however many are large.
    for change in ({"hot_group_rows": 1}, {"hot_group_rows": 60}, {"hot_group_rows": 1, "max_hot_groups": 2}):
        assert shape(sessions_of(events.repartition(5), replace(config, **change))) == plain
    counted = session_windows(prepare_events(events, config, ["ord"]), replace(config, hot_group_rows=40))
    full = shape(sessions_of(events, replace(config, max_tokens=10_000)))
    assert sorted((r["day"], r["user_id"], r["start_ts"], r["n_events"]) for r in counted.collect()) == sorted(
        (g[0], g[1], g[3], len(g[5])) for g in full
    )


def test_milliseconds(spark):
    rows = [("u", "h", t * 1000, str(t)) for t in (0, 600, 1200, 1500, 1800, 2100, 2400)]
    got = shape(sessions_of(frame(spark, rows), SessionConfig(timestamp_unit="milliseconds")))
    assert [(g[0], g[3], len(g[5])) for g in got] == [(1, 0, 4), (1, 900_000, 5), (1, 1_800_000, 3)]


def test_days_are_independent(spark):
    rows = [("u", "h", t, str(t)) for t in (86_100, 86_200, 86_300, 86_500, 86_600)]
    got = shape(sessions_of(frame(spark, rows), SessionConfig(min_events=2)))
    assert [(g[0], g[3], len(g[5])) for g in got] == [(1, 86_100, 3), (2, 86_500, 2)]


def test_only_large_groups_are_hot(spark):
    rows = [("big", "h", t, str(t)) for t in range(50)] + [("small", "h", 0, "x")]
    prepared = prepare_events(frame(spark, rows), SessionConfig(), ["ord"])
    assert hot_groups(prepared, SessionConfig(hot_group_rows=100)) is None
    assert hot_groups(prepared, SessionConfig(hot_group_rows=None)) is None
    assert hot_groups(prepared, SessionConfig(hot_group_rows=10)).count() == 1


def test_plan_shuffles_once_and_limits_before_shuffling(spark):
    prepared = prepare_events(frame(spark, [("u", "h", t, str(t)) for t in range(5)]), SessionConfig(), ["ord"])

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    ordinary = plan(build_sessions(prepared, SessionConfig(hot_group_rows=None)))
    assert ordinary.count("Exchange hashpartitioning") == 1
    heavy = plan(build_sessions(prepared, SessionConfig(hot_group_rows=1)))
    assert "Partial" in heavy and "WindowGroupLimit" in heavy
