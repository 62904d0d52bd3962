from pyspark.sql import Observation

from logsheaf.operators.parse import in_days, parse_auth_lines, parse_counters
from logsheaf.schemas import AUTH_EVENT
from logsheaf.sources.logs import read_log_lines

LINES = [
    "1,U1@D,U2@D,C1,C2,Kerberos,Network,LogOn,Success",
    "  86400,U1,C1,C2,NTLM,Batch,fail ",
    "90000,a,b,c,d,e,f,g, TRUE",
    "1,2,3,4,5,6,7,8",
    "",
    "   ",
    "x,U1,C1,C2,NTLM,Batch,Success",
    "1_000,,,,,,,,",
    "5,a,b,c,d,e,1,",
    "-1,a,b,c,d,e,yes",
]


def test_shapes(spark):
    lines = spark.createDataFrame([(v,) for v in LINES], "value string")
    rows = {(r["time"], r["src_user"]): r for r in parse_auth_lines(lines).collect()}
    assert set(rows) == {(1, "U1@D"), (86400, "U1"), (90000, "a"), (1000, ""), (-1, "a")}
    full, short = rows[(1, "U1@D")], rows[(86400, "U1")]
    assert (full["user"], full["host"], full["is_success"], full["day"]) == ("U1@D", "C1", True, 1)
    assert (short["dst_user"], short["auth_orientation"], short["success"]) == ("UNKNOWN", "UNKNOWN", "fail")
    assert (short["is_success"], short["day"], short["logon_type"]) == (False, 2, "Batch")
    assert rows[(90000, "a")]["is_success"] and rows[(1000, "")]["success"] == ""
    assert rows[(-1, "a")]["day"] == 0


def test_counters_and_observation(spark):
    lines = spark.createDataFrame([(v,) for v in LINES], "value string")
    row = parse_counters(lines, 1, 1).first().asDict()
    assert row == {
        "total_lines": 10,
        "parsed_lines": 5,
        "skipped_lines": 5,
        "bucketed_events": 2,
        "processed_days": 1,
    }
    seen = Observation()
    parse_auth_lines(lines, observation=seen).collect()
    assert seen.get == {"total_lines": 10, "parsed_lines": 5, "skipped_lines": 5}
    assert in_days(parse_auth_lines(lines), 2, 2).count() == 2


def test_filter_does_not_split_again(spark):
    lines = spark.createDataFrame([(v,) for v in LINES], "value string")
    plan = in_days(parse_auth_lines(lines), 1, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def test_file_order_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"first\nbad \xff byte\n")
    (tmp_path / "b.txt").write_bytes(b"\n".join(b"line %d" % i for i in range(500)) + b"\n")
    lines = read_log_lines(spark, str(tmp_path)).orderBy("line_ord").collect()
    assert [r["value"] for r in lines] == ["first", "bad � byte"] + [f"line {i}" for i in range(500)]
    single = read_log_lines(spark, str(tmp_path / "b.txt")).orderBy("line_ord").collect()
    assert [r["value"] for r in single] == [f"line {i}" for i in range(500)]
    assert single[0]["line_ord"]["path"] is None


def test_schema(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LINES[0] + "\n")
    events = parse_auth_lines(read_log_lines(spark, str(tmp_path)))
    got = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    assert got == {f.name: f.dataType.simpleString() for f in AUTH_EVENT.fields}
