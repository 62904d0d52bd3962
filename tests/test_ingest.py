import json

from pyspark.sql import types as T

from logsheaf.functions.wire import encode_json
from logsheaf.operators.parse import parse_auth_lines
from logsheaf.sources.kafka import decode_values, kafka_options, parted_values
from logsheaf.streaming import ingest
from logsheaf.streaming.ingest import clean, drop_blank, run_as_json, run_parted, run_to_files

SCHEMA = "message string, host string, agent string, ecs string, input string, tags string, id int"
MESSAGES = [
    None,
    "",
    "  \t",
    "kept",
    "two\n\nparts",
    "GET /health",
    "GET /healthz",
    "GET /ready",
    "POST /metrics",
    "a line\nGET /health",
    "line\nline",
]
KEPT = {"kept", "GET /healthz", "line\nline"}


def rows():
    return [(m, "h", "a", "e", "i", "t", n) for n, m in enumerate(MESSAGES)]


def test_batch(spark):
    cleaned = clean(spark.createDataFrame(rows(), SCHEMA), dataset="d")
    assert set(cleaned.columns) == {"id", "event"}
    got = cleaned.collect()
    assert {r["event"]["original"] for r in got} == KEPT
    assert {r["event"]["dataset"] for r in got} == {"d"}


def test_existing_event_struct_is_kept(spark):
    df = spark.createDataFrame([("m", ("k",))], "message string, event struct<kind:string>")
    assert clean(df).first()["event"].asDict() == {"kind": "k", "original": "m", "dataset": "raw_logs"}


def test_blank_filter(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    assert {r[0] for r in drop_blank(df).collect()} == set(MESSAGES) - {None, "", "  \t", "two\n\nparts"}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def feed(values):
        spark.createDataFrame(values, SCHEMA).write.mode("append").json(source)

    def run():
        stream = clean(spark.readStream.schema(SCHEMA).json(source))
        run_to_files(stream, out, state).awaitTermination()
        return sorted(r["event"]["original"] for r in spark.read.parquet(out).collect())

    feed(rows())
    assert run() == sorted(KEPT)
    assert run() == sorted(KEPT)
    feed([("later", "h", "a", "e", "i", "t", 99)])
    assert run() == sorted([*KEPT, "later"])


def test_json_on_the_wire(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows(), SCHEMA).write.json(source)
    run_as_json(clean(spark.readStream.schema(SCHEMA).json(source)), out, state).awaitTermination()
    texts = spark.read.text(out)
    assert {json.loads(r["value"])["event"]["original"] for r in texts.collect()} == KEPT
    back = decode_values(texts, T.StructType.fromDDL("id int, event struct<original:string,dataset:string>"))
    assert {r["event"]["original"] for r in back.collect()} == KEPT
    assert encode_json(back).columns == ["value"]


def test_kafka_options():
    assert kafka_options("b:1", startingOffsets="earliest") == {
        "kafka.bootstrap.servers": "b:1",
        "subscribe": "raw-logs",
        "startingOffsets": "earliest",
    }


def test_stream_of_auth_lines(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    lines = ["1,U1,U2,C1,C2,K,N,LogOn,Success", "2,U1,C1,C2,K,N,Fail", "bad"]
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(source)
    events = parse_auth_lines(spark.readStream.text(source))
    run_to_files(events, out, state).awaitTermination()
    assert sorted((r["time"], r["is_success"]) for r in spark.read.parquet(out).collect()) == [(1, True), (2, False)]


EVENT = T.StructType().add("a", T.LongType()).add("b", T.StructType().add("c", T.StringType()))
FIT = ['{"a": 1}', '{"a": null, "b": {"c": "x"}, "other": 2}', " {} "]
UNFIT = ['{"a": 1', '{"a": "one"}', "[]x", "3", "", "text", None]


def test_unfit_values(spark):
    records = spark.createDataFrame([(v, i) for i, v in enumerate(FIT + UNFIT)], "value string, offset long")
    events, refused = parted_values(records, EVENT)
    assert sorted(map(str, events.collect())) == sorted(
        ["Row(a=1, b=None)", "Row(a=None, b=Row(c='x'))", "Row(a=None, b=None)"]
    )
    assert {(r["value"], r["offset"]) for r in refused.collect()} == {(v, i + 3) for i, v in enumerate(UNFIT)}
    named = T.StructType().add("_broken", T.StringType()).add("value", T.StringType())
    events, _ = parted_values(spark.createDataFrame([('{"_broken": "b", "value": "v"}',)], "value string"), named)
    assert [tuple(r) for r in events.collect()] == [("b", "v")]


def test_unfit_values_go_aside_and_nothing_is_stored_twice(spark, tmp_path, monkeypatch):
    source, out, aside, state = (str(tmp_path / n) for n in ("in", "out", "aside", "state"))

    def feed(values):
        spark.createDataFrame([(v,) for v in values], "value string").write.mode("append").text(source)

    def run():
        run_parted(spark.readStream.text(source), EVENT, out, aside, state).awaitTermination()

    def stored():
        return [sorted(str(r) for r in spark.read.parquet(p).drop("batch").collect()) for p in (out, aside)]

    feed(FIT + UNFIT[:-1])
    run()
    first = stored()
    assert len(first[0]) == 3 and "Row(a=None, b=None)" in first[0] and len(first[1]) == 6
    run()
    assert stored() == first
    # A batch that stops between its two places is run again in full.
    whole = ingest.parted_values

    def half(records, schema):
        events, refused = whole(records, schema)
        yield events
        raise RuntimeError("lost")

    feed(['{"a": 7}', "bad"])
    monkeypatch.setattr(ingest, "parted_values", half)
    try:
        run()
    except Exception:
        pass
    monkeypatch.undo()
    assert len(stored()[1]) == 6
    run()
    events, refused = stored()
    assert events == sorted([*first[0], "Row(a=7, b=None)"]) and refused == sorted([*first[1], "Row(value='bad')"])
