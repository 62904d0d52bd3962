import glob
import os

import pytest
from pyspark.sql import functions as F

from logsheaf.config import TokenConfig
from logsheaf.functions.text import floor_div
from logsheaf.operators import chunks as chunking
from logsheaf.plans.tokens import run_tokens
from logsheaf.session import materialize
from logsheaf.sources import versions
from logsheaf.sources.sequences import read_sequences, stored_chunks, write_chunks
from logsheaf.sources.sessions import write_sessions

RANGES = {"all": (1, 3)}


@pytest.fixture
def sessions_path(spark, tmp_path):
    number = F.col("id")
    event = F.struct(
        number.alias("time"), F.lit("e").alias("event_id"), F.lit("a").alias("auth_type"),
        F.lit("l").alias("logon_type"),
    )
    sessions = spark.range(300).select(
        F.format_string("s%04d", number).alias("session_id"), F.lit("u").alias("user_id"),
        F.lit("h").alias("host_id"), number.alias("start_ts"), number.alias("end_ts"),
        F.array(event, event, event).alias("events"), F.lit(None).cast("int").alias("label"),
        (floor_div(number, 100) + 1).cast("int").alias("day"),
    )
    write_sessions(sessions, str(tmp_path / "sessions"))
    return str(tmp_path / "sessions")


def test_files_follow_the_sessions(spark, sessions_path, tmp_path, monkeypatch):
    """150 chunks of two sessions in 10 files; a damaged file costs its own chunks only."""
    monkeypatch.setattr(chunking, "FILES", 10)
    out, config = str(tmp_path / "out"), TokenConfig(min_freq=1, max_len=8, chunk_size=2)

    def run():
        return run_tokens(
            spark, sessions_path, str(tmp_path / "v"), out, "all", config, resume=True, ranges=RANGES
        )

    run()
    files = sorted(glob.glob(f"{out}/v=*/split=all/chunk=*/*.parquet"))
    assert len(files) == 10
    whole = sorted(map(str, read_sequences(spark, out).collect()))
    keys = sorted((r["day"], r["session_id"], r["chunk"]) for r in read_sequences(spark, out).collect())
    assert [chunk for _, _, chunk in keys] == [i // 2 for i in range(300)]
    assert len(stored_chunks(spark, out, "all")) == 150
    assert run().skipped

    os.remove(files[3])
    fixed = run()
    assert not fixed.skipped and fixed.manifest.first()["session_count"] == 300
    assert sorted(map(str, read_sequences(spark, out).collect())) == whole
    assert len(set(stored_chunks(spark, out, "all").values())) == 2
    present = {os.path.basename(os.path.dirname(f)) for f in files[:3] + files[4:]}
    again = [f for f in glob.glob(f"{out}/v=*/split=all/chunk=*/*.parquet") if f not in files]
    assert again and not present & {os.path.basename(os.path.dirname(f)) for f in again}
    assert run().skipped

    # A file's chunks are kept together or not at all.
    one = materialize(read_sequences(spark, out).where("chunk = 0"))
    with pytest.raises(ValueError):
        write_chunks(one, out, config, "all", [c for c in stored_chunks(spark, out, "all") if c != 0])


def test_few_or_large_chunks_have_files_of_their_own():
    assert chunking.chunks_per_file(1_000, 5) == 1
    assert chunking.chunks_per_file(1_000_000, 10_000) == 1
    assert chunking.chunks_per_file(110_000, 5) == 110
    assert chunking.chunks_per_file(1_000_000, 100) == 100


def test_names_in_a_folder(spark, tmp_path):
    names = ["a b", "c,d", "chunk=000001", "{e}"]
    for name in names:
        (tmp_path / name).mkdir()
    assert versions.listed(spark, str(tmp_path)) == sorted(names)


def test_completeness_reads_the_sequences_once(spark, monkeypatch):
    from logsheaf.plans import workload

    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    columns = "session_id string, n_events long, n_unknown long, input_ids array<int>, attention_mask array<tinyint>, split string, chunk long"
    ids = F.array_repeat(F.lit(1), workload.TOKENS.max_len)
    stored = spark.range(20).select(
        F.format_string("s%d", "id").alias("session_id"), F.lit(3).cast("long").alias("n_events"),
        F.lit(0).cast("long").alias("n_unknown"), ids.alias("input_ids"),
        ids.cast("array<tinyint>").alias("attention_mask"), F.lit("all").alias("split"),
        F.lit(0).cast("long").alias("chunk"),
    ).mapInArrow(count, columns)
    monkeypatch.setattr(workload, "_stored_sequences", lambda *_: stored)
    monkeypatch.setattr(workload, "_sessions", lambda *_: spark.range(20))
    rows = [(row["more"], row["complete"]) for row in workload.completeness(spark, "").collect()]
    assert sorted(rows) == [(0, True), (1, False)]
    assert passed.value == 20
