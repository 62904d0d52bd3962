import glob
import hashlib
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from logsheaf import SessionConfig, TokenConfig
from logsheaf.operators.chunks import chunk_report
from logsheaf.plans.sessions import run_sessions
from logsheaf.plans.tokens import run_tokens
from logsheaf.session import materialize, shared_dir, shuffle_partitions, sized_shuffles, table_exists
from logsheaf.sources.metrics import read_metrics
from logsheaf.sources.sequences import read_sequences, stored_chunks, write_chunks, write_single
from logsheaf.sources.sessions import read_session_shards, read_sessions, shard_counts, write_sessions
from logsheaf.sources.vocabulary import export_vocabulary_json, read_vocabulary_json, write_vocabulary

RANGES = {"train": (1, 2), "val": (3, 3), "all": (1, 3)}


def log_lines(days, seed=0):
    draw = random.Random(seed)
    lines = []
    for day in days:
        for _ in range(400):
            time = (day - 1) * 86_400 + draw.randrange(86_400)
            user, computer = f"U{draw.randrange(3)}@D", f"C{draw.randrange(2)}"
            kind = draw.choice(["Kerberos", "NTLM", "?"] + (["Late"] if day == 3 else []))
            way = draw.choice(["Network", "Batch"])
            lines.append(f"{time},{user},{user},{computer},C9,{kind},{way},LogOn,{draw.choice(['Success', 'Fail'])}")
    lines.sort(key=lambda line: int(line.split(",")[0]))
    return lines + ["bad line", "", "1,2,3"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    (root / "auth.txt").write_text("\n".join(log_lines((1, 2, 3))) + "\n")
    paths = {name: str(root / name) for name in ("sessions", "templates", "vocabulary", "sequences")}
    paths["metrics"] = str(root / "metrics")
    result = run_sessions(
        spark, [str(root / "auth.txt")], paths["sessions"], paths["templates"], 1, 3,
        SessionConfig(window_mins=120, stride_mins=60), paths["metrics"],
    )
    return root, paths, result


def test_sessions_job(spark, built):
    root, paths, result = built
    counters = result.counters
    assert (counters["total_lines"], counters["parsed_lines"], counters["skipped_lines"]) == (1203, 1200, 3)
    assert (counters["bucketed_events"], counters["processed_days"]) == (1200, 3)
    assert counters["written_sessions"] == result.sessions.count() > 50
    assert sum(r["events"] for r in result.per_day.collect()) == 1200

    # The same sessions by a plain loop over the file.
    groups = {}
    for order, line in enumerate(log_lines((1, 2, 3))[:1200]):
        parts = line.split(",")
        groups.setdefault((int(parts[0]) // 86_400 + 1, parts[1], parts[3]), []).append((int(parts[0]), order, parts))
    want = []
    for (day, _, _), events in groups.items():
        events.sort(key=lambda e: e[:2])
        start = events[0][0]
        while start <= events[-1][0]:
            inside = [e[2] for e in events if start <= e[0] < start + 7200]
            if len(inside) >= 3:
                want.append((day, start, tuple((int(p[0]), p[5], p[6], p[8] == "Success") for p in inside)))
            start += 3600
    got = [
        (r["day"], r["start_ts"], tuple((e["time"], e["auth_type"], e["logon_type"], e["is_success"]) for e in r["events"]))
        for r in result.sessions.collect()
    ]
    assert sorted(got) == sorted(want)
    assert not glob.glob(f"{paths['sessions']}/**/_temporary", recursive=True)

    # Template ids follow the (auth type, logon type, success) of the event.
    kinds = {}
    for row in result.sessions.select(F.explode("events").alias("e")).select("e.*").collect():
        kinds.setdefault(row["template_id"], set()).add((row["auth_type"], row["logon_type"], row["success"]))
        assert row["event_id"] == str(row["template_id"])
    assert all(len(found) == 1 for found in kinds.values())


def test_large_groups_give_the_same_sessions(spark, built, tmp_path):
    root, _, result = built
    config = SessionConfig(window_mins=120, stride_mins=60, hot_group_rows=70)
    again = run_sessions(spark, [str(root / "auth.txt")], str(tmp_path / "s"), str(tmp_path / "t"), 1, 3, config)
    assert sorted(map(str, again.sessions.collect())) == sorted(map(str, result.sessions.collect()))


def test_staged_events_are_removed(spark, built):
    _, _, result = built
    folder = f"{shared_dir(spark)}/logsheaf/{spark.sparkContext.applicationId}".removeprefix("file:")
    kept = [spark.read.parquet(f"{folder}/{name}").columns for name in os.listdir(folder)]
    assert kept and not any("line_ord" in columns for columns in kept)


def test_metrics(spark, built, tmp_path):
    _, paths, result = built
    stored = {r["name"]: r["value"] for r in read_metrics(spark, paths["metrics"]).collect()}
    assert stored == result.counters
    config, where = TokenConfig(min_freq=1, max_len=8), str(tmp_path / "m")
    for resume in (False, True):
        run_tokens(
            spark, paths["sessions"], str(tmp_path / "v"), str(tmp_path / "s"), "val", config,
            resume=resume, ranges=RANGES, metrics_path=where,
        )
    events = [r["event"] for r in read_metrics(spark, where).select("at", "event").distinct().orderBy("at").collect()]
    once = ["start", "token_quality", "chunk_written", "complete"]
    assert events == [*once, "start", "skip_complete"]
    days = spark.read.parquet(str(tmp_path / "s_days"))
    assert [r["day"] for r in days.collect()] == [3]


def test_shuffle_partitions():
    assert shuffle_partitions(0) == 200 and shuffle_partitions(100 * 1024**4) == 819_200
    assert shuffle_partitions(1024**4) == 8192


def test_large_inputs_raise_the_shuffles(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with sized_shuffles(spark, 1024**4):
        assert spark.conf.get(key) == "8192"
    assert spark.conf.get(key) == before


def test_a_day_without_sessions_is_emptied(spark, built, tmp_path):
    out = [str(tmp_path / name) for name in ("sessions", "templates")]
    config = SessionConfig(window_mins=120, stride_mins=60)
    lines = log_lines((1, 2))
    for kept in (lines, [line for line in lines if "," in line][:400] + ["86500,U1@D,U1@D,C1,C9,NTLM,Batch,LogOn,Fail"]):
        file = tmp_path / f"{len(kept)}.txt"
        file.write_text("\n".join(kept) + "\n")
        result = run_sessions(spark, [str(file)], *out, 1, 2, config)
    assert {r["day"] for r in read_sessions(spark, out[0]).select("day").distinct().collect()} == {1}
    assert result.counters["processed_days"] == 2
    assert result.counters["written_sessions"] == read_sessions(spark, out[0]).count()
    assert sum(r["n_events"] for r in result.templates.collect()) == 401


def test_rerun_of_a_day_keeps_other_days_and_ids(spark, built, tmp_path):
    root, paths, result = built
    before = sorted(map(str, result.sessions.where("day <> 2").collect()))
    ids = sorted((r["signature"], r["template_id"]) for r in result.templates.collect())
    (tmp_path / "more.txt").write_text("\n".join(log_lines((2,), seed=5)) + "\n")
    again = run_sessions(
        spark, [str(tmp_path / "more.txt")], paths["sessions"], paths["templates"], 2, 2,
        SessionConfig(window_mins=120, stride_mins=60),
    )
    assert sorted(map(str, read_sessions(spark, paths["sessions"]).where("day <> 2").collect())) == before
    assert again.counters["processed_days"] == 1
    assert sorted((r["signature"], r["template_id"]) for r in again.templates.collect()) == ids


def test_tokens_job(spark, built):
    root, paths, _ = built
    config = TokenConfig(min_freq=1, max_len=8, chunk_size=10)
    train = run_tokens(spark, paths["sessions"], paths["vocabulary"], paths["sequences"], "train", config, ranges=RANGES)
    sessions = read_sessions(spark, paths["sessions"])
    manifest = train.manifest.first()
    assert manifest["session_count"] == sessions.where("day <= 2").count()
    assert manifest["unknown_events"] == 0 and manifest["invalid_rows"] == 0
    assert manifest["total_events"] == sessions.where("day <= 2").agg(F.sum(F.size("events"))).first()[0]
    files = chunk_report(read_sequences(spark, paths["sequences"]), 8).collect()
    assert max(r["sessions"] for r in files) <= 10

    # Another split with the train vocabulary: unseen tokens read [UNK].
    val = run_tokens(
        spark, paths["sessions"], paths["vocabulary"], paths["sequences"], "val", config,
        vocabulary_in=paths["vocabulary"], ranges=RANGES,
    )
    assert val.vocabulary.count() == train.vocabulary.count()
    assert val.manifest.first()["unknown_events"] > 0
    assert read_sequences(spark, paths["sequences"]).select("day").distinct().count() == 3

    # Nothing left to do.
    again = run_tokens(
        spark, paths["sessions"], paths["vocabulary"], paths["sequences"], "train", config, resume=True, ranges=RANGES
    )
    assert again.skipped


def chunk_files(out, chunk, split="all"):
    return glob.glob(f"{out}/v=*/split={split}/chunk={chunk:06}/*.parquet")


def test_chunks_are_numbered_and_full(spark, built, tmp_path):
    """The same for any number of partitions."""
    _, paths, _ = built
    sessions, config = read_sessions(spark, paths["sessions"]), TokenConfig(min_freq=1, max_len=8, chunk_size=7)
    keys = sorted((r["day"], r["session_id"]) for r in sessions.select("day", "session_id").collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        out = str(tmp_path / f"s{partitions}")
        try:
            run_tokens(spark, paths["sessions"], str(tmp_path / "v"), out, "all", config, ranges=RANGES)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        got = read_sequences(spark, out).select("chunk", "day", "session_id").collect()
        assert {(r["day"], r["session_id"]): r["chunk"] for r in got} == {k: i // 7 for i, k in enumerate(keys)}
        assert all(len(chunk_files(out, chunk)) == 1 for chunk in range(-(-len(keys) // 7)))


def test_resume_mends_only_damaged_chunks(spark, built, tmp_path):
    root, paths, _ = built
    out, metrics = str(tmp_path / "sequences"), str(tmp_path / "metrics")
    config = TokenConfig(min_freq=1, max_len=8, chunk_size=10)

    def run(resume=True):
        return run_tokens(
            spark, paths["sessions"], str(tmp_path / "v"), out, "all", config,
            resume=resume, ranges=RANGES, metrics_path=metrics,
        )

    run(False)
    assert run().skipped
    whole = sorted(map(str, read_sequences(spark, out).collect()))
    untouched = chunk_files(out, 0)
    # One file is cut off, one is lost, one lost its folder, and one has short rows.
    cut = chunk_files(out, 1)[0]
    data = open(cut, "rb").read()
    with open(cut, "wb") as file:
        file.write(data[: len(data) // 2])
    os.remove(chunk_files(out, 2)[0])
    shutil.rmtree(os.path.dirname(chunk_files(out, 3)[0]))
    short = read_sequences(spark, out, damaged="skip").where("chunk = 4").withColumn(
        "input_ids", F.slice("input_ids", 1, 3)
    )
    write_chunks(materialize(short), out, config, "all", [c for c in stored_chunks(spark, out, "all") if c != 4])
    fixed = run()
    assert not fixed.skipped
    assert sorted(map(str, read_sequences(spark, out).collect())) == whole
    assert chunk_files(out, 0) == untouched
    written = read_metrics(spark, metrics).where("event = 'chunk_written' and name = 'chunk_count'")
    numbers = [r["value"] for r in written.orderBy("at", "value").collect()]
    assert sorted(numbers)[:9] == [1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert run().skipped


def test_vanished_days_leave_the_sequences(spark, built, tmp_path):
    _, paths, _ = built
    mine, out = str(tmp_path / "sessions"), str(tmp_path / "sequences")
    sessions = read_sessions(spark, paths["sessions"])
    write_sessions(sessions, mine)
    config = TokenConfig(min_freq=1, max_len=8, chunk_size=10)

    def run():
        return run_tokens(spark, mine, str(tmp_path / "v"), out, "all", config, resume=True, ranges=RANGES)

    run()
    write_sessions(sessions.where("false"), mine, [2])
    changed = run()
    assert not changed.skipped
    left = sessions.where("day <> 2").count()
    assert changed.manifest.first()["session_count"] == left == read_sequences(spark, out).count()
    assert run().skipped


def test_a_run_that_stops_early_changes_nothing(spark, built, tmp_path, monkeypatch):
    from logsheaf.sources import versions

    _, paths, _ = built
    mine, out = str(tmp_path / "sessions"), str(tmp_path / "sequences")
    sessions = read_sessions(spark, paths["sessions"])
    write_sessions(sessions, mine)
    config = TokenConfig(min_freq=1, max_len=8, chunk_size=10)
    run_tokens(spark, mine, str(tmp_path / "v"), out, "all", config, ranges=RANGES)
    before = [sorted(map(str, t.collect())) for t in (read_sessions(spark, mine), read_sequences(spark, out))]

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "commit", stop)
    with pytest.raises(KeyboardInterrupt):
        write_sessions(sessions.where("day = 1").limit(1), mine, [1, 2, 3])
    with pytest.raises(KeyboardInterrupt):
        run_tokens(spark, mine, str(tmp_path / "v"), out, "all", config, ranges=RANGES)
    monkeypatch.undo()
    after = [sorted(map(str, t.collect())) for t in (read_sessions(spark, mine), read_sequences(spark, out))]
    assert after == before
    # What stopped is cleared away by later runs, and so are versions out of use.
    for _ in range(3):
        write_sessions(sessions.where("day = 1").limit(1), mine, [1, 2, 3])
    assert read_sessions(spark, mine).count() == 1
    assert len(glob.glob(f"{mine}/v=*")) == 2 and len(glob.glob(f"{mine}/_pointers/*.json")) == 2


def test_days_stored_without_versions_stay_readable(spark, built, tmp_path):
    _, paths, _ = built
    mine = str(tmp_path / "sessions")
    sessions = read_sessions(spark, paths["sessions"])
    sessions.write.partitionBy("day").parquet(mine)
    assert read_sessions(spark, mine).count() == sessions.count()
    write_sessions(sessions.where("day = 2").limit(3), mine, [2, 3])
    counts = {r["day"]: r["sessions"] for r in shard_counts(read_sessions(spark, mine)).collect()}
    assert counts == {1: sessions.where("day = 1").count(), 2: 3}


def test_empty_split_is_an_error(spark, built, tmp_path):
    _, paths, _ = built
    with pytest.raises(RuntimeError):
        run_tokens(spark, paths["sessions"], str(tmp_path / "v"), str(tmp_path / "s"), "test")


def test_shard_files_and_counts(spark, built, tmp_path):
    _, paths, _ = built
    sessions = read_sessions(spark, paths["sessions"])
    sessions.where("day = 3").drop("day").coalesce(1).write.parquet(str(tmp_path / "one"))
    part = glob.glob(str(tmp_path / "one/*.parquet"))[0]
    os.rename(part, str(tmp_path / "day_03.parquet"))
    shards = read_session_shards(spark, str(tmp_path / "day_03.parquet"))
    assert {r["day"]: r["sessions"] for r in shard_counts(shards).collect()} == {
        3: sessions.where("day = 3").count()
    }
    bad = tmp_path / "day_04.parquet"
    bad.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        read_session_shards(spark, str(bad)).collect()


def test_vocabulary_json(spark, tmp_path):
    vocabulary = spark.createDataFrame([("b", 1), ("a", 0)], "token string, token_id int")
    write_vocabulary(vocabulary, str(tmp_path / "v"))
    export_vocabulary_json(vocabulary, str(tmp_path / "j"))
    back = read_vocabulary_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, back.collect())) == [("a", 0), ("b", 1)]
    assert table_exists(spark, str(tmp_path / "v")) and not table_exists(spark, str(tmp_path / "none"))


def test_single_artifact(spark, built, tmp_path):
    _, paths, _ = built
    config = TokenConfig(min_freq=1, max_len=8)
    stored = read_sequences(spark, paths["sequences"])
    write_single(stored, str(tmp_path / "single"), config)
    assert read_sequences(spark, str(tmp_path / "single")).count() == stored.count()


def test_days_are_pruned(spark, built):
    _, paths, _ = built
    plan = read_sessions(spark, paths["sessions"]).where("day = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_write_sessions_replaces_only_its_days(spark, built, tmp_path):
    _, paths, _ = built
    sessions = read_sessions(spark, paths["sessions"])
    out = str(tmp_path / "s")
    write_sessions(sessions.where("day <= 2"), out)
    write_sessions(sessions.where("day = 2").limit(1), out)
    counts = {r["day"]: r["sessions"] for r in shard_counts(read_sessions(spark, out)).collect()}
    assert counts == {1: sessions.where("day = 1").count(), 2: 1}


def test_shards_without_ids_and_null_events(spark, built, tmp_path):
    _, paths, _ = built
    sessions = read_sessions(spark, paths["sessions"])
    null = F.array(F.lit(None).cast(sessions.schema["events"].dataType.elementType))
    plain = sessions.where("day = 3").drop("day", "session_id").withColumn("events", F.concat(null, "events"))
    plain.coalesce(1).write.parquet(str(tmp_path / "one"))
    shard = str(tmp_path / "day_03.parquet")
    os.rename(glob.glob(str(tmp_path / "one/*.parquet"))[0], shard)
    config = TokenConfig(min_freq=1, max_len=8)
    out = {
        name: run_tokens(
            spark, source, str(tmp_path / f"v{name}"), str(tmp_path / name), "val", config,
            ranges=RANGES, metrics_path=str(tmp_path / f"m{name}"),
        )
        for name, source in (("a", [shard]), ("b", paths["sessions"]))
    }
    rows = [sorted(map(str, out[name].sequences.collect())) for name in "ab"]
    assert rows[0] == rows[1] and rows[0]
    started = read_metrics(spark, str(tmp_path / "ma")).where("event = 'start' and name = 'dropped_events'")
    assert started.first()["value"] == len(rows[0])
    twice = str(tmp_path / "twice" / "day_03.parquet")
    both = plain.unionByName(plain).coalesce(1)
    both.write.parquet(str(tmp_path / "two"))
    os.makedirs(os.path.dirname(twice))
    os.rename(glob.glob(str(tmp_path / "two/*.parquet"))[0], twice)
    with pytest.raises(ValueError):
        run_tokens(spark, [twice], str(tmp_path / "v"), str(tmp_path / "s"), "val", config, ranges=RANGES)


def test_stale_sequences_do_not_pass_for_missing_ones(spark, built, tmp_path):
    _, paths, _ = built
    out, words = str(tmp_path / "sequences"), str(tmp_path / "v")
    config = TokenConfig(min_freq=1, max_len=8, chunk_size=20)
    run_tokens(spark, paths["sessions"], words, out, "all", config, ranges=RANGES)
    whole = sorted(map(str, read_sequences(spark, out).collect()))
    chunk = read_sequences(spark, out).where("chunk = 1")
    first = F.lit(chunk.agg(F.min("session_id")).first()[0])
    renamed = F.when(F.col("session_id") == first, F.lit("gone")).otherwise(F.col("session_id"))
    changed = materialize(chunk.withColumn("session_id", renamed))
    write_chunks(changed, out, config, "all", [c for c in stored_chunks(spark, out, "all") if c != 1])
    assert read_sequences(spark, out).count() == len(whole)
    again = run_tokens(spark, paths["sessions"], words, out, "all", config, resume=True, ranges=RANGES)
    assert not again.skipped
    assert sorted(map(str, read_sequences(spark, out).collect())) == whole
    chunks = spark.read.parquet(f"{out}_chunks").agg(F.count("*"), F.sum("sessions")).first()
    report = spark.read.parquet(f"{out}_manifest").first()
    assert tuple(chunks) == (report["chunk_count"], report["session_count"])


def test_merged_templates_keep_their_ids_over_runs(spark, tmp_path):
    config = SessionConfig(window_mins=120, stride_mins=60, merge_similar=True, similarity=0.3)
    out = [str(tmp_path / name) for name in ("sessions", "templates")]
    for day in (1, 2, 3):
        (tmp_path / f"{day}.txt").write_text("\n".join(log_lines((day,), seed=day)) + "\n")
    first = run_sessions(spark, [str(tmp_path / "1.txt")], *out, 1, 1, config)
    before = {r["signature"]: r["template_id"] for r in first.templates.collect()}
    assert len(set(before.values())) == 1 < len(before)
    assert {r["template"] for r in first.templates.collect()} == {
        "<*> <*> <*> <*> <*> <*> auth_orientation=LogOn <*>"
    }
    second = run_sessions(
        spark, [str(tmp_path / f"{day}.txt") for day in (2, 3)], *out, 2, 3, config
    )
    after = {r["signature"]: r["template_id"] for r in second.templates.collect()}
    assert before.items() <= after.items() and len(after) > len(before)
    events = second.sessions.select(F.explode("events.event_id").alias("id")).distinct()
    assert {r["id"] for r in events.collect()} == {"1"}
    # The first day again: nothing moves.
    run_sessions(spark, [str(tmp_path / "1.txt")], *out, 1, 1, config)
    stored = spark.read.parquet(out[1])
    assert {r["signature"]: r["template_id"] for r in stored.collect()} == after


def test_colliding_ids_are_counted(spark, tmp_path):
    lines = [f"{i},U{i}@D,U{i}@D,C{i % 2},C9,NTLM,Batch,LogOn,Success" for i in range(40)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    config = SessionConfig(id_hex_chars=1, min_events=1)
    out = [str(tmp_path / name) for name in ("s", "t")]
    result = run_sessions(spark, [str(tmp_path / "a.txt")], *out, 1, 1, config)
    names = {}
    for kind, count in (("user_id", 40), ("host_id", 2)):
        for i in range(count):
            name = f"U{i}@D" if kind == "user_id" else f"C{i}"
            names.setdefault((kind, hashlib.sha256(name.encode()).hexdigest()[0]), set()).add(name)
    want = {key: len(own) for key, own in names.items() if len(own) > 1}
    found = spark.read.parquet(f"{out[1]}_collisions")
    assert {(r["kind"], r["id"]): r["names"] for r in found.collect()} == want
    assert result.counters["colliding_ids"] == len(want) > 10
    assert found.columns == ["kind", "id", "names"]
