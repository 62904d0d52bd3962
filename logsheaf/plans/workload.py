"""The registered queries: each runs operators over the given tables.

``events`` stands in for an authentication log (``auth_events``), with users,
computers and types derived from its columns. It spans 30 days with few events
per user and day, so the queries use windows of 24 hours every 12 hours and
splits of its 30 days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf.config import TRAINING_SPLIT_DAYS, SessionConfig, TokenConfig
from logsheaf.functions.identity import host_check, host_key, user_check, user_key
from logsheaf.functions.masking import with_masked
from logsheaf.functions.tokens import session_tokens
from logsheaf.functions.wire import decode_json, encode_json
from logsheaf.operators import scoring
from logsheaf.operators.chunks import (
    assign_chunks,
    chunk_report,
    chunks_per_file,
    is_complete,
    manifest,
    numbered_chunks,
    pending,
    sound_chunks,
    valid_days,
)
from logsheaf.operators.encoding import (
    decode,
    encode_events,
    encode_sessions,
    padded,
    tokenize,
    unknown_rate,
)
from logsheaf.operators.parse import (
    day_index,
    in_days,
    is_success,
    parse_auth_lines,
    parse_counters,
)
from logsheaf.operators.merging import extend_merged, merge_similar, resolved
from logsheaf.operators.quality import (
    coerce_events,
    id_collisions,
    malformed_counters,
    quality_of_days,
    rows_per_day,
    session_summary,
    token_quality,
    token_sketches,
)
from logsheaf.operators.sessions import build_sessions, prepare_events, session_windows
from logsheaf.operators.splits import in_split, missing_days
from logsheaf.operators.templates import (
    assign_template_ids,
    auth_message,
    enrich,
    mine_signatures,
    mine_templates,
    template_count,
    template_params,
    with_auth_signature,
    with_signature,
)
from logsheaf.operators.vocabulary import (
    rank_tokens,
    special_ids,
    token_counts,
    vocabulary_stats,
)
from logsheaf.plans.sessions import extend_templates, read_aliases, sessions_of, stage_events
from logsheaf.session import discard, file_system, materialize, scratch_path, table_exists
from logsheaf.sources import versions
from logsheaf.sources.kafka import parted_values
from logsheaf.sources.logs import read_log_lines
from logsheaf.sources.records import fold_risk_states, read_risk_states
from logsheaf.sources.sequences import read_sequences, write_chunks, write_single
from logsheaf.sources.sessions import (
    read_session_shards,
    read_sessions,
    shard_counts,
    write_sessions,
)
from logsheaf.sources.vocabulary import (
    export_vocabulary_json,
    read_vocabulary,
    read_vocabulary_json,
    write_vocabulary,
)
from logsheaf.streaming.ingest import clean

WINDOWS = SessionConfig(window_mins=1440, stride_mins=720)
GAPS = SessionConfig(window_mins=120, stride_mins=180, min_events=1)
SOME_HOT = SessionConfig(window_mins=1440, stride_mins=720, max_tokens=4, hot_group_rows=4)
LAST_FOUR = SessionConfig(window_mins=1440, stride_mins=720, max_tokens=4)
TOKENS = TokenConfig(max_len=12)
SPLITS = {"train": (1, 20), "val": (21, 25), "test": (26, 30), "late": (26, 35), "all": (1, 30)}
START_DAY, END_DAY = 3, 20
CHUNK, SMALL_CHUNK = 100, 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as authentication events; ``line_no`` is their order."""
    k = F.col("k")
    origin = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - origin
    events = _table(spark, sf_dir, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        F.col("event_id").alias("line_no"),
        F.floor(micros / 1_000_000).alias("time"),
        F.concat(F.lit("U"), F.col("user_id")).alias("src_user"),
        F.concat(F.lit("U"), k).alias("dst_user"),
        F.concat(F.lit("C"), k % 2).alias("src_computer"),
        F.concat(F.lit("C"), k).alias("dst_computer"),
        F.col("event_type").alias("auth_type"),
        F.concat(F.lit("Type"), k).alias("logon_type"),
        F.when(F.col("value") < 50, "LogOn").otherwise("LogOff").alias("auth_orientation"),
        F.when(F.col("event_type") == "error", "Fail").otherwise("Success").alias("success"),
        "value",
    )


def _messages(spark: SparkSession, sf_dir: str, *keep_digits: str) -> DataFrame:
    events = auth_events(spark, sf_dir)
    return with_auth_signature(events, keep_digit_tokens=keep_digits).select(
        "line_no", "time", "signature"
    )


def _templates(messages: DataFrame) -> DataFrame:
    return assign_template_ids(mine_signatures(messages))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_events(auth_events(spark, sf_dir).drop("value"), WINDOWS, ["line_no"])


_STORED: dict[tuple[str, ...], DataFrame] = {}


def _stored(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A job's stored output, built by the first query that reads it."""
    key = (spark.sparkContext.applicationId, *key)
    table = _STORED.get(key)
    if table is None or not all(table_exists(spark, f) for f in table.inputFiles()[:1]):
        table = _STORED[key] = build()
    return table


def _build_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose event ids are template ids, as the sessions job makes them."""
    events = auth_events(spark, sf_dir).withColumns(
        {
            "day": day_index(F.col("time")),
            "is_success": is_success(F.col("success")),
            "line_ord": F.col("line_no"),
        }
    )
    staged = stage_events(events, WINDOWS)
    sessions = materialize(sessions_of(staged, _templates(staged), WINDOWS), "day")
    discard(staged)
    return sessions


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, ("sessions", sf_dir), lambda: _build_sessions(spark, sf_dir))


def _vocabulary(sessions: DataFrame, sf_dir: str) -> DataFrame:
    """The stored vocabulary of the train days."""

    def build() -> DataFrame:
        train = in_split(sessions, "train", SPLITS)
        return materialize(rank_tokens(token_counts(train), TOKENS))

    return _stored(sessions.sparkSession, ("vocabulary", sf_dir), build)


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sessions = _sessions(spark, sf_dir)
    vocabulary = _vocabulary(sessions, sf_dir)
    return tokenize(sessions, vocabulary, TOKENS), vocabulary


def _joined(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), ",")


# --- lines, events, identities ---------------------------------------------


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a text line, in shapes that depend on its value."""
    fields = [
        "src_user", "dst_user", "src_computer", "dst_computer", "auth_type", "logon_type",
        "auth_orientation",
    ]
    short = ["src_user", "src_computer", "dst_computer", "auth_type", "logon_type"]
    text = F.when(F.col("value") < 1, F.lit(" \t "))
    text = text.when(F.col("value") < 2, F.concat_ws(",", "time", *fields))
    text = text.when(
        F.col("value") < 3, F.concat_ws(",", F.concat(F.lit("t"), "time"), *fields, "success")
    )
    text = text.when(F.col("value") < 20, F.concat_ws(",", "time", *short, "success"))
    text = text.otherwise(
        F.concat(F.lit(" "), F.concat_ws(",", "time", *fields, "success"), F.lit(" \t"))
    )
    return auth_events(spark, sf_dir).select("line_no", text.alias("value"))


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_auth_lines(_raw_lines(spark, sf_dir))


def line_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_counters(_raw_lines(spark, sf_dir), START_DAY, END_DAY)


def events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_auth_lines(_raw_lines(spark, sf_dir))
    return rows_per_day(in_days(parsed, START_DAY, END_DAY), "events")


def pseudonymised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("event.*", "order.line_no", "day", "user_id", "host_id")


def identity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that are null, empty, blank or padded, by event type."""
    kind, name = F.col("event_type"), F.concat(F.lit("U"), F.col("user_id"))
    raw = _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", name).when(kind == "error", "").when(kind == "signup", " \t ").alias("user"),
        F.when(kind == "error", F.concat(F.lit(" "), name, F.lit("\n"))).alias("src_user"),
        F.when(kind == "view", name).alias("username"),
        F.when(kind == "view", F.col("user_id")).alias("source_host"),
        F.when(kind == "click", "").alias("src_host"),
    )
    return raw.select(
        "event_id", user_key(raw.schema).alias("user_id"), host_key(raw.schema).alias("host_id")
    )


# --- sessions ---------------------------------------------------------------


def sessions_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions job from events to sessions, built anew."""
    return _build_sessions(spark, sf_dir).select(
        "session_id", "day", "start_ts", _joined(F.col("events.event_id")).alias("event_ids")
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session bounds and event counts per day, user and host."""
    return session_windows(_prepared(spark, sf_dir), WINDOWS)


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four events of each session, in order."""
    return _last_events(spark, sf_dir, LAST_FOUR)


def _last_events(spark: SparkSession, sf_dir: str, config: SessionConfig) -> DataFrame:
    events = auth_events(spark, sf_dir).withColumn("event_id", F.col("line_no").cast("string"))
    prepared = prepare_events(events.drop("value"), config, ["line_no"])
    return build_sessions(prepared, config).select(
        "session_id",
        "day",
        "user_id",
        "host_id",
        "start_ts",
        "end_ts",
        _joined(F.col("events.event_id")).alias("event_ids"),
        _joined(F.col("events.time")).alias("times"),
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_summary(_sessions(spark, sf_dir))


def sessions_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_per_day(_sessions(spark, sf_dir), "sessions")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_quality(_sessions(spark, sf_dir))


def windows_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stride beyond the window size leaves events outside all windows."""
    return session_windows(_prepared(spark, sf_dir), GAPS)


def hot_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``last_events`` with every group of four or more events taken as large."""
    return _last_events(spark, sf_dir, SOME_HOT)


def split_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and days of each split."""
    per_day = rows_per_day(_sessions(spark, sf_dir), "n")
    names = ("train", "val", "test", "all")
    inside = {name: F.col("day").between(*SPLITS[name]) for name in names}
    totals = per_day.agg(
        *(F.coalesce(F.sum(F.when(inside[n], F.col("n"))), F.lit(0)).alias(f"{n}_sessions") for n in names),
        *(F.count_if(inside[n]).alias(f"{n}_days") for n in names),
    )
    rows = [
        F.struct(
            F.lit(n).alias("split"),
            F.col(f"{n}_sessions").alias("sessions"),
            F.col(f"{n}_days").alias("days"),
        )
        for n in names
    ]
    return totals.select(F.inline(F.array(*rows)))


def stored_lines_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day of the lines after writing them to text files and reading those."""
    path = scratch_path(spark)
    _raw_lines(spark, sf_dir).select("value").write.text(path)
    return rows_per_day(parse_auth_lines(read_log_lines(spark, path)), "events")


def rerun_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sessions after days 5 to 9 were run again, with only long sessions left."""
    path, sessions = scratch_path(spark), _sessions(spark, sf_dir)
    write_sessions(sessions, path)
    again = sessions.where(F.col("day").between(5, 9) & (F.size("events") >= 9))
    write_sessions(again, path, range(5, 10))
    return read_sessions(spark, path).select(
        "day", "session_id", F.size("events").cast("long").alias("n_events")
    )


def counts_beside_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts where each session has null events among the others."""
    sessions = _sessions(spark, sf_dir)
    null = F.array(F.lit(None).cast(sessions.schema["events"].dataType.elementType))
    return token_counts(sessions.withColumn("events", F.concat(null, "events", null)))


def coerced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text of many forms, and event ids to fill, by event type."""
    kind, text = F.col("event_type"), F.col("event_id").cast("string")
    raw = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row"),
        F.concat(F.lit("U"), F.col("user_id")).alias("username"),
        F.when(kind == "click", F.concat(F.lit(" +"), text, F.lit("\t")))
        .when(kind == "error", F.concat(text, F.lit(".5")))
        .when(kind == "view", F.concat(F.lit("1_0"), text))
        .alias("time"),
        F.when(kind == "signup", text).when(kind == "error", F.lit("late")).alias("timestamp"),
        F.when(kind == "click", "").when(kind == "view", text).alias("event_id"),
        F.when(F.col("value") < 50, F.col("user_id").cast("int")).alias("template_id"),
    )
    return prepare_events(raw, WINDOWS).select("event.row", "event.time", "event.event_id", "user_id")


EVENT_K = T.StructType([T.StructField("k", T.LongType())])


def _untyped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON event lists, sound and malformed, by event type."""
    kind, props = F.col("event_type"), F.col("props")
    text = (
        F.when(kind == "click", F.concat(F.lit("["), props, F.lit(', "text", 3, null]')))
        .when(kind == "error", F.concat(F.lit('"'), kind, F.lit('"')))
        .when(kind == "signup", F.lit("[]"))
        .when(kind == "view", F.concat(F.lit("["), props, F.lit(","), props, F.lit("]")))
    )
    return _table(spark, sf_dir, "events").select("event_id", text.alias("events"))


def coerced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_events(_untyped_sessions(spark, sf_dir), EVENT_K).select(
        "event_id",
        _joined(F.col("events.k")).alias("ks"),
        "invalid_event_containers",
        "dropped_events",
    )


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed_counters(coerce_events(_untyped_sessions(spark, sf_dir), EVENT_K))


# --- templates --------------------------------------------------------------


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_masked(documents, F.col("text")).drop("text")


def template_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of events without target user and with some null types."""
    events = auth_events(spark, sf_dir).drop("dst_user")
    some = events.withColumn("auth_type", F.nullif(F.col("auth_type"), F.lit("view")))
    return some.select("line_no", auth_message(some.columns).alias("message"))


def template_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_signatures(with_auth_signature(auth_events(spark, sf_dir)))


def template_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(_messages(spark, sf_dir, "logon_type"))


def template_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the first day's events, then extended by all events."""
    messages = materialize(_messages(spark, sf_dir, "logon_type").drop("line_no"))
    known = materialize(mine_templates(messages.where(F.col("time") < 86_400)))
    return mine_templates(messages, known)


def template_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events against the first day's templates; new ones read -1, UNK."""
    messages = _messages(spark, sf_dir, "logon_type")
    known = materialize(mine_templates(messages.where(F.col("time") < 86_400)))
    return enrich(messages, known).select("line_no", "template_id", "event_id")


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = auth_events(spark, sf_dir)
    marked = with_auth_signature(events.withColumn("message", auth_message(events.columns)))
    return marked.select(
        "line_no", _joined(template_params(F.col("message"), F.col("signature"))).alias("params")
    )


def templates_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_count(_templates(_messages(spark, sf_dir, "logon_type")))


def template_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar signatures merged, on messages in the seven-column form."""
    events = auth_events(spark, sf_dir).drop("dst_user", "auth_orientation")
    return merge_similar(
        mine_signatures(with_auth_signature(events, keep_digit_tokens=["logon_type"]))
    )


def _seven_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = auth_events(spark, sf_dir).drop("dst_user", "auth_orientation")
    return with_auth_signature(events, keep_digit_tokens=["logon_type"]).select("time", "signature")


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged templates of the first day, stored, then extended by all days.

    Beside each signature's stored id stand the present id and text of its cluster.
    """
    path, config = scratch_path(spark), SessionConfig(merge_similar=True)
    messages = materialize(_seven_columns(spark, sf_dir))
    extend_templates(mine_signatures(messages.where(F.col("time") < 86_400)), path, config)
    stored = extend_templates(mine_signatures(messages), path, config)
    present = resolved(stored, read_aliases(spark, path))
    return stored.select("signature", F.col("template_id").alias("stored_id")).join(
        present.select("signature", "template_id", "template"), "signature"
    )


def wide_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging of messages that begin with more names than a node of the tree has children."""
    named = F.translate(F.col("src_user"), "0123456789", "abcdefghij")
    kind = F.concat_ws("-", "auth_type", F.translate("src_computer", "01", "ab"))
    message = F.concat_ws(" ", named, kind, "auth_orientation")
    events = materialize(auth_events(spark, sf_dir).select("time", message.alias("message")))
    signatures = mine_signatures(with_signature(events, F.col("message")))
    return merge_similar(signatures, similarity=0.6)


# --- vocabulary and tokens --------------------------------------------------


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_sessions(spark, sf_dir))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(_sessions(spark, sf_dir), sf_dir)


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 ids of the vocabulary over all days."""
    return rank_tokens(token_counts(_sessions(spark, sf_dir)), TOKENS, size=50)


def vocabulary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_stats(_vocabulary(_sessions(spark, sf_dir), sf_dir))


def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    return sessions.select(F.explode(session_tokens(sessions.schema)).alias("token")).distinct()


def encoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    return encode_events(sessions, _vocabulary(sessions, sf_dir))


def encoded_events_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encoded_events`` by the join for vocabularies too large to broadcast."""
    sessions = _sessions(spark, sf_dir)
    return encode_events(sessions, _vocabulary(sessions, sf_dir), max_bytes=0)


def rate_of_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    return unknown_rate(encode_sessions(sessions, _vocabulary(sessions, sf_dir)))


def split_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation days under the vocabulary of the train days."""
    sessions = _sessions(spark, sf_dir)
    encoded = encode_sessions(in_split(sessions, "val", SPLITS), _vocabulary(sessions, sf_dir))
    return encoded.groupBy("day").agg(
        F.count("*").alias("sessions"),
        F.sum("n_events").alias("n_events"),
        F.sum("n_unknown").alias("n_unknown"),
    )


def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir)[0].select(
        "day", "session_id", _joined(F.col("input_ids")).alias("input_ids"), "n_events", "n_unknown"
    )


def attention_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir)[0].select(
        "session_id", _joined(F.col("attention_mask")).alias("attention_mask")
    )


def decoded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences, words = _sequences(spark, sf_dir)
    return decode(sequences, words).select("session_id", F.array_join("tokens", " ").alias("tokens"))


def chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(n) for n in ("day", "user_id", "host_id", "start_ts")]
    keys = _sessions(spark, sf_dir).select("session_id", *order)
    return assign_chunks(keys, CHUNK, *order).select("session_id", "chunk")


def _stored_sequences(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """All sequences, written in numbered chunks and read back."""
    path, sessions = scratch_path(spark), _sessions(spark, sf_dir)
    chunks = materialize(numbered_chunks(sessions, size))
    n_chunks = chunks.select("chunk").distinct().count()
    per_file = chunks_per_file(n_chunks, size)
    sequences = padded(sessions, _vocabulary(sessions, sf_dir), chunks, n_chunks, TOKENS, per_file)
    write_chunks(sequences, path, TOKENS, per_file=per_file)
    return read_sequences(spark, path)


def sequence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_stored_sequences(spark, sf_dir), TOKENS)


def sequence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stored chunk holds."""
    return chunk_report(_stored_sequences(spark, sf_dir), TOKENS.max_len)


def resumable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that still hold their sessions when those of day 7 are gone and day 20 lost a mask."""
    sessions, stored = _sessions(spark, sf_dir), _stored_sequences(spark, sf_dir, SMALL_CHUNK)
    mask = F.when(F.col("day") != 20, F.col("attention_mask"))
    expected = numbered_chunks(sessions.where(F.col("day") != 7), SMALL_CHUNK)
    return sound_chunks(expected, stored.withColumn("attention_mask", mask), TOKENS.max_len)


def sound_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose sequences are all sound, where those of day 7 lost a mask."""
    sequences = _sequences(spark, sf_dir)[0]
    mask = F.when(F.col("day") != 7, F.col("attention_mask"))
    return valid_days(sequences.withColumn("attention_mask", mask), TOKENS.max_len)


def single_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences per day of a single artifact, written and read back."""
    path = scratch_path(spark)
    write_single(_sequences(spark, sf_dir)[0], path, TOKENS)
    return rows_per_day(read_sequences(spark, path), "sequences")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored sequences cover all sessions, and whether they would cover one more."""
    report = materialize(manifest(_stored_sequences(spark, sf_dir), TOKENS))
    total = _sessions(spark, sf_dir).count()
    rows = [(more, is_complete(report, total + more)) for more in (0, 1)]
    return spark.createDataFrame(rows, "more int, complete boolean")


def session_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per day from single files named by day, stored without ids."""
    sessions, path = _sessions(spark, sf_dir), scratch_path(spark)
    shards = []
    for day in (4, 11, 30):
        folder, shard = f"{path}/{day}", f"{path}/day_{day:02}.parquet"
        sessions.where(F.col("day") == day).drop("day", "session_id").coalesce(1).write.parquet(folder)
        part = next(name for name in versions.listed(spark, folder) if name.endswith(".parquet"))
        files, source = file_system(spark, f"{folder}/{part}")
        files.rename(source, file_system(spark, shard)[1])
        shards.append(shard)
    stored = read_session_shards(spark, *shards)
    ids = stored.groupBy("day").agg(F.max("session_id").alias("last_id"))
    return shard_counts(stored).join(ids, "day")


def stored_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after storing it as a table and as JSON lines, and reading both."""
    words, path = _vocabulary(_sessions(spark, sf_dir), sf_dir), scratch_path(spark)
    write_vocabulary(words, f"{path}/table")
    export_vocabulary_json(words, f"{path}/json")
    back = read_vocabulary_json(spark, f"{path}/json").withColumnRenamed("token_id", "json_id")
    return read_vocabulary(spark, f"{path}/table").join(back, "token", "full")


def damaged_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check finds in a vocabulary without one special, with ids and tokens twice."""
    words = _vocabulary(_sessions(spark, sf_dir), sf_dir)
    token, number = F.col("token"), F.col("token_id")
    more = words.where(number.between(5, 7)).select(F.concat(token, F.lit("+")).alias("token"), "token_id")
    again = words.where(number == 6).select("token", (number + 100_000).cast("int").alias("token_id"))
    return vocabulary_stats(words.where(token != "[MASK]").unionByName(more).unionByName(again))


def placeholder_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token quality of sessions whose event ids are placeholders of every form but for purchases."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", "NA").when(kind == "error", " UNK ").when(kind == "signup", "")
        .when(kind == "purchase", F.col("user_id").cast("string"))
    )
    event = F.struct(name.alias("event_id"), kind.alias("auth_type"), F.lit("t").alias("logon_type"))
    events = _table(spark, sf_dir, "events")
    return token_quality(events.groupBy("event_id").agg(F.collect_list(event).alias("events")))


def training_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the splits that the training settings declare."""
    sessions, found = _sessions(spark, sf_dir), None
    for split in TRAINING_SPLIT_DAYS:
        rows = in_split(sessions, split, TRAINING_SPLIT_DAYS).agg(F.count("*").alias("sessions"))
        rows = rows.select(F.lit(split).alias("split"), "sessions")
        found = rows if found is None else found.unionByName(rows)
    return found


def absent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_days(_sessions(spark, sf_dir), "late", SPLITS)


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions still to encode when the train days are done."""
    sessions = _sessions(spark, sf_dir)
    done = in_split(sessions, "train", SPLITS)
    return pending(sessions, done).select("day", "session_id")


def masked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences, words = _sequences(spark, sf_dir)
    return scoring.masked_examples(
        sequences, special_ids(words), words.count()
    ).select(
        "session_id",
        _joined(F.col("masked_ids")).alias("masked_ids"),
        _joined(F.col("labels")).alias("labels"),
    )


# --- ingest -----------------------------------------------------------------


def raw_messages(conversations: DataFrame) -> DataFrame:
    """Each turn as a message, beside blank, probe and near-probe messages."""
    text = F.col("text")
    variants = F.array(
        text,
        F.lit(" \t "),
        F.lit(None).cast("string"),
        F.lit("GET /health"),
        F.lit("GET /healthz"),
        F.concat(F.lit("POST /metrics\n"), text),
        F.concat(text, F.lit("\n\n"), text),
    )
    return conversations.select(
        "conv_id",
        "turn",
        F.posexplode(variants).alias("variant", "message"),
        F.lit("h").alias("host"),
        F.lit("a").alias("agent"),
        F.lit("e").alias("ecs"),
        F.lit("i").alias("input"),
        F.lit("t").alias("tags"),
    )


def ingest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean(raw_messages(_table(spark, sf_dir, "conversations")))
    return cleaned.select("conv_id", "turn", "variant", "event.original", "event.dataset")


def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned events through their JSON form and back."""
    cleaned = clean(raw_messages(_table(spark, sf_dir, "conversations")))
    wire = encode_json(cleaned)
    return wire.select(decode_json(F.col("value"), cleaned.schema).alias("e")).select(
        "e.conv_id", "e.turn", "e.variant", "e.event.original", "e.event.dataset"
    )


def ingest_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values, fit and unfit by event type, as events and as refused texts."""
    kind, props = F.col("event_type"), F.col("props")
    text = (
        F.when(kind == "click", F.concat(props, F.lit(" ")))
        .when(kind == "error", F.substring(props, 1, 4))
        .when(kind == "signup", F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == "view", F.concat(F.lit('{"k": "k'), "event_id", F.lit('"}')))
    )
    records = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("offset"), text.alias("value")
    )
    events, refused = parted_values(records, EVENT_K)
    accepted = events.groupBy("k").agg(F.count("*").alias("n"))
    return accepted.select("k", "n", F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("offset")).unionByName(
        refused.select(F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("n"), "value", "offset")
    )


# --- scores -----------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two error scores in [0, 1] per event and their combination."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return _table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("U"), F.col("user_id")).alias("entity"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("time"),
        F.when(kind == "error", "T1486")
        .when(kind == "purchase", "T1003")
        .when(kind == "signup", "T1053")
        .when(kind == "click", "T1018")
        .otherwise("T0000")
        .alias("technique_id"),
        scoring.anomaly_score(F.least(F.col("value") / 50, F.lit(1.0)), k / 100).alias("score"),
    )


def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("score")
    return _scored(spark, sf_dir).select(
        "event_id",
        F.round("score", 6).alias("score"),
        scoring.is_anomaly(score).alias("is_anomaly"),
        scoring.severity(score).alias("severity"),
    )


def _risk(scored: DataFrame) -> DataFrame:
    return scoring.risk_profiles(scored, "entity", "user", "time", "score", ["event_id"])


def risk_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(_scored(spark, sf_dir)).select(
        "entity_id",
        "entity_type",
        F.round("risk_score", 6).alias("risk_score"),
        "anomaly_count",
        F.unix_seconds("last_seen").alias("last_seen"),
    )


def alert_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    alerts = scoring.with_alert_severity(
        scored, materialize(_risk(scored)), "entity", "score", "technique_id"
    )
    return alerts.select("event_id", F.round("alert_severity", 6).alias("alert_severity"))


def alert_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.alert_levels(_scored(spark, sf_dir), "score").select("event_id", "level")


def risk_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk from three runs, by time, folded into one stored table; the second is repeated."""
    scored, path = _scored(spark, sf_dir), scratch_path(spark)
    day = F.floor((F.col("time") - F.lit(1_704_067_200)) / 86_400)
    runs = {"a": day < 7, "b": (day >= 7) & (day < 20), "c": day >= 20}
    for run in "abbc":
        states = scoring.risk_states(scored.where(runs[run]), "entity", "time", "score", ["event_id"])
        fold_risk_states(states, path, run)
    return scoring.profiles_of(read_risk_states(spark, path), "user").select(
        "entity_id",
        "entity_type",
        F.round("risk_score", 6).alias("risk_score"),
        "anomaly_count",
        F.unix_seconds("last_seen").alias("last_seen"),
    )


def percentiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of all scores from sketches per day and the days that reach the tail."""
    day = day_index(F.col("time") - F.lit(1_704_067_200))
    scored = materialize(_scored(spark, sf_dir).select("score", day.alias("day")), "day")
    sketches = materialize(scoring.score_sketches(scored, "score"))
    found = scoring.percentiles_of_days(scored, sketches, "score")
    rows = sorted((name, round(value, 6)) for name, value in found.items())
    return sketches.agg(F.sum("n").alias("scores")).select(
        "scores", F.inline(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(v).alias("bound")) for n, v in rows]))
    )


def quality_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token quality of each split from sketches per day, and whether it is near the exact count."""
    sessions = _sessions(spark, sf_dir)
    sketches, found = materialize(token_sketches(sessions)), None
    for split in ("train", "val", "test", "all"):
        exact = token_quality(in_split(sessions, split, SPLITS)).select(
            F.lit(split).alias("split"), F.col("distinct_tokens").alias("exact")
        )
        estimate = quality_of_days(in_split(sketches, split, SPLITS)).withColumn("split", F.lit(split))
        rows = estimate.join(exact, "split").select(
            "split",
            "total_events",
            "missing_event_ids",
            (F.abs(F.col("distinct_tokens") - F.col("exact")) <= 0.02 * F.col("exact")).alias("near"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms of one hex character that stand for several users or computers."""
    events = auth_events(spark, sf_dir)
    schema = events.schema
    keyed = events.select(
        user_key(schema, 1).alias("user_id"), host_key(schema, 1).alias("host_id"),
        user_check(schema).alias("user_check"), host_check(schema).alias("host_check"),
    )
    return id_collisions(keyed, {"user_id": "user_check", "host_id": "host_check"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_auth_lines": parsed_lines,
    "parse_counters": line_counters,
    "events_per_day": events_per_day,
    "pseudonymised_events": pseudonymised_events,
    "identity_fallback": identity_fallback,
    "session_windows": windows,
    "sessions_job": sessions_job,
    "session_windows_gaps": windows_with_gaps,
    "session_events_last_n": last_events,
    "session_events_hot": hot_last_events,
    "split_sessions": split_sessions,
    "stored_lines_per_day": stored_lines_per_day,
    "session_day_rerun": rerun_days,
    "coerced_events": coerced_events,
    "session_summary": summary,
    "sessions_per_day": sessions_per_day,
    "token_quality": quality,
    "coerced_sessions": coerced_sessions,
    "malformed_counters": malformed,
    "masked_documents": masked_documents,
    "template_messages": template_messages,
    "template_signatures": template_signatures,
    "template_ids": template_ids,
    "template_reuse": template_reuse,
    "template_enriched": template_enriched,
    "template_params": params,
    "template_count": templates_total,
    "template_drain": template_drain,
    "template_merged_runs": merged_runs,
    "template_wide_tree": wide_tree,
    "token_counts": counts,
    "token_counts_null_events": counts_beside_nulls,
    "vocabulary": vocabulary,
    "top_tokens": top_tokens,
    "vocabulary_check": vocabulary_check,
    "distinct_tokens": distinct_tokens,
    "encoded_events": encoded_events,
    "encoded_events_salted": encoded_events_salted,
    "unknown_rate": rate_of_unknown,
    "split_reuse": split_reuse,
    "token_sequences": token_sequences,
    "attention_masks": attention_masks,
    "decoded_sequences": decoded_sequences,
    "chunk_assignment": chunk_assignment,
    "sequence_manifest": sequence_manifest,
    "sequence_chunks": sequence_chunks,
    "resumable_chunks": resumable_chunks,
    "single_sequences": single_sequences,
    "sequence_completeness": completeness,
    "session_shards": session_shards,
    "stored_vocabulary": stored_vocabulary,
    "vocabulary_check_damaged": damaged_vocabulary,
    "token_quality_placeholders": placeholder_quality,
    "training_splits": training_splits,
    "sound_days": sound_days,
    "missing_days": absent_days,
    "resume_antijoin": resume_antijoin,
    "masked_examples": masked_examples,
    "ingest_clean": ingest_clean,
    "ingest_json": ingest_json,
    "ingest_refused": ingest_refused,
    "severity_bands": severity_bands,
    "risk_ewma": risk_ewma,
    "alert_severity": alert_severities,
    "alert_percentiles": alert_percentiles,
    "risk_over_runs": risk_over_runs,
    "percentiles_by_day": percentiles_by_day,
    "token_quality_by_day": quality_by_day,
    "id_collisions": collisions,
}
