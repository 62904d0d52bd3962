"""Chat formatting with typed content parts, a loss mask and a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, JOINT, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"

# A control string is an opening bracket and a tail. Escaping adds one backslash
# between the two, whatever number is there, so it can be undone exactly.
_ESCAPE = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_UNESCAPE = r"([<\[])(\\*)\\(\||/?s>|/?INST\])"

IMAGE_PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 512

PART = (
    "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
)


def escaped(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def text_parts(text: Column) -> Column:
    """Content of one text part; a null text is an empty one."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"))
    return F.transform(
        F.array(part),
        lambda p: F.struct(
            p["type"].alias("type"),
            p["text"].alias("text"),
            F.lit(None).cast("string").alias("uri"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        ),
    )


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 1 at least where its size is unknown."""

    def patches(side: str) -> Column:
        return F.ceil(F.coalesce(part[side], F.lit(1)) / IMAGE_PATCH)

    def scaled(size: str, each: int) -> Column:
        return F.ceil(F.coalesce(part[size], F.lit(0)) * each)

    tokens = (
        F.when(part["type"] == "image", patches("width") * patches("height"))
        .when(part["type"] == "audio", scaled("seconds", AUDIO_TOKENS_PER_SECOND))
        .otherwise(scaled("pages", DOCUMENT_TOKENS_PER_PAGE))
    )
    return F.greatest(tokens.cast("long"), F.lit(1).cast("long"))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _segments(role: Column, parts: Column) -> Column:
    """A turn as segments (text, loss): header, one per part, end."""
    learned, none = F.coalesce(role == "assistant", F.lit(False)), F.lit(False)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def visit(part: Column, place: Column) -> Column:
        placeholder = F.concat(F.lit("<|"), part["type"], F.lit("|>"))
        text = F.when(_is_attachment(part), placeholder).otherwise(
            escaped(F.coalesce(part["text"], F.lit("")))
        )
        own = segment(text, learned & ~_is_attachment(part))
        # Between texts stands a mark, or two of them could make up a control string.
        follows = (place > 0) & ~_is_attachment(part) & ~_is_attachment(F.get(parts, place - 1))
        return F.when(follows, F.array(segment(F.lit(JOINT), none), own)).otherwise(F.array(own))

    header = F.concat(F.lit(TURN), escaped(F.coalesce(role, F.lit(""))), F.lit(TEXT))
    return F.concat(
        F.array(segment(header, none)),
        F.flatten(F.transform(parts, visit)),
        F.array(segment(F.lit(END), none)),
    )


def format_chat(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, formatted, loss_spans, attachments, n_attached).

    ``parts`` is an array of ``PART``. A visitor writes text parts escaped and
    the other types as ``<|type|>``, with a mark between adjacent texts. The n-th placeholder belongs to the n-th
    of ``attachments`` (type, uri, tokens); ``n_attached`` is the sum of their
    tokens. ``loss_spans`` are the code points (start, end) of the
    assistant's text parts.

    Turns are ordered by number, null first, then by role and content; repeated
    rows are repeated turns. Rows without a conversation form one
    conversation of id null. Null parts are none, a null role or text is
    empty, and a part of unknown type counts as text. An empty table gives
    no rows. Other columns are ignored.
    """
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    attached = F.transform(
        F.filter(content, _is_attachment),
        lambda p: F.struct(
            p["type"].alias("type"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens")
        ),
    )
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            _segments(F.col(role), content).alias("segments"),
            attached.alias("attached"),
        ).alias("turn"),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(state: Column, segment: Column) -> Column:
        end = state["at"] + F.length(segment["text"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        spans = F.when(segment["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .withColumn("segments", F.flatten(F.transform("turns", lambda t: t["segments"])))
        .withColumn("attachments", F.flatten(F.transform("turns", lambda t: t["attached"])))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.aggregate("segments", start, step, lambda s: s["spans"]).alias("loss_spans"),
            "attachments",
            F.aggregate(
                "attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]
            ).alias("n_attached"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns [(role, text)] of a formatted conversation, unescaped, the parts of a text joined."""

    def parse(turn: Column) -> Column:
        role = F.substring_index(turn, TEXT, 1)
        body = F.substring(
            turn,
            F.length(role) + len(TEXT) + 1,
            F.length(turn) - F.length(role) - len(TEXT) - len(END),
        )
        texts = F.transform(F.split(body, r"<\|part\|>", -1), unescaped)
        return F.struct(unescaped(role).alias("role"), F.array_join(texts, "").alias("text"))

    turns = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))), parse)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(
        spans,
        lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])),
    )
