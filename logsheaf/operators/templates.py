"""Log templates: signatures, stable ids and parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.config import MESSAGE_MASKS, WILDCARD
from logsheaf.functions.masking import with_masked
from logsheaf.functions.text import strip
from logsheaf.operators.joins import BROADCAST_BYTES, lookup_join
from logsheaf.operators.ranking import with_position
from logsheaf.schemas import TEMPLATE

# The fields of an authentication message, in order.
MESSAGE_FIELDS = (
    "src_user",
    "dst_user",
    "src_computer",
    "dst_computer",
    "auth_type",
    "logon_type",
    "auth_orientation",
    "success",
)


def auth_message(columns: Sequence[str]) -> Column:
    """``key=value`` fields joined by one blank; missing values read UNKNOWN."""
    unknown = F.lit("UNKNOWN")
    return F.concat_ws(
        " ",
        *[
            F.concat(
                F.lit(f"{name}="),
                F.coalesce(F.col(name).cast("string"), unknown) if name in columns else unknown,
            )
            for name in MESSAGE_FIELDS
        ],
    )


def message_tokens(message: Column) -> Column:
    return F.split(strip(message), r"(?U)\s+")


def with_signature(
    df: DataFrame,
    message: Column,
    name: str = "signature",
    masks: Sequence[tuple[str, str]] = MESSAGE_MASKS,
    keep_digit_tokens: Sequence[str] = (),
) -> DataFrame:
    """Adds the masked message with each digit-bearing token made a wildcard.

    Tokens of the form ``key=...`` keep their digits for the keys named in
    ``keep_digit_tokens``.
    """
    kept = "".join(rf"(?!{key}=)" for key in keep_digit_tokens)
    masked = with_masked(df, message, name, masks)
    words = F.array_join(message_tokens(F.col(name)), " ")
    return masked.withColumn(
        name, F.regexp_replace(words, rf"(?U)(?<!\S){kept}\S*\p{{Nd}}\S*", WILDCARD)
    )


def with_auth_signature(
    df: DataFrame, name: str = "signature", keep_digit_tokens: Sequence[str] = ()
) -> DataFrame:
    """Adds the signature of the authentication message.

    No mask matches, and no token splits, inside values without a blank,
    ``.``, ``:`` or ``=`` that are too short for a hash. Rows of such values,
    nearly all, need only a look for a digit in each value; the others go
    through the whole message.
    """
    filled = {
        f"_{field}": F.coalesce(F.col(field).cast("string"), F.lit("UNKNOWN"))
        if field in df.columns
        else F.lit("UNKNOWN")
        for field in MESSAGE_FIELDS
    }
    odd = F.concat_ws("|", *filled).rlike(r"(?U)[\s.:=]|(?:^|\|)[^|]{32}")
    plain, quick = [], []
    for field, value in zip(MESSAGE_FIELDS, filled):
        token = F.concat(F.lit(f"{field}="), F.col(value))
        plain.append(token)
        if field not in keep_digit_tokens:
            token = F.when(F.col(value).rlike(r"\p{Nd}"), WILDCARD).otherwise(token)
        quick.append(token)
    marked = (
        df.withColumns(filled)
        .withColumn("_odd", odd)
        .withColumn("_quick", F.when(~F.col("_odd"), F.concat_ws(" ", *quick)))
    )
    message = F.when(F.col("_odd"), F.concat_ws(" ", *plain))
    return (
        with_signature(marked, message, name, keep_digit_tokens=keep_digit_tokens)
        .withColumn(name, F.coalesce("_quick", name))
        .drop("_odd", "_quick", *filled)
    )


def mine_signatures(events: DataFrame, seen: str = "time") -> DataFrame:
    """Distinct signatures of ``events.signature``: first seen, event count.

    The aggregate combines on the map side, so the input shrinks to the number
    of distinct signatures before anything is shuffled.
    """
    return events.groupBy("signature").agg(
        F.min(F.col(seen).cast("bigint")).alias("first_seen"), F.count("*").alias("n_events")
    )


def assign_template_ids(
    signatures: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """TEMPLATE rows of the signatures that ``known`` does not hold yet.

    Ids follow first appearance, ties by text, and continue after the largest
    known id, so that ids persist over runs.
    """
    highest = 0
    if known is not None:
        signatures = signatures.join(known.select("signature"), "signature", "left_anti")
        highest = known.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    if "template" not in signatures.columns:
        signatures = signatures.withColumn("template", F.col("signature"))
    ranked = with_position(signatures, F.col("first_seen"), F.col("signature"))
    return ranked.select(
        "signature",
        (F.col("position") + highest + 1).cast("int").alias("template_id"),
        "template",
        F.size(F.split("template", " ")).alias("n_tokens"),
        "first_seen",
        "n_events",
    ).to(TEMPLATE)


def mine_templates(
    events: DataFrame, known: DataFrame | None = None, seen: str = "time"
) -> DataFrame:
    """All templates after seeing ``events``: the known ones and the new ones.

    ``n_events`` counts ``events`` alone, each once, also for known templates.
    """
    mined = mine_signatures(events, seen)
    fresh = assign_template_ids(mined, known)
    return fresh if known is None else recounted(known.unionByName(fresh), mined)


def recounted(templates: DataFrame, counts: DataFrame) -> DataFrame:
    """``templates`` with the ``n_events`` of ``counts`` (signature, n_events); 0 where it has none."""
    found = counts.select("signature", F.col("n_events").alias("_n"))
    return (
        templates.join(found, "signature", "left")
        .withColumn("n_events", F.coalesce("_n", F.lit(0)).cast("bigint"))
        .select(*TEMPLATE.fieldNames())
        .to(TEMPLATE)
    )


def enrich(
    events: DataFrame, templates: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds ``template_id`` and ``event_id`` by signature.

    Without a template the id is -1 and the event id ``UNK``.
    """
    return lookup_join(
        events, templates.select("signature", "template_id"), "signature", max_bytes
    ).withColumns(
        {
            "event_id": F.coalesce(F.col("template_id").cast("string"), F.lit("UNK")),
            "template_id": F.coalesce("template_id", F.lit(-1)),
        }
    )


# A blank inside a timestamp, which its mask covers as one token.
_TIMESTAMP_BLANK = r"(?U)\b((?:19|20)\d{2}[-/]\d{2}[-/]\d{2}) (\d{2}:\d{2}:\d{2})\b"
_JOINT = "\ue000"


def template_params(message: Column, template: Column) -> Column:
    """The message values at the template's wildcards and masks, in order."""
    joined = F.regexp_replace(message, _TIMESTAMP_BLANK, f"$1{_JOINT}$2")

    def value(token: Column, pattern: Column) -> Column:
        before = F.length(F.substring_index(pattern, "<", 1))
        after = F.length(F.substring_index(pattern, ">", -1))
        inner = F.substring(token, before + 1, F.length(token) - before - after)
        return F.when(pattern.rlike(r"<(\*|[A-Z]+)>"), F.replace(inner, F.lit(_JOINT), F.lit(" ")))

    values = F.zip_with(message_tokens(joined), F.split(template, " "), value)
    return F.coalesce(
        F.filter(values, lambda item: item.isNotNull()), F.array().cast("array<string>")
    )


def template_count(templates: DataFrame) -> DataFrame:
    """Merged signatures share one template and count once."""
    return templates.agg(F.countDistinct("template_id").alias("templates"))
