"""Secret scans over a ledger of content-addressed texts."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.tables import small, spare
from logsheaf.session import materialize, shared_dir, table_exists

SPAN = "struct<start:int,rank:int,end:int,kind:string,rule:string>"


@dataclass(frozen=True)
class Rule:
    """A pattern for secrets of one kind.

    ``value`` is the pattern's group that must have ``least`` characters; a
    match that has fewer is dropped after it took its place. ``hint`` is a cheaper
    pattern found in every text that has a match.
    """

    kind: str
    pattern: str
    least: int
    value: int = 0
    hint: str | None = None

    @property
    def version(self) -> str:
        """Identifies the rule's content: another pattern is another version."""
        return f"{self.kind}-{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"


_NAME = "(?i:password|passwd|secret|token|api_?key)"

BASE = (
    Rule(
        "assign",
        f"({_NAME})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        value=2,
        hint=f"{_NAME}[\"']?\\x20*[:=]",
    ),
    Rule("access", "AKIA[A-Z0-9]+", 20, hint="AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]+", 24, hint="[0-9a-f]{24}"),
)

# Public forms of well-known credentials.
RULES = (
    *BASE,
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
)


def _spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, leftmost and without overlap.

    The pieces between the matches and the matches themselves, in turn, give
    the position of each.
    """
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = (
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value)) if rule.value else matches
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, each: Column) -> Column:
        begin = state["at"] + F.length(each["piece"])
        end = begin + F.length(each["match"])
        span = F.struct(
            begin.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.version).alias("rule"),
        )
        kept = F.length(each["value"]) >= rule.least
        spans = F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    each = F.arrays_zip(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("piece"),
        matches.alias("match"),
        values.alias("value"),
    )
    return F.aggregate(each, start, step, lambda s: s["spans"])


def find_spans(text: Column, rules: tuple[Rule, ...], wanted: Column) -> Column:
    """Spans of the rules whose versions are in ``wanted``, by start and then by rule."""
    none = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(
            F.array_contains(wanted, rule.version) & text.rlike(rule.hint or rule.pattern),
            _spans_of(text, rule, rank),
        ).otherwise(none)
        for rank, rule in enumerate(rules)
    ]
    return F.sort_array(F.concat(*found))


def address(text: Column) -> Column:
    """A text's content address; a null text has that of the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def new_ledger(spark) -> str:
    """A place for a ledger that lasts as long as this application's tables."""
    folder = f"{shared_dir(spark)}/logsheaf/{spark.sparkContext.applicationId}"
    return f"{folder}/ledger-{uuid.uuid4().hex}"


def findings(
    docs: DataFrame,
    ledger: str,
    rules: tuple[Rule, ...] = RULES,
    id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger has not seen; (paths, findings by blob).

    ``paths`` has each row's id and blob, the SHA-256 of its text. The ledger
    table (blob, rules, spans) has what was scanned before: each pair of
    blob and rule version is scanned once, ever, in the text of one of the
    blob's paths, and appended. The findings (blob, spans) are those of
    ``rules`` and hold only blobs with spans.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    addressed = rows.withColumn("blob", address(F.col("text")))
    paths = materialize(addressed.select("id", "blob"))
    versions = F.array(*(F.lit(rule.version) for rule in rules))
    blobs = paths.groupBy("blob").agg(F.min("id").alias("source"))
    if table_exists(spark, ledger):
        known = (
            spark.read.parquet(ledger)
            .groupBy("blob")
            .agg(F.flatten(F.collect_set("rules")).alias("known"))
        )
        blobs = blobs.join(known, "blob", "left").withColumn(
            "missing", F.array_except(versions, F.coalesce("known", F.array().cast("array<string>")))
        )
    else:
        blobs = blobs.withColumn("missing", versions)
    unseen = blobs.where(F.size("missing") > 0).select(
        F.col("blob").alias("unseen"), "source", "missing"
    )
    scanned = (
        addressed.join(
            unseen, (F.col("blob") == F.col("unseen")) & F.col("id").eqNullSafe(F.col("source"))
        )
        .select("blob", "missing", find_spans(F.col("text"), rules, F.col("missing")).alias("spans"))
        .groupBy("blob", F.col("missing").alias("rules"))
        .agg(F.first("spans").alias("spans"))
    )
    scanned.write.mode("append").parquet(ledger)
    current = [rule.version for rule in rules]
    found = (
        spark.read.parquet(ledger)
        .select("blob", F.filter("spans", lambda s: s["rule"].isin(current)).alias("spans"))
        .where(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    return paths, found


def scan(
    docs: DataFrame,
    ledger: str,
    rules: tuple[Rule, ...] = RULES,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Secrets of each row: (doc_id, blob, spans).

    ``spans`` is an array of (start, rank, end, kind, rule) in code points, end
    exclusive, by start and then by the rules' order; empty without findings.

    A null text is empty. Null ids and repeated rows are kept, and equal texts
    have equal findings, though only one of them is scanned. An empty table
    gives no rows; other columns are ignored.
    """
    paths, found = findings(docs, ledger, rules, id, text)
    none = F.array().cast(f"array<{SPAN}>")
    return paths.join(found, "blob", "left").select(
        F.col("id").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans")
    )


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(
            text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))
        )
        fresh = span["start"] >= state["at"]
        grown = F.when(fresh, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), grown.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.aggregate(spans, start, step, finish)


def redact(
    docs: DataFrame,
    ledger: str,
    rules: tuple[Rule, ...] = RULES,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with all columns and rows, secrets in ``text`` replaced; ``n_chars`` follows, if any.

    Texts without findings, null included, stay as they are. Null ids and
    repeated rows are kept; very long texts are scanned as a whole. An empty
    table stays empty; columns may have any names.
    """
    names = docs.columns
    _, found = findings(docs, ledger, rules, id, text)
    blob, own = spare("blob", docs), spare("spans", docs)
    keyed = docs.withColumn(blob, address(F.col(text)))
    spans = materialize(found.select(F.col("blob").alias(blob), F.col("spans").alias(own)))
    joined = keyed.join(small(spans, weight=1 + F.size(own)), blob, "left")
    changed = joined.withColumn(
        text,
        F.when(F.col(own).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(own))),
    )
    if "n_chars" in names:
        kept = F.col(own).isNull()
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(kept, F.col("n_chars")).otherwise(length))
    return changed.select(*names)
