"""Lempel-Ziv phrase fingerprints, compared like compressed sizes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.pretokens import by_size, texts_of

KEPT = 128
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


class Phrases:
    """The phrases of a Lempel-Ziv (1978) parse that can be continued.

    A phrase is the longest known phrase and one more character. ``trie`` maps
    (phrase, character) to a phrase, and ``hashes`` has a polynomial hash of each.
    """

    def __init__(self):
        self.trie, self.hashes, self.node = {}, [0], 0

    def copy(self) -> Phrases:
        other = Phrases()
        other.trie, other.hashes, other.node = dict(self.trie), list(self.hashes), self.node
        return other

    def read(self, text: str) -> Phrases:
        trie, hashes, node = self.trie, self.hashes, self.node
        find = trie.get
        for code in memoryview(text.encode("utf-32-le")).cast("I"):
            key = node << 21 | code
            after = find(key)
            if after is None:
                trie[key] = len(hashes)
                hashes.append((hashes[node] * _STEP + code + 1) & _MASK)
                node = 0
            else:
                node = after
        self.node = node
        return self

    def fingerprint(self, kept: int = KEPT) -> str:
        """The ``kept`` smallest hashes of the phrase set, as hex; "" for no phrase."""
        x = np.array(self.hashes[1:], dtype="uint64")
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        small = np.unique(x >> np.uint64(32))[:kept]
        return small.astype(">u4").tobytes().hex()


def likeness(one: str, other: str, kept: int = KEPT) -> float:
    """Share of the smallest hashes of both phrase sets together that are in both, 0 to 1.

    It estimates the Jaccard likeness of the sets, exactly where both have at
    most ``kept`` phrases. Two empty fingerprints are alike.
    """
    a, b = (np.frombuffer(bytes.fromhex(x), dtype=">u4") for x in (one, other))
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:kept]
    return float(np.isin(both, np.intersect1d(a, b)).sum() / len(both))


def fingerprint(
    docs: DataFrame, id: str = "doc_id", text: str = "text", kept: int = KEPT
) -> DataFrame:
    """Fingerprint of each whole text: (doc_id, fingerprint). A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Phrases().read(t).fingerprint(kept) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found, pa.string())], ["doc_id", "fingerprint"]
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string"
    )


RESULT = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _range_of(id: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (rising) below ``id``, by two short searches; 0 for null."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[at : at + step] for at in range(0, len(bounds), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda bound: bound < id))

    coarse = below(F.lit([chunk[0] for chunk in chunks]))
    fine = below(F.element_at(F.array(*(F.lit(chunk) for chunk in chunks)), coarse))
    return F.when(id.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)


class _Text:
    """A text with its parse, which is kept at the place where an edit begins."""

    def __init__(self, text: str, kept: int):
        self.text, self.tail, self.kept = text, len(text) // 4, kept
        self.cut = Phrases().read(text[: len(text) - self.tail])
        self.print = self.cut.copy().read(text[len(text) - self.tail :]).fingerprint(kept)

    def beside(self, following: _Text) -> tuple:
        """Results of this text, edited with the head of the following one."""
        head = following.text[: self.tail]
        edited = self.text[: len(self.text) - self.tail] + head
        edited_print = self.cut.read(head).fingerprint(self.kept)
        return (
            len(self.text),
            hashlib.sha256(edited.encode()).hexdigest(),
            self.print,
            edited_print,
            likeness(self.print, edited_print, self.kept),
            likeness(self.print, following.print, self.kept),
        )


def compare_with_edits(
    docs: DataFrame, id: str = "doc_id", text: str = "text", kept: int = KEPT
) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness.

    The edited text has the last quarter of its code points replaced by as
    many of the next document's first ones, by ascending id (nulls first, then
    by text, where ids repeat); the last document is followed by the first.

    Documents are dealt out by ranges of ids, one per task, sorted there and
    read row after row. A range's last row needs the next range's first, so
    that one row is sent along as well. The driver sees the ids that part the
    ranges, and the least of each.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per input row. Null texts are empty, and
    two empty texts are alike; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [at / ranges for at in range(1, ranges)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []))
    number = _range_of(F.col("doc_id"), bounds)
    least = rows.groupBy(number.alias("range")).agg(F.min(F.struct("doc_id")).alias("least"))
    firsts = sorted((r["range"], r["least"]["doc_id"]) for r in least.collect())
    follows = spark.createDataFrame(
        [(before[0], after[1]) for before, after in zip(firsts, firsts[1:] + firsts[:1])],
        "range int, first long",
    )
    # With repeated ids, the least text among a range's first ids comes first.
    along = (
        rows.join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("range", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("range", F.lit(True).alias("along"), "doc_id", "text")
    )
    dealt = (
        rows.select(number.alias("range"), F.lit(False).alias("along"), "doc_id", "text")
        .unionByName(along)
        .repartitionById(len(bounds) + 1, "range")
        .sortWithinPartitions("along", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in by_size(batches, "text", 1 << 20):
            found = []
            for doc, value in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"])):
                now = _Text(value, kept)
                if before is not None:
                    found.append((before[0], *before[1].beside(now)))
                before = (doc, now)
            columns = zip(*found) if found else [()] * len(RESULT)
            arrays = [pa.array(c, t) for c, t in zip(columns, RESULT.values())]
            yield pa.RecordBatch.from_arrays(arrays, list(RESULT))

    return dealt.select("doc_id", "text").mapInArrow(run, _SCHEMA)
