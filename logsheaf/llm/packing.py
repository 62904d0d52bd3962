"""Best-fit packing of token sequences by exact complements."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsheaf.llm.pretokens import BatchEncoder, by_size, encoder
from logsheaf.session import materialize

CAPACITY = 2048
END = 0
BATCH_BYTES = 4 << 20

TYPES = {
    "doc_id": pa.int64(),
    "piece": pa.int32(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "part": pa.int32(),
    "rank": pa.int64(),
}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PACKED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long"
)


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, id: str, text: str
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, numbered per task and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, numbers = BatchEncoder(encoder(tokenizer)), TaskContext.get().partitionId(), Counter()
        end = np.array([END], "<u4").tobytes()
        for batch in by_size(batches, "text", BATCH_BYTES):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), coder.encode(batch["text"])):
                ids += end
                total, at = len(ids) // 4, 0
                while at < total:
                    size = (total - at) % capacity or capacity
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    number = -(-at // capacity)
                    rows.append((doc, number, at, size, crc, part, numbers[size]))
                    numbers[size] += 1
                    at += size
            columns = zip(*rows) if rows else [()] * len(TYPES)
            arrays = [pa.array(c, t) for c, t in zip(columns, TYPES.values())]
            yield pa.RecordBatch.from_arrays(arrays, list(TYPES))
            pa.default_memory_pool().release_unused()

    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, PIECE)


class _Combinations:
    """Single, pair and triple sums over the lengths that are still available."""

    def __init__(self, left: np.ndarray):
        self.left = left

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often all of ``lengths`` can be taken together."""
        return min(int(self.left[n]) // k for n, k in Counter(lengths).items())

    def exact(self, first: int, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill ``gap`` beside ``first``: one, two or three of them."""
        if self.times((first, gap)):
            return (gap,)
        pair = self._pair(gap, (first,))
        if pair:
            return pair
        for longest in np.nonzero(self.left[: gap - 1])[0][::-1]:
            longest = int(longest)
            if 3 * longest < gap:
                break
            if self.times((first, longest)):
                pair = self._pair(gap - longest, (first, longest))
                if pair:
                    return (longest, *pair)
        return None

    def _pair(self, gap: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        larger = np.arange((gap + 1) // 2, gap)
        if not len(larger):
            return None
        both = np.minimum(self.left[larger], self.left[gap - larger])
        # Only pairs that share a length with ``beside`` or itself can fail: at most five.
        for at in np.argsort(-both, kind="stable")[:8]:
            found = (int(larger[at]), int(gap - larger[at]))
            if both[at] and self.times((*beside, *found)):
                return found
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, repeats)], each with its number of sequences.

    ``counts[n]`` is the number of pieces of length n. Longest first, a length
    takes combinations of one to three others that exactly fill its gap, as
    often as all of them are available. What has no exact complement is placed
    best-fit, longest first. The work depends on the capacity only.
    """
    left, done = counts.astype("int64").copy(), []
    sums, rest = _Combinations(left), np.zeros_like(left)
    for first in range(capacity, 0, -1):
        while left[first]:
            gap = capacity - first
            others = sums.exact(first, gap) if gap else ()
            if others is None:
                rest[first], left[first] = left[first], 0
                break
            lengths = (first, *others)
            copies = sums.times(lengths)
            for n in lengths:
                left[n] -= copies
            done.append((sorted(Counter(lengths).items(), reverse=True), copies))
    open_bins: dict[int, list] = defaultdict(list)
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(pattern, copies, gap):
        open_bins[gap].append((pattern, copies))
        gaps[gap] = True

    for n in range(capacity, 0, -1):
        todo = int(rest[n])
        while todo:
            fitting = np.nonzero(gaps[n:])[0]
            if not len(fitting):
                each = capacity // n
                if todo // each:
                    put([(n, each)], todo // each, capacity - each * n)
                if todo % each:
                    put([(n, todo % each)], 1, capacity - (todo % each) * n)
                break
            gap = n + int(fitting[0])
            pattern, copies = open_bins[gap].pop()
            gaps[gap] = bool(open_bins[gap])
            used = min(copies, todo)
            if used < copies:
                put(pattern, copies - used, gap)
            put([*pattern, (n, 1)], used, gap - n)
            todo -= used
    return done + [group for gap in sorted(open_bins) for group in open_bins[gap]]


def _allotments(patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, repeats per sequence, first sequence and offset of each use."""
    uses, taken, sequence = defaultdict(list), Counter(), 0
    for pattern, copies in patterns:
        offset = 0
        for n, repeats in pattern:
            uses[n].append((taken[n], repeats, sequence, offset))
            taken[n] += repeats * copies
            offset += n * repeats
        sequence += copies
    return {n: tuple(np.array(column) for column in zip(*rows)) for n, rows in uses.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and an id 0. Longer ones are cut, the
    first piece being the shorter. Only the histogram of lengths, at most
    ``capacity`` numbers, reaches the driver, where ``plan`` turns it into
    patterns. Each piece finds its sequence and offset from its length and
    its rank among pieces of that length. The rank is its number within a task plus
    the pieces of earlier tasks, so a length that a third of all rows have
    never gathers anywhere.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A null text is empty, and its document the one id
    0; null ids and repeated rows are packed like others; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity, id, text))
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = per_part.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    )
    counts = np.zeros(capacity + 1, dtype="int64")
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row.length] = row.n
    shared = spark.sparkContext.broadcast(_allotments(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = shared.value
        for batch in batches:
            sequence = np.zeros(batch.num_rows, dtype="int64")
            offset = np.zeros(batch.num_rows, dtype="int64")
            ranks = batch["rank"].to_numpy() + batch["first"].to_numpy()
            lengths = batch["length"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            ends = np.nonzero(np.diff(lengths[order], append=-1))[0] + 1
            for rows in np.split(order, ends[:-1]):
                n = int(lengths[rows[0]])
                first, repeats, base, at = uses[n]
                use = np.searchsorted(first, ranks[rows], side="right") - 1
                number = ranks[rows] - first[use]
                sequence[rows] = base[use] + number // repeats[use]
                offset[rows] = at[use] + (number % repeats[use]) * n
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return pieces.join(starts, ["part", "length"]).mapInArrow(place, PACKED)
