"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.pretokens import encoder, texts_of

FREQUENT = 16_384
PER_TASK = 2_048
LONGEST = 64
COUNTED = 100_000


def frequent_pieces(docs: DataFrame, tokenizer: str, text: str, size: int = FREQUENT) -> DataFrame:
    """The most frequent text pieces (piece, n) over all documents, about.

    Each task counts its own pieces and hands on its ``PER_TASK`` most frequent
    ones; only these summaries meet, never the pieces of the texts. The
    table only decides what is looked up first, not any count of tokens.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(tokenizer), Counter()
        for batch in batches:
            for value in texts_of(batch["text"]):
                seen.update(coder.pieces(value) or ())
                if len(seen) > 4 * COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED)))
        top = [(p, n) for p, n in seen.most_common(PER_TASK) if len(p) <= LONGEST]
        columns = [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "n"])

    return (
        docs.select(F.col(text).alias("text"))
        .mapInArrow(summarise, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(size)
    )


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokens of each whole text: (doc_id, n_bytes, n_tokens, over_limit).

    The first tier is a broadcast table of the token counts of the
    ``FREQUENT`` most frequent text pieces, at most ``LONGEST`` characters
    each, so its size is bounded. Other pieces are encoded once and kept
    in a cache of bounded size in each worker. Nothing is shuffled but the
    per-task summaries behind the table.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows
    are kept, one result for each input row; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    coder = encoder(tokenizer)
    table = {
        row.piece: len(coder.ids_of[row.piece]) // 4
        for row in frequent_pieces(docs, tokenizer, text).collect()
    }
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, frequent = encoder(tokenizer), shared.value
        get, ids_of = frequent.get, coder.ids_of
        for batch in batches:
            totals = np.zeros(batch.num_rows, dtype="int64")
            for row, value in enumerate(texts_of(batch["text"])):
                pieces = coder.pieces(value)
                if pieces is None:
                    totals[row] = len(coder.whole(value)) // 4
                    continue
                known = list(map(get, pieces))
                if None in known:
                    totals[row] = sum(
                        len(ids_of[p]) // 4 if n is None else n for p, n in zip(pieces, known)
                    )
                else:
                    totals[row] = sum(known)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(totals)],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    narrow = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
