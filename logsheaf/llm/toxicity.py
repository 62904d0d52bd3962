"""Toxicity by multiple-instance learning: sentences explain a document's label."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.language import id_of, bounded_sample
from logsheaf.llm.pretokens import by_size, texts_of
from logsheaf.llm.tables import small
from logsheaf.session import materialize

SAMPLE = 20_000
VOCABULARY = 2_048
STEMS = (4, 5, 6)
CACHED = 200_000
LEAST_DOCUMENTS = 5
LEAST_Z = 4.0
PENALTY = 1e-4
STEPS = 400
RATE = 0.1
THRESHOLD = 0.3
START = -6.0

WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass
class ToxicityModel:
    """Weights of features in a sentence's log-odds, and the log-odds without any."""

    weights: dict[str, float]
    bias: float


def lowered(text: str) -> str:
    """Lower case of the same length: only U+0130 has a longer one."""
    return text.replace("\u0130", "i").lower()


def features(word: str) -> list[str]:
    """A word, and its beginnings, which its other forms share."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class _Finder(dict):
    """The numbers of a word's known features; kept for later words, up to a bound."""

    def __init__(self, known: list[str]):
        self.number = {feature: i for i, feature in enumerate(known)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        found = tuple(self.number[f] for f in features(word) if f in self.number)
        self[word] = found
        return found

    def bags(self, text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
        """Distinct features of each sentence, rising."""
        get = self.__getitem__
        return [
            sorted({f for found in map(get, WORDS.findall(text, *span)) for f in found})
            for span in spans
        ]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sentences(text: str) -> list[tuple[int, int]]:
    """Code point spans between sentence marks and line ends that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text) if WORDS.search(text, *m.span())]


def _vocabulary(labelled: DataFrame) -> list[str]:
    """The features whose share of documents differs most between the labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for value, label in zip(texts_of(batch["text"]), batch["label"].to_pylist()):
                words = set(WORDS.findall(lowered(value)))
                seen[label].update({f for word in words for f in features(word)})
        words = sorted(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.string()),
                pa.array([seen[0][w] for w in words], pa.int64()),
                pa.array([seen[1][w] for w in words], pa.int64()),
            ],
            ["word", "clean", "toxic"],
        )

    totals = {row.label: row["count"] for row in labelled.groupBy("label").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return []
    share = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    spread = F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic))
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.greatest(spread, F.lit(1e-12))
    rows = (
        labelled.mapInArrow(count, "word string, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS)
        .withColumn("z", z)
        .where(F.abs("z") >= LEAST_Z)
        .orderBy(F.desc(F.abs("z")), "word")
        .limit(VOCABULARY)
        .collect()
    )
    return sorted(row.word for row in rows)


def _bags(labelled: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Of each document: label, number of sentences, and known features by sentence."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(vocabulary)
        for batch in by_size(batches, "text"):
            rows = []
            for value in texts_of(batch["text"]):
                text = lowered(value)
                spans = sentences(text)
                hits = [bag for bag in finder.bags(text, spans) if bag]
                rows.append((max(1, len(spans)), hits))
            columns = zip(*rows) if rows else ((), ())
            counts, words = columns
            yield pa.RecordBatch.from_arrays(
                [
                    batch["label"],
                    pa.array(counts, pa.int32()),
                    pa.array(words, pa.list_(pa.list_(pa.int32()))),
                ],
                ["label", "n", "words"],
            )

    return labelled.mapInArrow(find, "label int, n int, words array<array<int>>")


def _fit(labels, counts, bags, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias with the least noisy-or loss, by full-batch Adam.

    With S the sum of softplus(z) over a document's sentences, the noisy-or
    probability is 1 - exp(-S), and S is the loss of a clean document.
    """
    document = np.array([d for d, own in enumerate(bags) for _ in own], dtype="int64")
    sentence, word = [], []
    for number, own in enumerate(h for bag in bags for h in bag):
        sentence.extend([number] * len(own))
        word.extend(own)
    sentence, word = np.array(sentence, dtype="int64"), np.array(word, dtype="int64")
    plain = counts - np.bincount(document, minlength=len(counts))
    toxic = labels == 1
    values = np.concatenate([np.zeros(size), [START]])
    mean, spread = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        weights, bias = values[:-1], values[-1]
        z = bias + np.bincount(sentence, weights=weights[word], minlength=len(document))
        total = plain * softplus(bias) + np.bincount(
            document, weights=softplus(z), minlength=len(counts)
        )
        by_document = np.where(toxic, -1.0 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / len(counts)
        by_sentence = by_document[document] / (1 + np.exp(-z))
        gradient = np.concatenate(
            [
                np.bincount(word, weights=by_sentence[sentence], minlength=size) + PENALTY * weights,
                [by_sentence.sum() + (by_document * plain).sum() / (1 + np.exp(-bias))],
            ]
        )
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        values -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return values[:-1], float(values[-1])


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    sample: int = SAMPLE,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A written table (``id``, ``text``, ``label``) of about ``sample`` labelled documents.

    The sample is chosen from ids, hashes of texts and labels, so a labels
    table of any size joins without moving texts; only those chosen are read
    then. Rows that repeat an id and its text all come along.
    """
    key = F.xxhash64(F.col(text))
    pairs = docs.select(F.col(id).alias("id"), key.alias("key")).join(
        labels.where(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).alias("label")), "id"
    )
    chosen = materialize(bounded_sample(materialize(pairs), sample).distinct())
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), key.alias("key"))
    found = texts.join(small(chosen), ["id", "key"]).drop("key")
    return materialize(found.toDF(id, text, label))


def train(
    docs: DataFrame,
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    id: str = "doc_id",
) -> ToxicityModel:
    """Learns from at most ``sample`` labelled rows; rows with another label than 0 and 1 are passed over.

    Words and their beginnings are chosen by how much their document share
    differs between the labels. The fit sees only those, by sentence, so what reaches the
    driver is bounded by the sample. Without both labels, the model is neutral.
    """
    labelled = docs.where(F.col(label).isin(0, 1)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(label).cast("int").alias("label"),
        id_of(docs, id).alias("id"),
    )
    labelled = bounded_sample(labelled, sample).persist()
    vocabulary = _vocabulary(labelled)
    rows = _bags(labelled, vocabulary).collect() if vocabulary else []
    labelled.unpersist()
    if not rows:
        return ToxicityModel({}, START)
    weights, bias = _fit(
        np.array([r.label for r in rows]),
        np.array([r.n for r in rows]),
        [r.words for r in rows],
        len(vocabulary),
    )
    return ToxicityModel(dict(zip(vocabulary, weights.tolist())), bias)


def score(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = THRESHOLD,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Toxicity of each whole text: (doc_id, score, predicted, offending).

    A sentence's probability follows from its words, a document's is the
    noisy-or of its sentences. ``offending`` has the code point spans (start,
    end, score) of the sentences at or above ``threshold``.

    A null or empty text counts as one sentence without words. Null ids and
    repeated rows are kept; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder, weights = _Finder(list(model.weights)), np.array(list(model.weights.values()))
        get, idle = finder.__getitem__, float(softplus(np.float64(model.bias)))
        for batch in by_size(batches, "text"):
            scores, offending = np.zeros(batch.num_rows), [[]] * batch.num_rows
            for row, value in enumerate(texts_of(batch["text"])):
                text = lowered(value)
                spans = sentences(text)
                if not any(map(get, WORDS.findall(text))):
                    scores[row] = -np.expm1(-idle * max(1, len(spans)))
                    continue
                z = np.array([model.bias + weights[bag].sum() for bag in finder.bags(text, spans)])
                scores[row] = -np.expm1(-softplus(z).sum())
                each = 1 / (1 + np.exp(-z))
                offending[row] = [
                    {"start": a, "end": b, "score": float(p)}
                    for (a, b), p in zip(spans, each)
                    if p >= threshold
                ]
            span = pa.list_(
                pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.clip(scores, 0.0, 1.0)),
                    pa.array((scores >= threshold).astype("int32")),
                    pa.array(offending, span),
                ],
                ["doc_id", "score", "predicted", "offending"],
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        "doc_id long, score double, predicted int, "
        "offending array<struct<start int, end int, score double>>",
    )
