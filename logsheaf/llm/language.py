"""Language identification: scripts, word scores and a Viterbi path over the words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsheaf.llm.pretokens import by_size, texts_of
from logsheaf.session import materialize

BUCKETS = 1 << 16
SAMPLE = 20_000
LONGEST_GRAM = 4
LONGEST_WORD = 40
SMOOTHING = 0.5
WORST = 12.0
SWITCH = 15.0
SCRIPT_SHARE = 0.02
LEAST_SHARE = 0.4
CACHED = 100_000
SCORED = 8_192
UNDETERMINED = "und"

LETTERS = re.compile(r"[^\W\d_]+")

# First code point of each range of letters, and its script.
RANGES = (
    (0x0041, "Latin"), (0x02B0, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Other"),
    (0x20000, "Han"),
)
SCRIPTS = sorted({name for _, name in RANGES})
_STARTS = np.array([start for start, _ in RANGES])
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in RANGES])
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def scripts_of(words: list[str]) -> np.ndarray:
    """Script number of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), "int64", len(words))
    return _SCRIPT_OF_RANGE[np.maximum(np.searchsorted(_STARTS, first, side="right") - 1, 0)]


def _piece_pattern() -> str:
    """Letters of one script, at most ``LONGEST_WORD``; those of "Other" go with any before them."""
    classes: dict[str, str] = {name: "" for name in SCRIPTS}
    ends = [start for start, _ in RANGES[1:]] + [0x110000]
    for (start, name), end in zip(RANGES, ends):
        classes[name] += f"{chr(start)}-{chr(end - 1)}"
    other = classes.pop("Other")
    each = [f"[{own}][{own}{other}]{{0,{LONGEST_WORD - 1}}}" for own in classes.values()]
    return "|".join([*each, f"[{other}]{{1,{LONGEST_WORD}}}"])


PIECE = re.compile(_piece_pattern())
# Texts whose letters are Latin throughout.
LATIN = re.compile("[\u0000-\u02af\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf]*")


def words_of(text: str) -> list[str]:
    """Runs of letters, cut at each change of script and after each ``LONGEST_WORD`` letters."""
    runs = LETTERS.findall(text)
    if LATIN.fullmatch(text) and max(map(len, runs), default=0) <= LONGEST_WORD:
        return runs
    return [piece for run in runs for piece in PIECE.findall(run)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, each between its edges, and their words."""
    edged = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, edged), "int64", len(edged))
    codes = np.frombuffer("".join(edged).encode("utf-32-le"), "<u4").astype("uint64")
    owner = np.repeat(np.arange(len(edged)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    value, buckets, owners = np.zeros(len(codes), dtype="uint64"), [], []
    for n in range(1, LONGEST_GRAM + 1):
        ahead = np.concatenate([codes[n - 1 :], np.zeros(n - 1, dtype="uint64")])
        value = (value + ahead + np.uint64(n)) * _FACTOR
        whole = room >= n
        mixed = (value ^ (value >> np.uint64(29))) * _FACTOR
        buckets.append((mixed >> np.uint64(48))[whole].astype("int64") % BUCKETS)
        owners.append(owner[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def held_out(id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, size: int) -> DataFrame:
    """``size`` rows, those of the least hash over all columns; all rows where there are fewer.

    Only hashes are ordered. Rows of the last hash are equal, so it does not matter which are taken.
    """
    if rows.count() <= size:
        return rows
    key = F.xxhash64(*rows.columns)
    least = materialize(rows.select(key.alias("key")).orderBy("key").limit(size))
    last = least.agg(F.max("key")).first()[0]
    below = least.where(F.col("key") < last).count()
    return rows.where(key < last).unionByName(rows.where(key == last).limit(size - below))


def id_of(docs: DataFrame, id: str) -> Column:
    return F.col(id).cast("string") if id in docs.columns else F.lit(None).cast("string")


@dataclass
class LanguageModel:
    """Scores of character n-grams by language, and each language's scripts."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods by language, relative to the best; other scripts' languages get the worst."""
        buckets, owners = grams(words)
        found = np.stack(
            [np.bincount(owners, self.scores[buckets, i], len(words)) for i in range(len(self.languages))],
            axis=1,
        )
        allowed = self.scripts[:, scripts_of(words)].T
        best = np.where(allowed, found, -np.inf).max(axis=1, keepdims=True)
        found = np.where(allowed, np.maximum((found - best) / LONGEST_GRAM, -WORST), -WORST)
        return np.where(allowed.any(axis=1, keepdims=True), found, 0.0).astype("float32")


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    id: str = "doc_id",
) -> LanguageModel:
    """Learns from at most ``sample`` labelled rows; rows without text or language are passed over.

    Rows are chosen by their hash with ``id``, if there is one, so copies count by their share.

    Tasks count words and hand on n-gram counts, at most ``BUCKETS`` rows per
    language and task. The model is of languages times ``BUCKETS`` numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for value, name in zip(texts_of(batch["text"]), batch["lang"].to_pylist()):
                words.setdefault(name, Counter()).update(words_of(value.lower()))
        for name, seen in words.items():
            if not seen:
                continue
            known, times = list(seen), np.fromiter(seen.values(), "int64", len(seen))
            letters = times * np.fromiter(map(len, known), "int64", len(known))
            found, owners = grams(known)
            counts = np.concatenate(
                [
                    np.bincount(found, times[owners], BUCKETS),
                    np.bincount(scripts_of(known), letters, len(SCRIPTS)),
                ]
            ).astype("int64")
            used = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(used.astype("int32")), pa.array(counts[used])],
                ["lang", "bucket", "n"],
            )

    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), id_of(docs, id).alias("id")
    )
    rows = (
        bounded_sample(labelled, sample)
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    column = rows["lang"].map({name: i for i, name in enumerate(languages)})
    counts[rows["bucket"].to_numpy("int64"), column.to_numpy("int64")] = rows["n"].to_numpy("float64")
    features, letters = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    share = letters / np.maximum(letters.sum(axis=0), 1)
    return LanguageModel(
        languages,
        np.log(features / features.sum(axis=0)).astype("float32"),
        (share >= SCRIPT_SHARE).T,
    )


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word. ``lengths`` (falling) cuts the words into documents.

    All documents step together, word by word; a change of language costs ``switch``.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    came = np.zeros(scores.shape, dtype="int16")
    path = np.zeros(len(scores), dtype="int16")
    own = np.arange(scores.shape[1], dtype="int16")
    best = scores[starts].astype("float64")
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for t in range(1, longest):
        n = active[t]
        at, now = starts[:n] + t, best[:n]
        top = now.argmax(axis=1)
        other = now[np.arange(n), top][:, None] - switch
        came[at] = np.where(now >= other, own, top[:, None])
        best[:n] = scores[at] + np.maximum(now, other)
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        path[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return path


class _Labeller:
    """Labels batches of texts; keeps the words it has scored, up to a bound.

    Words of a batch are held as numbers, not as texts, and new ones are scored
    ``SCORED`` at a time.
    """

    def __init__(self, model: LanguageModel, switch: float):
        self.model, self.switch = model, switch
        self._known: dict[str, int] = {}
        self._rows = np.zeros((0, len(model.languages)), dtype="float32")
        self._letters = np.zeros(0, dtype="int32")

    def _numbered(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text, as numbers of known words."""
        if len(self._known) > CACHED:
            self._known.clear()
            self._rows, self._letters = self._rows[:0], self._letters[:0]
        known, before, numbers = self._known, len(self._known), []
        for text in texts:
            words = words_of(text.lower())
            new = set(words).difference(known)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            numbers.append(np.fromiter(map(known.__getitem__, words), "int32", len(words)))
        fresh = islice(known, before, None)
        rows, letters = [self._rows], [self._letters]
        while some := list(islice(fresh, SCORED)):
            if self.model.languages:
                rows.append(self.model.words(some))
            letters.append(np.fromiter(map(len, some), "int32", len(some)))
        self._rows, self._letters = np.concatenate(rows), np.concatenate(letters)
        return numbers

    def _paths(self, words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """For texts by falling number of words: path of each text, letters by language."""
        lengths = np.array([len(own) for own in words])
        numbers = np.concatenate(words)
        path = viterbi(self._rows[numbers], lengths, self.switch)
        totals = np.zeros((len(words), len(self.model.languages)))
        owners = np.repeat(np.arange(len(words), dtype="int32"), lengths)
        np.add.at(totals, (owners, path), self._letters[numbers])
        return np.split(path, np.cumsum(lengths)[:-1]), totals

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, score and spans of each text."""
        languages = self.model.languages
        predicted, spans = [UNDETERMINED] * len(texts), [[]] * len(texts)
        scores = np.zeros(len(texts))
        words = self._numbered(texts)
        order = sorted((i for i, w in enumerate(words) if len(w)), key=lambda i: -len(words[i]))
        if order and languages:
            paths, totals = self._paths([words[i] for i in order])
            for i, path, letters in zip(order, paths, totals):
                top = int(letters.argmax())
                predicted[i], scores[i] = languages[top], letters[top] / letters.sum()
                ends = [*(np.nonzero(np.diff(path))[0] + 1).tolist(), len(path)]
                spans[i] = [
                    {"first": a, "end": b, "lang": languages[path[a]]}
                    for a, b in zip([0, *ends], ends)
                ]
        return predicted, scores, spans


def identify(
    docs: DataFrame,
    model: LanguageModel,
    switch: float = SWITCH,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Language of each whole text: (doc_id, lang_pred, score, spans).

    Words are runs of letters in lower case, as ``words_of`` cuts them: at changes
    of script, and long runs into parts. The script of a word leaves some
    languages, its n-grams score those, and the best path through all words,
    with a penalty per change, labels them. ``spans`` has the runs of
    one language as numbers of words (first, end, lang); the language with most
    letters is the text's, and ``score`` its share of the letters.

    A text that is null or has no letter is ``und`` with score 0 and no spans;
    so are all where nothing was learned. Null ids and repeated rows are
    kept; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(shared.value, switch)
        for batch in by_size(batches, "text"):
            predicted, scores, spans = labeller.label(texts_of(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(predicted, pa.string()),
                    pa.array(scores),
                    pa.array(spans, span),
                ],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run,
        "doc_id long, lang_pred string, score double, "
        "spans array<struct<first int, end int, lang string>>",
    )


def with_language(
    docs: DataFrame,
    model: LanguageModel,
    least: float = LEAST_SHARE,
    switch: float = SWITCH,
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known.

    Rejected are texts without letters, null included, and those in which no
    language has the share ``least`` of the letters; of equal shares the first
    by name counts. Very long texts are judged as a whole, and repeated rows
    alike. An empty table stays empty; columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(shared.value, switch)
        for batch in by_size(batches, text):
            predicted, scores, _ = labeller.label(texts_of(batch[text]))
            known = np.array([p != UNDETERMINED for p in predicted], dtype=bool)
            yield batch.filter(pa.array(known & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)
