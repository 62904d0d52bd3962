"""Byte-level BPE by cached pieces of text, equal to what the tokenizer library gives."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

# The pre-token pattern of byte-level BPE, in Python's syntax, and
# the characters for which Python's classes are certain to agree with the
# library's (no superscripts or fractions, no unusual white space).
PRETOKEN = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
UNUSUAL = re.compile(
    "[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]"
)
SPACES = re.compile(r"\s\s")

CACHED = 200_000
WORDS = 1_000_000
GATHERED = 1 << 18


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies show byte b as chr(b) where that prints, else as chr(256 + n)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Cache(dict):
    """Encodes on a miss; forgets everything when it is full, so that memory stays bounded."""

    def __init__(self, encode, size: int):
        self._encode, self._size = encode, size

    def __missing__(self, piece):
        if len(self) >= self._size:
            self.clear()
        self[piece] = value = self._encode(piece)
        return value


class PieceEncoder:
    """Encodes texts of a ``tokenizers`` file by way of cached pieces.

    A cut before a single space between two visible characters is always a
    pre-token boundary, so texts split there and each piece is encoded once.
    Pieces that are not cached go through the merges pre-token by pre-token.
    Texts with unusual characters or with a special token's string, and
    tokenizers of another kind, go to the library as a whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = added
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.by_piece = (
            kind.get("type") == "ByteLevel"
            and not kind.get("add_prefix_space")
            and kind.get("use_regex", True)
            and model["type"] == "BPE"
            and not spec.get("normalizer")
            and not model.get("dropout")
            and not model.get("ignore_merges")
            and self._ids_follow_merges(model)
        )
        if self.by_piece:
            byte_of = _byte_of_character()
            ranks = {
                bytes(byte_of[c] for c in token): number
                for token, number in model["vocab"].items()
                if token not in set(added)
            }
            merges = tiktoken.Encoding(
                "pieces", pat_str=r"\p{L}+|[^\p{L}]+", mergeable_ranks=ranks, special_tokens={}
            )
            self._merge = merges._core_bpe.encode_single_piece
        self._pretokens = _Cache(self._encode_pretoken, CACHED // 2)
        self.ids_of = _Cache(self._encode_piece, CACHED)

    @staticmethod
    def _ids_follow_merges(model: dict) -> bool:
        """Whether merging by lowest id is merging in the order of the list."""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ids = [model["vocab"].get("".join(pair), -1) for pair in pairs]
        return min(ids, default=0) >= 0 and all(a < b for a, b in zip(ids, ids[1:]))

    def _encode_pretoken(self, pretoken: str) -> bytes:
        return np.array(self._merge(pretoken.encode()), "<u4").tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        return b"".join(map(self._pretokens.__getitem__, PRETOKEN.findall(piece)))

    def pieces(self, text: str) -> list[str] | None:
        """The text's pieces, or None where only the library may encode it."""
        if not self.by_piece:
            return None
        if UNUSUAL.search(text):
            return None
        if self.special is not None and self.special.search(text):
            return None
        if SPACES.search(text):
            return PRETOKEN.findall(text)
        first, *others = text.split(" ")
        pieces = [" " + other for other in others]
        return [first, *pieces] if first else pieces

    def whole(self, text: str) -> bytes:
        """Ids by the library itself, as little-endian unsigned 32-bit integers."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, as little-endian unsigned 32-bit integers."""
        pieces = self.pieces(text)
        return self.whole(text) if pieces is None else b"".join(map(self.ids_of.__getitem__, pieces))


class BatchEncoder:
    """Ids of many texts at once.

    Texts that may be cut into pieces are split into words by Arrow and looked
    up in the words seen before, all together; only a new word is encoded in
    Python, once. ``WORDS`` words are kept at most, or one batch's. Ids are then
    gathered for about ``GATHERED`` words at a time, so that the arrays beside
    the ids stay small.
    """

    def __init__(self, coder: PieceEncoder):
        self.coder = coder
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, "<u4")
        self.starts = self.lengths = np.zeros(0, "int32")

    def _learn(self, words: pa.Array) -> None:
        """Adds words, each with the space before it."""
        merge, ids, ends = self.coder._merge, [], []
        for word in words.to_pylist():
            if word.isalpha():
                ids.extend(merge(f" {word}".encode()))
            else:
                for pretoken in PRETOKEN.findall(f" {word}"):
                    ids.extend(merge(pretoken.encode()))
            ends.append(len(ids))
        lengths = np.diff(np.array(ends, "int32"), prepend=np.int32(0))
        starts = (len(self.ids) + np.cumsum(lengths, dtype="int64") - lengths).astype("int32")
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.array(ids, "<u4")])
        self.words = pa.concat_arrays([self.words, words])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word among those known, after learning the others."""
        found = np.array(pc.fill_null(pc.index_in(words, value_set=self.words), -1), "int32")
        new = found < 0
        if new.any():
            unseen = pc.unique(words.filter(pa.array(new)))
            if len(self.words) + len(unseen) > WORDS and len(self.words):
                self._forget()
                return self._numbers(words)
            base = len(self.words)
            self._learn(unseen)
            found[new] = base + pc.index_in(words.filter(pa.array(new)), value_set=unseen).to_numpy()
        return found

    def _by_words(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.split_pattern(texts, " ")
        values, ends = split.flatten(), np.cumsum(split.value_lengths().to_numpy().astype("int64"))
        begins = np.concatenate([[0], ends[:-1]])
        is_other = np.ones(len(values), bool)
        is_other[begins] = False
        firsts = values.take(pa.array(begins))
        numbers = self._numbers(values.filter(pa.array(is_other)))
        del split, values, is_other
        # Beside each text's first word stand its others, in a row.
        ends -= np.arange(1, len(ends) + 1)
        begins = np.concatenate([[0], ends[:-1]])
        group = begins // GATHERED
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ends)]
        for low, high in zip(edges, edges[1:]):
            some = numbers[begins[low] : ends[high - 1]]
            lengths, starts = self.lengths[some].astype("int64"), self.starts[some]
            after = np.concatenate([[0], np.cumsum(lengths)])
            flat = self.ids[np.repeat(starts - after[:-1], lengths) + np.arange(after[-1])]
            places = after[np.stack([begins[low:high], ends[low:high]]) - begins[low]]
            for first, start, end in zip(firsts[low:high].to_pylist(), *places.tolist()):
                yield (self.coder.ids_of[first] if first else b"") + flat[start:end].tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text in turn, null read as empty, as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts, "")
        if not self.coder.by_piece:
            yield from map(self.coder.whole, texts.to_pylist())
            return
        odd = pc.or_(pc.match_substring_regex(texts, UNUSUAL.pattern), pc.match_substring_regex(texts, r"[ \t\n\r]{2}"))
        for special in self.coder.added:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        plain = pc.invert(odd)
        rest = map(self.coder.encode, texts.filter(odd).to_pylist())
        words = self._by_words(texts.filter(plain)) if pc.any(plain).as_py() else iter(())
        for is_plain in plain.to_numpy(zero_copy_only=False):
            yield next(words if is_plain else rest)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder of a tokenizer file; its caches outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def by_size(
    batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        bytes_of = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(bytes_of.astype("int64")) // size
        ends = [*(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
        for start, end in zip([0, *ends], ends):
            yield batch.slice(start, end - start)


def texts_of(column: pa.Array) -> list[str]:
    """Texts with null read as empty."""
    return pc.fill_null(column, "").to_pylist()
