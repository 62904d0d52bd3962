"""Pure functions of the corpus operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from logsheaf.llm.language import viterbi
from logsheaf.llm.packing import plan
from logsheaf.llm import language, pretokens
from logsheaf.llm.pretokens import BatchEncoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOME = st.lists(
    st.sampled_from(["word", "Word's", " ", "  ", "\n", "\t", "12", "½", "é", "你好", "!?", "_", "'ll", "'", "<|endoftext|>", "\xa0", "\x1c", "İ", "x" * 40]),
    max_size=30,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(SOME, st.text(max_size=60)))
def test_pieces_encode_like_the_library(text):
    coder = encoder(PATH)
    ids = coder.library.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(coder.encode(text), "<u4")) == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(SOME, st.text(max_size=30), st.none()), max_size=8), max_size=3), st.integers(1, 60))
def test_batches_encode_like_the_library(batches, kept):
    coder = BatchEncoder(encoder(PATH))
    before, pretokens.WORDS = pretokens.WORDS, kept
    try:
        for texts in batches:
            want = [coder.coder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
            got = coder.encode(pa.array(texts, pa.string()))
            assert [list(np.frombuffer(ids, "<u4")) for ids in got] == want
    finally:
        pretokens.WORDS = before


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_every_piece_once(counts):
    table = np.zeros(65, dtype="int64")
    for n, times in counts.items():
        table[n] = times
    used, sequences = np.zeros(65, dtype="int64"), 0
    for pattern, copies in plan(table, 64):
        assert sum(n * times for n, times in pattern) <= 64 and copies > 0
        for n, times in pattern:
            used[n] += times * copies
        sequences += copies
    assert (used == table).all()
    total = int((np.arange(65) * table).sum())
    assert sequences <= 2 * total / 64 + 1


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([6, 4, 4, 1])
    scores = rng.normal(size=(lengths.sum(), 3)).astype("float32") * 3
    path, at = viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        own = scores[at : at + n].astype("float64")

        def value(states):
            return own[np.arange(n), list(states)].sum() - 2.0 * (np.diff(states) != 0).sum()

        best = max(value(states) for states in np.ndindex(*[3] * int(n)))
        assert abs(value(path[at : at + n]) - best) < 1e-6
        at += n


def test_batches_take_little_memory_beside_the_text():
    """Index arrays do not grow with the batch; its ids leave one text at a time."""
    coder = BatchEncoder(encoder(PATH))
    text = "the quick brown fox jumps over it " * 500
    texts = pa.array([text] * 250, pa.string())
    list(coder.encode(texts[:1]))
    want, peak = coder.coder.encode(text), 0
    tracemalloc.start()
    try:
        assert all(ids == want for ids in coder.encode(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * texts.nbytes


def test_labels_take_little_memory_beside_the_text():
    """Words are held as numbers and scored some at a time, also where most are new."""
    draw = np.random.default_rng(0)
    model = language.LanguageModel(
        ["a", "b"], np.log(draw.random((language.BUCKETS, 2))), np.ones((2, 400), dtype=bool)
    )
    letters = draw.integers(97, 123, (60_000, 8)).astype("u1").tobytes().decode()
    words = [letters[i : i + 8] for i in range(0, len(letters), 8)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)] + [""]
    alone = [language._Labeller(model, 1.0).label([text]) for text in texts[:3]]
    tracemalloc.start()
    try:
        predicted, scores, spans = language._Labeller(model, 1.0).label(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(p, s, r) for (p,), (s,), (r,) in alone] == list(zip(predicted, scores, spans))[:3]
    assert (predicted[-1], scores[-1], spans[-1]) == ("und", 0.0, [])
    assert peak < 60 * sum(map(len, texts))
