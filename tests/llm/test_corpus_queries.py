import hashlib
import os
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import compare
from tokenizers import Tokenizer

from logsheaf.llm import decontamination, workload
from logsheaf.llm.lz_fingerprints import Phrases

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def tables(spark):
    def read(name):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet").toPandas()

    return read


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(workload.TOKENIZER))


def result(spark, name):
    return workload.QUERIES[name](spark, SF_DIR).toPandas()


@pytest.mark.parametrize("name", list(workload.ORACLE))
def test_query_matches_sql(spark, name):
    rows, problem = compare(spark, workload.QUERIES[name], workload.ORACLE[name], SF_DIR)
    assert problem is None
    assert rows > 0


def test_decontamination_against_brute_force(spark, tables):
    docs, items = tables("documents"), tables("benchmark")
    got = result(spark, "op1_decontamination")
    want = brute.contaminated(
        dict(zip(docs.doc_id, docs.text)),
        dict(zip(items.item_id, items.text)),
        set(decontamination.UNITS),
    )
    found = {(r.doc_id, r.item_id): (r.n_windows, r.n_changed) for r in got.itertuples()}
    assert found == want and want


def test_token_counts_equal_the_library(spark, tables, library):
    docs = tables("documents")
    got = result(spark, "op2_token_counts").set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got.loc[doc]) == (len((text or "").encode()), n, n > 512)


def check_packing(rows, texts, library, capacity=2048):
    for doc, own in rows.groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        own = own.sort_values("piece")
        assert list(own.piece) == list(range(len(own))) and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == capacity).all()
        for start, length, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= capacity
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]]
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / capacity + 1


def test_packing(spark, tables, library):
    docs = tables("documents")
    rows = result(spark, "op10_best_fit_packing")
    assert set(rows.doc_id) == set(docs.doc_id)
    check_packing(rows, dict(zip(docs.doc_id, docs.text)), library)


def test_url_filter(spark, tables):
    urls = dict(zip(tables("pages").page_id, tables("pages").url))
    got = result(spark, "op6_url_filter")
    assert set(got.page_id) == set(urls)
    for row in got.itertuples():
        host, path = brute.url_parts(urls[row.page_id])
        fitting = [
            rule
            for rule in workload.URL_RULES
            if ("." + host).endswith("." + rule.split("/", 1)[0])
            and path.startswith("/" + rule.split("/", 1)[1])
        ]
        rule = max(fitting, key=len, default=None)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (workload.URL_RULES[rule] if rule else row.verdict)
        assert row.verdict in ("allow", "block")


def test_fingerprints(spark, tables):
    docs = tables("documents").sort_values("doc_id")
    ids, texts = list(docs.doc_id), [t or "" for t in docs.text]
    got = result(spark, "op7_lz_fingerprints").set_index("doc_id")
    assert len(got) == len(ids)
    for i, (doc, text) in enumerate(zip(ids, texts)):
        after, cut = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = got.loc[doc]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == Phrases().read(text).fingerprint()
        assert row.edited_fingerprint == Phrases().read(edited).fingerprint()
        for found, other in ((row.near_edited, edited), (row.near_next, after)):
            a, b = brute.phrases(text), brute.phrases(other)
            assert abs(found - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2


def test_language_of_held_out_documents(spark, tables):
    rows = result(spark, "op8_language_id").merge(tables("documents"), on="doc_id")
    unseen = rows[rows.held_out]
    assert (unseen.lang == unseen.lang_pred).mean() > 0.9


def test_toxicity_of_labelled_documents(spark, tables):
    rows = result(spark, "op9_toxicity")
    assert rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    rows = rows.merge(tables("labels"), on="doc_id")
    toxic, clean = rows[rows.toxic == 1].score, rows[rows.toxic == 0].score
    assert len(toxic) == 0 or toxic.median() > clean.median()


def test_pipeline_against_brute_force(spark, tables, library):
    docs = tables("documents")
    texts = {d: t for d, t in zip(docs.doc_id, docs.text) if t and any(c.isalpha() for c in t)}
    class_of = brute.components({d: brute.shingles(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if class_of[d] == d}
    items = dict(zip(tables("benchmark").item_id, tables("benchmark").text))
    dirty = {d for d, _ in brute.contaminated(texts, items, set(decontamination.UNITS))}
    spans = defaultdict(list)
    for row in result(spark, "op3_secret_scan").itertuples():
        for span in filter(None, row.spans.split(",")):
            spans[row.doc_id].append(tuple(map(int, span.split(":")[1:])))
    kept = {}
    for doc, text in texts.items():
        if doc in dirty:
            continue
        out, at = "", 0
        for start, end in spans[doc]:
            if start >= at:
                out += text[at:start] + "<SECRET>"
            at = max(at, end)
        kept[doc] = out + text[at:]
    rows = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(rows.doc_id) == set(kept)
    check_packing(rows, kept, library)
