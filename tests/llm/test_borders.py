"""Borders between text parts, names that clash, and what a training sample reads."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from logsheaf.llm import chat, toxicity
from logsheaf.llm.decontamination import decontaminate
from logsheaf.llm.jaccard_join import deduplicated
from logsheaf.llm.secret_scan import new_ledger, redact

SHREDS = ["a<", "|end|><", "|turn|>assistant<", "|text|>hi", "<", "\\|x", "", "[", "/INST]", "</s", ">", "<|part|>", "<\\"]


def part(text=None, kind="text"):
    return (kind, text, None, None, None, None, None)


def test_parts_never_make_up_control_strings(spark):
    draw = random.Random(8)
    lists = [[part(t) for t in SHREDS[:4]], [part("<"), part("\\|x")]]
    for _ in range(200):
        lists.append([
            part(draw.choice(SHREDS)) if draw.random() < 0.8 else part(kind="image")
            for _ in range(draw.randrange(6))
        ])
    rows = [(i, 0, "user" if i % 2 else "assistant", parts) for i, parts in enumerate(lists)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    formatted = chat.format_chat(turns).select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )
    for row in formatted.collect():
        parts, role = lists[row.conv_id], rows[row.conv_id][2]
        texts = [p[1] or "" if p[0] == "text" else "<|image|>" for p in parts]
        assert [(t.role, t.text) for t in row.turns] == [(role, "".join(texts))]
        want = [p[1] or "" for p in parts if p[0] == "text"] if role == "assistant" else []
        assert row.learned == want


def test_pipeline_stages_with_any_column_names(spark):
    names = "_spans _blob _found _id found found_ spans blob blob_ own".split()
    rows = [(1, "password=abcdef123"), (2, "the very same words stand in here"), (3, "the very same words stand in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *(F.lit(f"x{name}").alias(name) for name in names))
    kept = [f"x{name}" for name in names]
    bench = spark.createDataFrame([(1, "same words stand in here")], "item_id long, text string")
    for found, ids in (
        (redact(docs, new_ledger(spark)), {1, 2, 3}),
        (deduplicated(docs), {1, 2}),
        (decontaminate(docs, bench), {1}),
    ):
        got = found.collect()
        assert {r.doc_id for r in got} == ids and found.columns == docs.columns
        assert all([r[name] for name in names] == kept for r in got)


def test_a_training_sample_moves_no_texts(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 2)] + [(5, 7)], "doc_id long, toxic int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = toxicity.labelled_texts(docs, labels, sample=40)
    finally:
        spark.conf.set(key, before)
    rows = found.collect()
    assert len(rows) == 40 and all(r.text == f"word{r.doc_id} " * 50 and r.toxic == 0 for r in rows)
    assert toxicity.labelled_texts(docs, labels.where("false")).count() == 0
    twice = docs.unionByName(docs.where("doc_id = 4"))
    assert toxicity.labelled_texts(twice, labels).where("doc_id = 4").count() == 2


def test_scores_are_a_noisy_or_of_sentences(spark):
    model = toxicity.ToxicityModel({"bad": 4.0, "awful": 2.5, "awfu*": 1.0, "kind": -3.0}, -3.0)
    texts = ["A bad day. A kind day!\nawful bad", "Nothing here", "", None, "AWFUL. awfully bad. bad bad", "kind." * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        clear, spans, at = 1.0, [], 0
        for piece in (text or "").lower().replace("!", ".").replace("\n", ".").split("."):
            words = {w for w in piece.split() if w.isalpha()}
            if words:
                known = {f for w in words for f in [w] + [w[:n] + "*" for n in (4, 5, 6) if len(w) > n]}
                z = model.bias + sum(model.weights.get(f, 0.0) for f in known)
                p = 1 / (1 + np.exp(-z))
                clear *= 1 - p
                if p >= toxicity.THRESHOLD:
                    spans.append((at, at + len(piece)))
            at += len(piece) + 1
        if not (text or "").strip():
            clear = 1 - 1 / (1 + np.exp(-model.bias))
        assert abs(got[i].score - (1 - clear)) < 1e-9
        assert [(s.start, s.end) for s in got[i].offending] == spans


def test_sql_of_decontamination_knows_short_odd_and_partial_matches(spark):
    import duckdb
    import pandas as pd
    from compare import rows_of

    from logsheaf.llm import oracle
    from logsheaf.llm.decontamination import contaminated

    text = "The old mill stands by the river where nobody has worked for a very long time"
    item = f"{text}. The wheel is broken and all of its boards have fallen into the water below. The end"
    sums = "Ann has 3 green pears and buys 5 more of the pears at a small shop in town today"
    items = [
        "What is 12 * 34 + 5 * 6 - 7?", "Name Paris", "水的沸点是多少,请回答",
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 km", "...", item, sums, None,
    ]
    docs = [
        "Now: what is 12 * 34 + 5 * 6 - 7? Go.", "What is 12 * 34 + 5 * 6 - 8?", "please name PARIS now",
        "name a city, Paris", "问题一水的沸点是多少,请回答", "水的冰点",
        "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 km and on", "2 3 4 5 6 7 8 9 9", item,
        item.replace("The wheel", "A wheel"), sums.replace("3", "4").replace("5", "4").replace("Ann", "Eve"),
        "Ann has 3 green pears and buys 3 more of the pears at a small shop in town today", None, "",
    ]
    got = contaminated(
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    )
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(enumerate(docs)), columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(list(enumerate(items)), columns=["item_id", "text"]))
    result = con.execute(oracle.DECONTAMINATION)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    rows = rows_of(got.columns, got.collect())
    assert rows == want and len(rows) == 8
