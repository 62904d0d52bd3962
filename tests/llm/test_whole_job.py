"""Cases that earlier versions left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsheaf.llm import language, toxicity
from logsheaf.llm.decontamination import contaminated
from logsheaf.llm.tables import small


def pairs(spark, docs, items):
    found = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_changed) for r in found.collect()}


def test_items_of_numbers_and_short_items(spark):
    items = [
        (0, "What is 12 * 34 + 5 * 6 - 7?"),
        (1, "Name Paris"),
        (2, "水的沸点是多少,请回答"),
        (3, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 km"),
        (4, "..."),
    ]
    docs = [
        (1, "Now: what is 12 * 34 + 5 * 6 - 7? Go."),
        (2, "What is 12 * 34 + 5 * 6 - 8?"),
        (3, "please name PARIS now"),
        (4, "name a city, Paris"),
        (5, "问题一水的沸点是多少,请回答"),
        (6, "水的冰点"),
        (7, "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 km and on"),
        (8, "2 3 4 5 6 7 8 9 9"),
    ]
    assert pairs(spark, docs, items) == {(1, 0): (1, 0), (3, 1): (1, 0), (5, 2): (3, 0), (7, 3): (8, 0)}


def test_one_changed_slot_keeps_the_rest(spark):
    text = "The old mill stands by the river where nobody has worked for a very long time"
    item = f"{text}. The wheel is broken and all of its boards have fallen into the water below. The end"
    sums = "Ann has 3 green pears and buys 5 more of the pears at a small shop in town today"
    items = [(0, item), (1, sums)]
    docs = [
        (1, item),
        (2, item.replace("The wheel", "A wheel")),
        (3, sums.replace("3", "4").replace("5", "4").replace("Ann", "Eve")),
        (4, "Ann has 3 green pears and buys 3 more of the pears at a small shop in town today"),
    ]
    found = pairs(spark, docs, items)
    assert set(found) == {(1, 0), (2, 0), (3, 1), (4, 1)}
    assert found[2, 0][1] == 0 and found[3, 1][1] == 3


def test_language_of_long_and_mixed_runs(spark):
    assert language.words_of("ab" * 50 + " c") == ["ab" * 20, "ab" * 20, "ab" * 10, "c"]
    assert language.words_of("日本語をabc人々") == ["日本語", "を", "abc", "人々"]
    assert language.words_of("eﬃcient обʼєкт") == ["eﬃcient", "обʼєкт"]
    rows = [("the cat and the dog were with the other cats", "en"), ("собака и кошка были тут вместе", "ru")]
    model = language.train(spark.createDataFrame(rows * 5, "text string, lang string"))
    glued = [(1, "the" * 10 + "собакаикошка" * 20), (2, "собака" * 5 + "theotherdog" * 20)]
    found = language.identify(spark.createDataFrame(glued, "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "ru", 2: "en"}


def test_toxicity_of_capitals_with_a_dotted_capital_i(spark):
    assert all(len(toxicity.lowered(chr(c))) == 1 for c in range(0x110000))
    model = toxicity.ToxicityModel({"idiot": 9.0, "nasty": 9.0}, -6.0)
    texts = ["YOU NASTY THING. fine", "İ YOU NASTY THING. fine", "fine. İDIOT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(found[i].predicted == 1 for i in range(3))
    assert [(s.start, s.end) for i in range(3) for s in found[i].offending] == [(0, 15), (0, 17), (5, 11)]


def test_training_sample_is_bounded(spark):
    rows = [(i, "one text of very many rows", 0) for i in range(300)] + [(300 + i, f"text {i}", 1) for i in range(600)]
    docs = spark.createDataFrame([*rows, *[(None, "same", 0)] * 300], "doc_id long, text string, label int")
    found = language.bounded_sample(docs, 400).toPandas()
    assert len(found) == 400 and 60 < (found.text == "one text of very many rows").sum() < 200
    assert found[found.text.str.startswith("text")].text.is_unique
    equal = spark.createDataFrame([("same", 0)] * 50, "text string, label int")
    assert language.bounded_sample(equal, 20).count() == 20
    assert language.bounded_sample(equal, 50).count() == 50


def test_lists_count_in_what_is_broadcast(spark):
    table = spark.range(3).withColumn("spans", F.array_repeat(F.lit(1), 10))
    few, many = small(table, 40, F.size("spans")), small(table, 20, F.size("spans"))
    hinted = ["ResolvedHint" in t._jdf.queryExecution().analyzed().toString() for t in (few, many)]
    assert hinted == [True, False]
    assert many.count() == 3
