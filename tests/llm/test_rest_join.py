"""What stays apart in a bucket of the Jaccard join meets by classes."""

import random

import pytest
from pyspark.sql import functions as F

from brute import components, shingles
from logsheaf.llm import jaccard_join
from logsheaf.llm.jaccard_join import near_duplicates


def pages(count, shared, own, seed):
    """Texts that share one passage and differ in the words after it."""
    words = " ".join(f"t{at}" for at in range(shared))
    rng = random.Random(seed)
    return [words + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(own)) for _ in range(count)]


def held(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == components({at: shingles(text) for at, text in enumerate(texts)})


@pytest.mark.parametrize("heavy, block, grams", [(64, 4096, 2_000_000), (2, 3, 2_000_000), (3, 2, 10)])
def test_mixed_groups(spark, monkeypatch, heavy, block, grams):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "GRAMS", grams)
    rng, texts = random.Random(3), pages(25, 100, 14, 1) + pages(12, 100, 10, 2)
    paragraphs = [" ".join(f"p{p}_{at}" for at in range(12)) for p in range(12)]
    for _ in range(60):
        texts.append(" ".join(rng.sample(paragraphs, rng.randrange(5, 11))))
    for base in rng.sample(texts, 12):
        for _ in range(rng.randrange(1, 7)):
            words = base.split()
            words[rng.randrange(len(words))] = f"new{rng.random()}"
            texts.append(" ".join(words[: len(words) - rng.randrange(12)]))
    held(spark, texts + [None, "", "one two", "one two"])


def test_pages_below_the_threshold_never_meet(spark, monkeypatch):
    """2,000 pages of likeness 0.77: neither classes nor members of a bucket are paired by the square."""
    seen, rows = [], []
    pairs, rest = jaccard_join._class_pairs, jaccard_join._unconnected

    def counted(classes):
        found = pairs(classes)
        seen.append((classes.count(), found.count()))
        return found

    def listed(labelled):
        found = rest(labelled)
        rows.append((labelled.count(), found.count()))
        return found

    monkeypatch.setattr(jaccard_join, "_class_pairs", counted)
    monkeypatch.setattr(jaccard_join, "_unconnected", listed)
    texts = pages(2000, 100, 14, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_duplicates(docs)
    assert found.where(F.col("component_id") != F.col("doc_id")).count() == 0
    assert rows[0][0] >= 2000 and rows[0][1] == 0
    assert seen[0][1] <= 10 * seen[0][0] <= 2000
