"""Conversation repair, prefix trie and nearest neighbours against plain versions."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import plain
import pytest

from logsheaf.llm import conversation_repair, prefix_trie, workload
from logsheaf.llm.collision_search import nearest

SF_DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
absent = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def read(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()]


def odd_turns():
    """Null ids, turns, roles and texts, repeats, ties and a long conversation."""
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "unknown", "tool", None, ""]
    texts = ["Yes.", "no", None, "", " \t ", "Why? ", "Über. ", "a" * 70_000 + "!", "{x}"]
    rows = [
        (rnd.choice([None, 0, 7, 100, 101, 107, 199, 205, -3, -103]), rnd.choice([None, *range(6)]),
         rnd.choice(roles), rnd.choice(texts))
        for _ in range(300)
    ]
    return rows + rows[:20] + [(300, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(2000)]


def summary(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


# ----- Repair -----


def test_strings_against_every_edit():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(4)
        roles = [rnd.choice(["system", "user", "assistant", "tool"]) for _ in range(n)]
        kinds = [rnd.choice([None, None, "blank", "duplicate", "truncated"]) for _ in range(n)]
        cost, audit, final = plain.by_strings(roles, kinds)
        want = plain.cheapest(roles, kinds)
        assert (cost, audit, [role for _, role in final]) == (want[0], want[1], want[2])


@pytest.mark.parametrize("modulus", [conversation_repair.MODULUS, 7, 1])
@pytest.mark.parametrize("settle", [4, 512])
def test_shared_edits_against_strings(monkeypatch, modulus, settle):
    """Small moduli make every hash collide."""
    monkeypatch.setattr(conversation_repair, "SETTLE_ROWS", settle)
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(40)
        roles = [rnd.choice(["system", "user", "user", "assistant", "tool", ""]) for _ in range(n)]
        kinds = [rnd.choice([None] * 4 + ["blank", "duplicate", "truncated"]) for _ in range(n)]
        repair, given = conversation_repair.Repair(modulus), []
        for role, kind in zip(roles, kinds):
            given += repair.feed(role[:1], kind, (None, role, "t", kind))
        given += repair.finish()
        cost, audit, final = plain.by_strings(roles, kinds)
        assert "".join(g[0] for g in given) == audit
        assert sum(conversation_repair._entry(0, 0, *g)[3] for g in given) == cost
        assert [g[1] for g in given if g[0] != "D"] == [role for _, role in final]


def test_long_conversations_are_given_out_early():
    repair, given = conversation_repair.Repair(), []
    for i in range(20_000):
        role = ("user", "assistant")[i % 2] if i % 97 else "tool"
        given += repair.feed(role[:1], None, (i, role, "t", None))
        assert len(repair.turns) <= 2 * conversation_repair.SETTLE_ROWS
    assert len(given) + len(repair.finish()) >= 20_000


@absent
def test_repair_query(spark):
    got = workload.op11_conversation_repair(spark, SF_DIR).collect()
    assert summary(got) == plain.repaired(read(spark, "conversations")) and got


def test_repair_of_odd_rows(spark):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    log = conversation_repair.repair(workload.damaged(turns), lost="lost")
    assert summary(conversation_repair.summaries(log).collect()) == plain.repaired(rows)
    for conv, own in log.toPandas().groupby("conv_id", dropna=False):
        kept = own[own.edit.isin(["K", "R", "I"])].sort_values("position")
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in kept.role))


def test_repair_of_lost_conversations_and_empty_tables(spark):
    rows = [(1, i, "user", "x.", True) for i in range(3)] + [(2, 0, "user", "x.", False)]
    turns = spark.createDataFrame(rows, TURNS + ", lost boolean")
    empty = conversation_repair.hashlib.sha256(b"").hexdigest()
    got = summary(conversation_repair.summaries(conversation_repair.repair(turns, lost="lost")).collect())
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2] == (0, 0, 0, 0, 0, 2, "D", empty)
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.summaries(conversation_repair.repair(none)).collect() == []


def test_repair_ignores_other_columns(spark):
    rows = [(1, 0, "user", "a.", 5, 6, 7, 8), (1, 1, "assistant", "b", 5, 6, 7, 8)]
    turns = spark.createDataFrame(rows, TURNS + ", held int, hash int, seen int, fault int")
    got = [(r.edit, r.cost, r.fault) for r in conversation_repair.repair(turns).collect()]
    assert got == [("D", 2, None), ("D", 2, "truncated")]


# ----- Trie -----


@pytest.mark.parametrize("size", [1, 2, 5, 63, 64, 300, 3000])
def test_parentheses(size):
    rnd = random.Random(size)
    for kind in range(6):
        depths = [0]
        while len(depths) < size:
            low = max(1, depths[-1] - rnd.choice([0, 1, 1, 50]))
            depths.append(rnd.randint(low, depths[-1] + 1) if depths[-1] else 1)
        if kind < 2:
            depths = list(range(size)) if kind else [0] + [1] * (size - 1)
        shape, open_, want = prefix_trie.Parentheses(np.array(depths)), [], {}
        for place, bit in enumerate(shape.bits):
            if bit:
                open_.append(place)
            else:
                want[open_.pop()] = place
        close = shape.findclose()
        assert [want[o] for o in shape.opens] == list(close)
        before = shape.leaves_before()
        text = "".join("()"[not b] for b in shape.bits)
        for o, c in list(zip(shape.opens, close))[:50]:
            assert before[c] - before[o] == text[o : c + 1].count("()")


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@absent
def test_trie_query(spark):
    got = nodes(workload.op13_prefix_trie(spark, SF_DIR))
    assert got == plain.trie(read(spark, "conversations")) and got


@pytest.mark.parametrize("shard", [3, 40, 1 << 17])
@pytest.mark.parametrize("ids", [2, 4096])
def test_trie_of_odd_rows(spark, monkeypatch, shard, ids):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", ids)
    rnd = random.Random(6)
    rows = [
        (rnd.choice([None, *range(-5, 30), 100, 101, 150, 250]), rnd.choice([None, *range(4)]),
         rnd.choice(["u", "a", None]), rnd.choice(["x", "", None, "ü€"]))
        for _ in range(200)
    ]
    rows += rows[:9] + [(i, 0, "u", "hi") for i in range(400, 460)]
    rows += [(i, t, "u", "long" * (t + 1)) for i in range(480, 483) for t in range(40)]
    # Workers read the limit from the module, so it goes into a fresh function.
    shards = prefix_trie._shards

    def small_shards(batches):
        prefix_trie.SHARD_NODES = shard
        return shards(batches)

    monkeypatch.setattr(prefix_trie, "_shards", small_shards)
    got = nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(7)))
    assert got == plain.trie(rows)


def test_trie_of_an_empty_table_and_other_columns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(1, 0, "user", "a", 5, 6, 7), (2, 0, "user", "a", 5, 6, 7)]
    turns = spark.createDataFrame(rows, TURNS + ", path int, own int, first int")
    assert nodes(prefix_trie.prefix_trie(turns)) == plain.trie([r[:4] for r in rows])


# ----- Search -----

VECTORS = "vec_id long, embedding array<float>"


def held_against(got, want, ids):
    """Recall; every score and order is checked."""
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
    hits = total = 0
    for i, best in want.items():
        found = by_query.get(ids[i], [])
        assert len(found) == len(best)
        assert found == sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        hits += len(set(found) & set(best))
        total += len(best)
    return hits / max(1, total)


@absent
def test_search_query(spark):
    rows = [(r[0], list(r[1])) for r in read(spark, "embeddings")]
    got = workload.op12_nearest_neighbours(spark, SF_DIR).collect()
    assert held_against(got, plain.neighbours(rows), [r[0] for r in rows]) >= 0.98


def test_search_with_a_small_sample_and_blocks(spark, monkeypatch):
    from logsheaf.llm import collision_search

    monkeypatch.setattr(collision_search, "SAMPLE_VALUES", 16 * 100)
    monkeypatch.setattr(collision_search, "BLOCK_ROWS", 150)
    rnd = np.random.default_rng(7)
    points = rnd.standard_normal((900, 16))
    points[300:600] = points[0]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert held_against(got.collect(), plain.neighbours(rows), range(900)) >= 0.95


def test_search_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]),
        (50, [3.0]), (100, [-1.0, 0.0]), (3, [4.0, 0.0]),
    ]
    got = nearest(spark.createDataFrame(rows, VECTORS + ""))
    assert held_against(got.collect(), plain.neighbours(rows), [r[0] for r in rows]) == 1
    assert {r.query_id for r in got.collect()} == {0, 100}
    assert nearest(spark.createDataFrame([], VECTORS)).collect() == []
    assert nearest(spark.createDataFrame([(50, [1.0])], VECTORS)).collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0]), (2, [1.0])], VECTORS)).collect() == []


def test_search_of_repeated_ids_and_other_columns(spark):
    rows = [(50, [1.0, 0.5], 1, 2, 3), (50, [1.0, 0.5], 1, 2, 3), (1, [0.5, 1.0], 1, 2, 3)]
    table = spark.createDataFrame(rows, VECTORS + ", row int, block int, dim int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(table).collect())
    assert got == [(50, 1, 50), (50, 1, 50), (50, 2, 1), (50, 2, 1)]
