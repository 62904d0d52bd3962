import random

import pytest
from pyspark.sql import functions as F

from logsheaf.functions.masking import with_masked
from logsheaf.operators.joins import lookup_join
from logsheaf.operators.merging import extend_merged, merge_similar, resolved, with_leaf
from logsheaf.operators.templates import (
    MESSAGE_FIELDS,
    auth_message,
    enrich,
    mine_signatures,
    mine_templates,
    template_count,
    template_params,
    with_auth_signature,
    with_signature,
)
from logsheaf.session import materialize

DDL = ", ".join(f"{name} string" for name in MESSAGE_FIELDS)


def test_masks(spark):
    text = (
        "from 10.0.0.1 mail a.b+c@ex-ample.org hash 0123456789abcdef0123456789ABCDEF "
        "at 2024-01-02 03:04:05 user=Zoë src_user=U1"
    )
    df = spark.createDataFrame([(text,)], "m string")
    got = with_masked(df, F.col("m")).first()["masked"]
    assert got == "from <IP> mail <EMAIL> hash <HASH> at <TIMESTAMP> <USER> src_user=U1"


def test_message_defaults(spark):
    df = spark.createDataFrame([("U1", None)], "src_user string, auth_type string")
    assert df.select(auth_message(df.columns)).first()[0] == (
        "src_user=U1 dst_user=UNKNOWN src_computer=UNKNOWN dst_computer=UNKNOWN auth_type=UNKNOWN "
        "logon_type=UNKNOWN auth_orientation=UNKNOWN success=UNKNOWN"
    )


@pytest.mark.parametrize("keep", [(), ("logon_type",)])
def test_quick_signature_equals_general(spark, keep):
    draw = random.Random(3)
    pool = [
        "U1", "Kerberos", "", None, "a b", "10.0.0.1", "x@y.org", "x@DOM1", "user=bob", "0" * 32, "f" * 31,
        "2024-01-02 03:04:05", "a:1", "A\tB", "ANONYMOUS LOGON@C1", "Zoë", "٣", "a|b", "f" * 40 + "g", "-user=1",
    ]
    rows = [tuple(draw.choice(pool) for _ in MESSAGE_FIELDS) for _ in range(1500)]
    df = spark.createDataFrame(rows, DDL)
    quick = with_auth_signature(df, "quick", keep)
    both = with_signature(quick, auth_message(df.columns), "general", keep_digit_tokens=keep)
    assert both.where(~F.col("quick").eqNullSafe(F.col("general"))).collect() == []


def pair(spark):
    tail = ("Kerberos", "Network", "LogOn", "Success")
    df = spark.createDataFrame([("U1", "U2", "C1", "C2", *tail), ("U3", "U4", "C3", "C4", *tail)], DDL)
    return with_auth_signature(df.withColumn("time", F.lit(1)))


def test_ids_stay_over_runs(spark):
    events = pair(spark)
    first = materialize(mine_templates(events))
    assert template_count(first).first()[0] == 1
    again = mine_templates(events, first)
    assert [r["template_id"] for r in again.collect()] == [1]
    other = events.withColumn("signature", F.concat("signature", F.lit(" more")))
    grown = materialize(mine_templates(other.withColumn("time", F.lit(0)), first))
    assert sorted((r["template_id"], r["n_tokens"]) for r in grown.collect()) == [(1, 8), (2, 9)]


def test_enrich_and_fallback(spark):
    events = pair(spark)
    templates = materialize(mine_templates(events))
    unknown = events.withColumn("signature", F.lit("never seen"))
    got = enrich(events.unionByName(unknown), templates).select("template_id", "event_id").collect()
    assert sorted(map(tuple, got)) == [(-1, "UNK"), (-1, "UNK"), (1, "1"), (1, "1")]


def test_params(spark):
    text = "login user=bob from addr=10.0.0.1 at 2024-01-02 03:04:05 pid 77"
    df = with_signature(spark.createDataFrame([(text,)], "m string"), F.col("m"))
    row = df.select("signature", template_params(F.col("m"), F.col("signature")).alias("p")).first()
    assert row["signature"] == "login <USER> from addr=<IP> at <TIMESTAMP> pid <*>"
    assert row["p"] == ["user=bob", "10.0.0.1", "2024-01-02 03:04:05", "77"]


def test_lookup_of_a_large_table_equals_broadcast(spark):
    draw = random.Random(5)
    large = spark.createDataFrame(
        [(i, draw.choice(["hot"] * 8 + ["a", "b", "none", None])) for i in range(400)], "i int, k string"
    )
    small = materialize(spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "k string, v int"))
    want = sorted(map(str, lookup_join(large, small, "k").select("i", "k", "v").collect()))
    large = large.withColumn("m", F.create_map(F.lit("any"), "i"))
    shuffled = lookup_join(large, small, "k", max_bytes=0).select("i", "k", "v")
    assert sorted(map(str, shuffled.collect())) == want
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def merge_all_pairs(signatures, similarity):
    """Templates of what similar pairs connect, from all pairs; signatures: (first_seen, text)."""
    texts = [text for _, text in sorted(signatures)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = [text.split(" ") for text in texts]
    for i, a in enumerate(words):
        for j in range(i):
            same = sum(x == y != "<*>" for x, y in zip(a, words[j]))
            if len(a) == len(words[j]) and same >= similarity * len(a):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    found = {}
    for i, text in enumerate(texts):
        group = [words[j] for j in range(len(texts)) if find(j) == find(i)]
        merged = " ".join(c[0] if len(set(c)) == 1 else "<*>" for c in zip(*group))
        found[text] = (merged, find(i))
    order = {leader: n + 1 for n, leader in enumerate(sorted({g for _, g in found.values()}))}
    return {text: (merged, order[leader]) for text, (merged, leader) in found.items()}


def test_merge_matches_all_pairs(spark):
    draw = random.Random(9)
    for letters, places in (("abcdefgh", 7), ("abcdefghijkl", 5)):
        texts = {" ".join(["<*>"] + [draw.choice(letters) for _ in range(places)]) for _ in range(120)}
        rows = [(text, draw.randrange(40), 1) for text in texts]
        df = spark.createDataFrame(rows, "signature string, first_seen bigint, n_events bigint")
        got = {r["signature"]: (r["template"], r["template_id"]) for r in merge_similar(df).collect()}
        assert got == merge_all_pairs([(s, t) for t, s, _ in rows], 0.4)
    assert merge_similar(df.where("false")).count() == 0


def test_signatures_combine(spark):
    mined = mine_signatures(pair(spark)).collect()
    assert [(r["n_events"], r["first_seen"]) for r in mined] == [(2, 1)]


SIGNATURES = "signature string, first_seen bigint, n_events bigint"


def test_merge_of_long_messages(spark, monkeypatch):
    """Too many sets for one listing: lists grow only where nodes stay apart."""
    from logsheaf.operators import merging

    draw = random.Random(12)
    for keys, places, letters in ((128, 14, "abcd"), (1, 5, "abcd")):
        monkeypatch.setattr(merging, "KEYS", keys)
        texts = {" ".join(["x"] + [draw.choice(letters) for _ in range(places)]) for _ in range(60)}
        rows = [(text, draw.randrange(40), 1) for text in texts]
        df = spark.createDataFrame(rows, SIGNATURES)
        got = {r["signature"]: (r["template"], r["template_id"]) for r in merge_similar(df, 0.7).collect()}
        assert got == merge_all_pairs([(s, t) for t, s, _ in rows], 0.7)


def test_pages_just_below_the_threshold_form_no_pairs(spark):
    """Many messages with most places equal and yet unlike: lists stay in proportion."""
    from logsheaf.operators.merging import similar_links

    n = 600
    texts = [f"t a b c d p{i} q{i} r{i} s{i} u{i}" for i in range(n)]
    rows = spark.createDataFrame([(i, "l", t.split(" "), True) for i, t in enumerate(texts)],
                                 "node bigint, leaf string, tokens array<string>, fresh boolean")
    assert similar_links(materialize(rows), 0.6).count() == 0
    assert similar_links(materialize(rows), 0.5).count() == n - 1


def test_first_children_keep_their_place(spark):
    rows = [(f"w{i} x", i // 2, 1) for i in range(9)] + [("<*> x", 0, 1), ("w0", 5, 1), ("w1 y", 9, 1)]
    df = spark.createDataFrame(rows, SIGNATURES)
    leaves = {r["signature"]: r["leaf"] for r in with_leaf(df, 1, 4).collect()}
    assert {s for s, leaf in leaves.items() if leaf == "2 <*>"} == {f"w{i} x" for i in range(3, 9)} | {"<*> x"}
    assert leaves["w1 x"] == leaves["w1 y"] == "2 w1" and leaves["w0"] == "1 w0"
    deep = {r["leaf"] for r in with_leaf(df, 2, 2).collect()}
    assert deep == {"2 w0 x", "2 <*> x", "2 <*> <*>", "1 w0 "}


def two_runs(first, second, similarity):
    """Ids after two runs, from all pairs; signatures: (first_seen, text)."""
    known = {text: number for text, (_, number) in merge_all_pairs(first, similarity).items()}
    new = [s for s in second if s[1] not in known]
    whole = merge_all_pairs(first + new, similarity)
    groups = {}
    for seen, text in sorted(first + new):
        groups.setdefault(whole[text][1], []).append((seen, text))
    ids, following, present = dict(known), max(known.values()), {}
    for _, own in sorted(groups.items(), key=lambda g: min(g[1])):
        old = [known[text] for _, text in own if text in known]
        if not old:
            following += 1
        number = min(old) if old else following
        for _, text in own:
            ids.setdefault(text, number)
            present[text] = (number, whole[text][0])
    return ids, present


def test_runs_extend_clusters(spark):
    draw = random.Random(21)
    texts = list({" ".join(["<*>"] + [draw.choice("abcdefghijkl") for _ in range(5)]) for _ in range(150)})
    first = [(draw.randrange(9), t) for t in texts[:40]]
    second = [(9 + draw.randrange(9), t) for t in texts[20:]]

    def mined(rows):
        return spark.createDataFrame([(t, s, 1) for s, t in rows], SIGNATURES)

    none = spark.createDataFrame([], "template_id int, merged_into int")
    known = materialize(extend_merged(mined(first), None, None)[0])
    fresh, met = (materialize(t) for t in extend_merged(mined(second), known, none))
    stored = materialize(known.unionByName(fresh))
    ids, present = two_runs(first, second, 0.4)
    assert {r["signature"]: r["template_id"] for r in stored.collect()} == ids
    assert met.count() > 0
    got = {r["signature"]: (r["template_id"], r["template"]) for r in resolved(stored, met).collect()}
    assert got == present
    # Nothing new: no id moves, and no alias is added.
    again = extend_merged(mined(second), stored, met)
    assert again[0].count() == again[1].count() == 0
    # A bridge between two clusters makes one the alias of the other, and of its aliases.
    apart = [(0, "<*> a a a z z"), (1, "<*> b b b y y"), (2, "<*> c c c x x")]
    known, aliases = materialize(extend_merged(mined(apart), None, None, 0.3)[0]), none
    for bridge in ((3, "<*> b b b x x"), (4, "<*> b b b z z"), (5, "<*> a a a y y")):
        fresh, met = extend_merged(mined([bridge]), known, aliases, 0.3)
        known, aliases = (materialize(a.unionByName(b)) for a, b in ((known, fresh), (aliases, met)))
    present = {r["signature"]: r["template_id"] for r in resolved(known, aliases).collect()}
    assert set(present.values()) == {1}
