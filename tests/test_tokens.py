import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsheaf import TokenConfig
from logsheaf.config import SPECIAL_TOKENS
from logsheaf.functions.tokens import session_tokens
from logsheaf.operators.chunks import assign_chunks, row_is_valid
from logsheaf.operators.encoding import attention_mask, decode, encode_sessions, tokenize, unknown_rate
from logsheaf.operators.ranking import with_position
from logsheaf.operators.vocabulary import (
    check_vocabulary,
    rank_tokens,
    special_ids,
    special_rows,
    token_counts,
)
from logsheaf.schemas import VOCABULARY
from logsheaf.session import materialize

EVENTS = "day int, session_id string, events array<struct<event_id:string,auth_type:string,logon_type:string>>"


@pytest.fixture(scope="module")
def vocabulary(spark):
    learned = [("4624_Kerberos_Network", 5), ("4768_NTLM_Interactive", 6)]
    learned += [(f"e{i}_A_B", 10 + i) for i in range(6)]
    return materialize(special_rows(spark).unionByName(spark.createDataFrame(learned, VOCABULARY)))


def sessions(spark, *event_lists):
    return spark.createDataFrame([(1, f"s{i}", events) for i, events in enumerate(event_lists)], EVENTS)


KERBEROS, NTLM = ("4624", "Kerberos", "Network"), ("4768", "NTLM", "Interactive")
SIX = [(f"e{i}", "A", "B") for i in range(6)]


def ids(spark, vocabulary, events, **config):
    row = tokenize(sessions(spark, events), vocabulary, TokenConfig(**config)).first()
    return row["input_ids"], row["attention_mask"], row["n_unknown"], row["n_events"]


def test_sequences(spark, vocabulary):
    assert ids(spark, vocabulary, [KERBEROS, NTLM], max_len=8)[0] == [0, 5, 6, 1, 3, 3, 3, 3]
    assert ids(spark, vocabulary, SIX, max_len=6)[0] == [0, 12, 13, 14, 15, 1]
    assert ids(spark, vocabulary, SIX, max_len=6, truncation_side="right")[0] == [0, 10, 11, 12, 13, 1]
    got = ids(spark, vocabulary, [KERBEROS], max_len=8)
    assert got[:2] == ([0, 5, 1, 3, 3, 3, 3, 3], [1, 1, 1, 0, 0, 0, 0, 0])
    assert ids(spark, vocabulary, [("9", "x", "y")], max_len=8)[0] == [0, 4, 1, 3, 3, 3, 3, 3]
    # Counts are taken before trimming.
    assert ids(spark, vocabulary, [("9", "x", "y")] + SIX, max_len=4)[2:] == (1, 7)
    assert ids(spark, vocabulary, [], max_len=4) == ([0, 1, 3, 3], [1, 1, 0, 0], 0, 0)
    assert ids(spark, vocabulary, None, max_len=4)[0] == [0, 1, 3, 3]


def test_id_types(spark, vocabulary):
    df = tokenize(sessions(spark, SIX), vocabulary, TokenConfig(max_len=5, token_id_dtype="int16"))
    assert df.schema["input_ids"].dataType.simpleString() == "array<smallint>"
    for bad in ({"max_len": 2}, {"truncation_side": "middle"}, {"min_freq": 0}, {"token_id_dtype": "uint8"}):
        with pytest.raises(ValueError):
            TokenConfig(**bad)


def test_mask_and_decode(spark, vocabulary):
    df = spark.createDataFrame([(1, "s", [5, 6, 123456]), (1, "t", [])], "day int, session_id string, input_ids array<int>")
    assert df.select(attention_mask(F.lit([5, 3, 0]), 3)).first()[0] == [1, 0, 1]
    got = {r["session_id"]: r["tokens"] for r in decode(df, vocabulary).collect()}
    assert got == {"s": ["4624_Kerberos_Network", "4768_NTLM_Interactive", "[UNK]"], "t": []}


def test_routes_agree(spark, vocabulary):
    draw = random.Random(1)
    lists = [[draw.choice(SIX + [KERBEROS, ("9", "x", None)]) for _ in range(draw.randrange(0, 30))] for _ in range(60)]
    data = sessions(spark, *lists).repartition(5)

    def rows(**limit):
        return sorted(map(str, encode_sessions(data, vocabulary, **limit).collect()))

    assert rows() == rows(max_bytes=0)
    rate = unknown_rate(encode_sessions(data, vocabulary)).first()
    assert rate["total_events"] == sum(map(len, lists))
    assert rate["unknown_events"] == sum(e[0] == "9" for events in lists for e in events)


def test_absent_and_null_fields(spark):
    df = spark.createDataFrame([([(None, "K")],)], "events array<struct<event_id:string,auth_type:string>>")
    assert df.select(session_tokens(df.schema)).first()[0] == ["None_K_NA"]


def test_ranking(spark):
    counts = [("b", 9), ("a", 9), ("c", 20), ("[PAD]", 50), ("rare", 4), ("z", 5)]
    df = spark.createDataFrame(counts, "token string, count bigint")
    got = {r["token"]: r["token_id"] for r in rank_tokens(df).collect()}
    assert got == {**{t: i for i, t in enumerate(SPECIAL_TOKENS)}, "c": 5, "a": 6, "b": 7, "z": 8}
    assert rank_tokens(df, size=7).count() == 7


def test_counts_over_sessions(spark):
    df = sessions(spark, [KERBEROS, KERBEROS], [KERBEROS, NTLM], None, [])
    assert {r["token"]: r["count"] for r in token_counts(df).collect()} == {
        "4624_Kerberos_Network": 3,
        "4768_NTLM_Interactive": 1,
    }


def test_checks(spark, vocabulary):
    check_vocabulary(vocabulary)
    with pytest.raises(ValueError):
        check_vocabulary(special_rows(spark))
    with pytest.raises(ValueError):
        check_vocabulary(vocabulary.unionByName(spark.createDataFrame([("x", 300)], VOCABULARY)), "uint8")
    with pytest.raises(ValueError):
        check_vocabulary(vocabulary.unionByName(spark.createDataFrame([("x", 5)], VOCABULARY)))
    with pytest.raises(ValueError):
        check_vocabulary(vocabulary.where("token <> '[MASK]'"))
    with pytest.raises(ValueError):
        special_ids(vocabulary.where("token <> '[MASK]'"))
    with pytest.raises(ValueError):
        special_rows(spark, ["[CLS]", "[CLS]"])


def test_positions(spark):
    draw = random.Random(2)
    values = draw.sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 5 + 1) for v in values], "v int, n int").repartition(9)
    got = {r["v"]: r["position"] for r in with_position(df, F.desc("v")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, reverse=True))}
    weighted = {r["v"]: r["position"] for r in with_position(df, F.col("v"), weight="n").collect()}
    before = 0
    for v in sorted(values):
        assert weighted[v] == before
        before += v % 5 + 1
    assert with_position(df.where("v < 0"), F.col("v")).count() == 0


def test_chunks(spark):
    df = spark.range(7).select(F.col("id").cast("string").alias("session_id"))
    got = sorted((r["session_id"], r["chunk"]) for r in assign_chunks(df, 3, F.col("session_id")).collect())
    assert [c for _, c in got] == [0, 0, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        assign_chunks(df, 0, F.col("session_id"))


def test_row_checks(spark):
    ddl = "session_id string, input_ids array<int>, attention_mask array<tinyint>"
    rows = [("a", [1, 2], [1, 1]), (None, [1, 2], [1, 1]), ("b", [1], [1, 1]), ("c", [1, 2], None)]
    df = spark.createDataFrame(rows, ddl).coalesce(1)
    assert [r[0] for r in df.select(row_is_valid(2)).collect()] == [True, False, False, False]
