from pyspark.sql import functions as F

from logsheaf.functions.identity import host_key, pseudonym, user_key
from logsheaf.functions.text import floor_div, parse_int, strip


def one(spark, values, expression, ddl="x string"):
    df = spark.createDataFrame([(v,) for v in values], ddl).coalesce(1)
    return [row[0] for row in df.select(expression).collect()]


def test_strip_follows_python(spark):
    values = [" a ", " b　", "\x1c\x85c\x0b", "​d", "", "  ", "e\tf"]
    assert one(spark, values, strip(F.col("x"))) == [v.strip() for v in values]


def test_parse_int_follows_python(spark):
    values = ["12", " +7\n", "-3", "1_000", "_1", "1__0", "12.5", "1e3", "", "x", " 9 ", "-1_0"]

    def expected(text):
        try:
            return int(text)
        except ValueError:
            return None

    assert one(spark, values, parse_int(F.col("x"))) == [expected(v) for v in values]


def test_floor_div_rounds_down(spark):
    values = [-86401, -86400, -1, 0, 1, 86399, 86400]
    assert one(spark, values, floor_div(F.col("x"), 86400), "x bigint") == [v // 86400 for v in values]


def test_pseudonym(spark):
    got = one(spark, ["alice", " alice ", None, "   ", " "], pseudonym(F.col("x")))
    assert got[0] == got[1] and len(got[0]) == 8
    assert got[2:] == ["UNKNOWN"] * 3


def test_identity_fallback_keeps_both_unknowns(spark):
    rows = [(None, None, 0), ("", "  ", 0), ("  ", "bob", 0), ("", "bob", 5)]
    df = spark.createDataFrame(rows, "user string, src_user string, src_host int").coalesce(1)
    got = df.select(user_key(df.schema).alias("u"), host_key(df.schema).alias("h")).collect()
    # The absent identity hashes the word; a blank one is the literal.
    assert [r["u"] for r in got][:3] == ["23759997", "UNKNOWN", "UNKNOWN"]
    assert got[0]["h"] == got[1]["h"] == "23759997"
    assert got[3]["h"] != "23759997"
