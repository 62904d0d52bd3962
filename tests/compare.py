"""Compares each registered query with its SQL; run as a script or from pytest."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def compare(spark, query, sql, sf_dir):
    """(rows, problem) where problem is None on a full match."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None
    columns, rows = oracle_rows(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(columns)}"
    want = rows_of(columns, rows)
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return len(got), f"{len(got)} against {len(want)} rows; {only}"
    return len(got), None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from logsheaf import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, query, oracle.get(name), sf_dir)
        except Exception as error:
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{name:24} {rows:8} rows {time.time() - start:6.2f}s {problem or ('ok' if name in oracle else 'no sql')}", flush=True)
