import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from compare import compare
from logsheaf.plans import oracle, workload

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")
ORACLE = oracle.oracle_sql()


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query_matches_sql(spark, name):
    rows, problem = compare(spark, workload.QUERIES[name], ORACLE.get(name), SF_DIR)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(workload.QUERIES) <= set(entry.queries())
    assert set(workload.QUERIES) == set(ORACLE)
