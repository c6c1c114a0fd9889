import pytest
from oracle import SF, check

import __spark_entry__ as entry
from millrace.plans import data_queries, flow_queries, record_queries, text_queries

QUERIES = {k: q for p in (text_queries, data_queries, flow_queries, record_queries) for k, q in p.QUERIES.items()}
ORACLES = {k: s for p in (text_queries, data_queries, flow_queries, record_queries) for k, s in p.ORACLES.items()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_duckdb(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
