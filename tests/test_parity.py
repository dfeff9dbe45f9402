"""Every registered query has an oracle and matches it at sf0.001 (rows, columns, values)."""

import os

import pytest

import __spark_entry__ as E
from fleetlens.plans.catalog import QUERIES
from tests.parity import check

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    # the optional subpackage has queries that SQL cannot express
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_queries_match_duckdb(spark):
    results = check(spark, SF, list(E.oracle_sql()), verbose=False)
    bad = {k: v for k, v in results.items() if v[0] != "OK"}
    assert not bad


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["job_id", "job_name", "total_cost", "cost_share", "run_count", "avg_cost_per_run", "last_run_time"]


def test_no_python_or_pairwise_operators_in_any_plan(spark):
    """Every registered query stays JVM-side and never forms all pairs."""
    banned = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF")
    offenders = {}
    for name, fn in QUERIES.items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [b for b in banned if b in plan]
        if hits:
            offenders[name] = hits
    assert not offenders
