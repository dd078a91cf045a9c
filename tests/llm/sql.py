"""Compares a query with its SQL on the smallest tables."""
from tools.check_oracle import compare, duck
from tracewell.llm import queries

SMOKE = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder=SMOKE):
    problem, rows, _ = compare(spark, duck(folder), folder, name, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None, problem
    return rows
