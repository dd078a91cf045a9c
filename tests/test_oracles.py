"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

FOLDER = entry.SMOKE_DIR


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def names():
    return sorted(entry.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, connection, name):
    problem, rows, _ = compare(spark, connection, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
