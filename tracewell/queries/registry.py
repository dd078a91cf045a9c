"""Named queries and, where DuckDB can express them, their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell import session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            session.configure(spark)
            return run(spark, folder)
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = configured
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register
