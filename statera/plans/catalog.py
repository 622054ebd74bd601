"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the domain under ``name``; ``sql`` is DuckDB SQL over the domain views."""

    def register(plan: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Domain(spark, sf_dir))

        run.__name__, run.__doc__ = name, plan.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return plan

    return register
