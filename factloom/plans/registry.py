"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.adapters import Tables, with_adapters
from factloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of Tables; `oracle` is DuckDB SQL over base tables and adapters."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_adapters(oracle)
        return f

    return add
