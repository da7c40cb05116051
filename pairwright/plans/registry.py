"""The named queries and, where SQL can say it, what each must return."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pairwright.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name together with its SQL equivalent."""

    def register(function: Query) -> Query:
        @wraps(function)
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = configured
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
