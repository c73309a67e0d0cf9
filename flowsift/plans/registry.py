"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsift.session import DEFAULTS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_RUNTIME = [
    "spark.sql.session.timeZone",
    "spark.sql.execution.arrow.pyspark.enabled",
    "spark.sql.optimizer.windowGroupLimitThreshold",
]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is what DuckDB must answer on the same tables."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for setting in _RUNTIME:
                spark.conf.set(setting, DEFAULTS[setting])
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
