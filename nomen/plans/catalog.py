"""Registry of the queries the driver runs: name -> (spark_fn, oracle_sql).

``spark_fn(spark, sf_dir) -> DataFrame``; ``oracle_sql`` is DuckDB SQL over
the pre-registered table views, or ``None`` when the operator is not
SQL-expressible (rows-only check). Column names match on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from nomen.plans import queries  # noqa: F401
