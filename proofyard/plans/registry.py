"""Where queries and their SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, python: bool = False):
    """Register a function (spark, sf_dir) under its name; `sql` may use the fixtures as f_<name>. `python`: its plan
    runs code of this package on the executors."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run if python else f
        if sql is not None:
            ORACLE_SQL[f.__name__] = fixtures.sql(sql)
        return f

    return put
