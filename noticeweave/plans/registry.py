"""Named queries over the driver's tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeweave.plans.domain import SQL, Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *, domain: bool = True) -> Callable:
    """Registers a function of Domain under its name; sql goes on after the domain's tables, or stands alone."""

    def register(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = SQL + sql if domain else sql
        return f

    return register
