"""Registration of queries: name → plan, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctes import with_ctes
from .views import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "") -> Callable:
    """Register a function (spark, sf_dir) under its name; its doubles are rounded to six decimals.

    sql gives the same rows from the shared expressions; the columns named in `doubles` are rounded likewise.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            replace = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
            star = f"* REPLACE ({replace})" if replace else "*"
            SQL[f.__name__] = f"SELECT {star} FROM ({with_ctes(sql)}) AS result"
        return f

    return add

