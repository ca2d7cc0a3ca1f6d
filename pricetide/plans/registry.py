"""Registry of runnable queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with its checking SQL if there is one.

    Queries read and print instants in UTC whatever zone the caller's session has.
    """
    def add(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def ts_text(col: Column | str) -> Column:
    """Timestamps leave a query as text, so no engine's zone handling takes part in a comparison."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def r(col: Column, places: int = 4) -> Column:
    """Rounded, with negative zero made plain."""
    return F.round(col, places) + F.lit(0.0)
