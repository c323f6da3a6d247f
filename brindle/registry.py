"""Named queries and the SQL text each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a SQL text; without ``oracle`` the same text is the oracle."""
    query(name, oracle or re.sub(r"{(\w+)}", r"\1", text))(lambda t: t.sql(text))


def column_query(name: str, table: str, key: str, expr: str, oracle: str | None = None) -> None:
    """Register ``SELECT key, expr AS v FROM table`` over the whole table."""

    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(*[k.strip() for k in key.split(",")], F.expr(expr).alias("v"))

    query(name, f"SELECT {key}, {oracle or expr} AS v FROM {table}")(run)
