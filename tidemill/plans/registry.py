"""Registered queries, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from tidemill.functions.columns import stable_round

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    """Registers a query; its result is brought to display form."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for display, whole numbers as bigint."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(stable_round(c.cast("double"), digits).alias(field.name))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def r(expression: str, alias: str | None = None, digits: int = DIGITS) -> str:
    """SQL twin of the display rounding."""
    scale = f"1e{digits}"
    text = f"floor(({expression}) * {scale} + 0.50003141) / {scale}"
    return f"{text} AS {alias}" if alias else text


def rs(*columns: str) -> str:
    """Rounded select list; ``name`` or ``name=expression``."""
    parts = []
    for c in columns:
        name, _, expression = c.partition("=")
        parts.append(r(expression or name, name.strip()))
    return ", ".join(parts)
