"""Names, callables and comparison SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.binding import Tables, with_tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Register a query; ``sql`` is its comparison over the bound tables."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_tables(sql, tables)
        return fn

    return add


def portable(df: DataFrame) -> DataFrame:
    """Plain result types: money as double, dates and times as text, flags as 0 or 1."""
    out = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(field.name))
    return df.select(*out)


def runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: portable(fn(Tables(spark, folder)))
