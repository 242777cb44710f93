"""Sorting, paging and combining tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topk(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a total order: each task keeps ``n`` rows, never the whole table."""
    return df.orderBy(*by).limit(n)


def page(df: DataFrame, by: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the total number of rows beside it."""
    count = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*by).offset(offset).limit(limit).withColumn("total", count)


def history(df: DataFrame, day: str, key: str, cap: int = 500) -> DataFrame:
    """Newest records first, the higher id first on ties."""
    return df.orderBy(F.col(day).desc(), F.col(key).desc()).limit(cap)


def by_abs(df: DataFrame, column: str, then: str, n: int) -> DataFrame:
    """Largest magnitude first."""
    return df.orderBy(F.abs(F.col(column)).desc(), then).limit(n)


def overlay(base: DataFrame, managed: DataFrame, key: str) -> DataFrame:
    """History plus managed additions; added ids are negated and missing columns are null."""
    return base.unionByName(managed.withColumn(key, -F.col(key)), allowMissingColumns=True)


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of several frames with the same columns."""
    result = frames[0]
    for other in frames[1:]:
        result = result.unionByName(other)
    return result


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def merge(old: DataFrame, new: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """Upsert by key: matched rows take the new ``update`` columns and keep the rest."""
    left, right = old.alias("old"), new.alias("new")
    joined = left.join(right, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    there, here = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    columns = [F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}")).alias(key)]
    for name in old.columns:
        if name == key:
            continue
        was, now = F.col(f"old.{name}"), F.col(f"new.{name}")
        value = F.when(here, now).otherwise(was) if name in update else F.when(there, was).otherwise(now)
        columns.append(value.alias(name))
    return joined.select(*columns)
