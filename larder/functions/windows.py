"""Window expressions over a series per entity. Every window is partitioned and calendar-bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(key: Sequence[str] | str, order: Sequence[str] | str):
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*orders)


def lags(df: DataFrame, column: str, key, order, steps: Sequence[int]) -> DataFrame:
    """``lag_<n>`` for each step, by row."""
    w = series(key, order)
    return df.withColumns({f"lag_{n}": F.lag(column, n).over(w) for n in steps})


def prior_mean(column: str, key, order, rows: int, strict: bool = True) -> Column:
    """Mean of the ``rows`` rows before the current one; null unless all of them hold a value."""
    w = series(key, order).rowsBetween(-rows, -1)
    mean = F.avg(column).over(w)
    return F.when(F.count(column).over(w) == rows, mean) if strict else mean


def last_observed(column: str, key, order) -> Column:
    """Last non-null value before the current row."""
    return F.last(column, ignorenulls=True).over(series(key, order).rowsBetween(Window.unboundedPreceding, -1))


def nth_per(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in a total order.

    The filter on ``row_number`` lets Spark keep only ``n`` rows per key before the shuffle, so
    a key with very many copies does not travel.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def first_of(key: Sequence[str]) -> Column:
    """True on one row per key. Ids count by these flags with one sort, which spills, and no hash table of ids in memory."""
    return F.row_number().over(series(key, key[-1])) == 1


def zscore(column: str, part: Sequence[str], null_spread_as_one: bool = False) -> Column:
    """(x - mean) / sample deviation per group; a zero deviation counts as one."""
    w = Window.partitionBy(*part)
    spread = F.stddev_samp(column).over(w)
    if null_spread_as_one:
        spread = F.coalesce(spread, F.lit(1.0))
    spread = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return (F.col(column).cast("double") - F.avg(F.col(column).cast("double")).over(w)) / spread


def percent_change(column: str, key, order) -> Column:
    """Change against the previous row in percent."""
    before = F.lag(column).over(series(key, order)).cast("double")
    return (F.col(column).cast("double") / F.nullif(before, F.lit(0.0)) - 1) * 100
