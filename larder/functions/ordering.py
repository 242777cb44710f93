"""Order statistics over a whole table without sorting it in one task.

Ranks and exact quantiles of a column need to know how many values lie below each value. A
window without partitioning would send the table to one task, and the built-in exact percentile
keeps every distinct value in one buffer. Here the rows are first reduced to (value, count), the
distinct values are split into ranges at approximate quantiles, counts are accumulated inside
each range in parallel, and one total per range supplies the offsets. However
many rows share one value, that value is a single row after the first aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialise

# Distinct values one task accumulates.
PER_RANGE = 500_000
# A wanted quantile is bracketed by shares this far to either side; a bracket is sorted in so many ranges.
SLACK = 0.001
RANGES = 200


def _range_of(cuts: dict[str, list[float]]) -> Column:
    """Number of the value range a value falls in, per metric; one range if there are no cuts."""
    chosen = F.lit(0)
    for metric, points in cuts.items():
        steps = F.array(*[F.lit(p) for p in points])
        place = F.size(F.filter(steps, lambda p: p < F.col("value")))
        chosen = F.when(F.col("metric") == metric, place).otherwise(chosen)
    return chosen


def _marks(values: DataFrame, ranges: int) -> list[float]:
    """Numbers that split the distinct values into ranges of about equal size."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return sorted(set(values.agg(F.percentile_approx("value", shares, F.lit(max(10_000, 20 * ranges)))).first()[0]))


def bands(df: DataFrame, columns: Sequence[str], n: int = 32) -> dict[str, list[float]]:
    """Points that cut the values of each column into at most ``n`` ranges of about equal rows, in one scan.

    A column of no more than ``n`` distinct values is left out.
    """
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    points = [F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10_000)).alias(f"cuts_{c}") for c in columns]
    row = df.agg(*points, *[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns]).first()
    return {c: sorted(set(row[f"cuts_{c}"])) for c in columns if row[f"n_{c}"] > n}


def banded(cuts: dict[str, list[float]]) -> dict[str, Column]:
    """Number of the range of each cut column; null stays null."""
    place = lambda c, points: F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p < F.col(c)))
    return {c: F.when(F.col(c).isNotNull(), place(c, points).cast("double")) for c, points in cuts.items()}


def value_positions(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), kind: str = "double", stored: bool = False
) -> DataFrame:
    """(by.., metric, value, below, ties, total): how many non-null values lie below each value.

    ``kind`` is the type values are compared in; ids need one that holds every digit. The values
    are read twice, so their counts are stored unless ``df`` itself is ``stored`` already.
    """
    keys = [*by, "metric"]
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast(kind).alias("value")) for c in columns])
    )
    counted = (
        df.select(*by, pairs.alias("pair"))
        .select(*by, "pair.metric", "pair.value")
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    counted = counted if stored else materialise(counted)
    # One count per column and one number per range reach the driver.
    distinct = {r["metric"]: r["count"] for r in counted.groupBy("metric").count().collect()}
    cuts = {
        metric: _marks(counted.where(F.col("metric") == metric), n // PER_RANGE + 1)
        for metric, n in distinct.items()
        if n > PER_RANGE
    }
    placed = counted.withColumn("range", _range_of(cuts))
    sizes = placed.groupBy(*keys, "range").agg(F.sum("ties").alias("inside"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        "range",
        F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("offset"),
        F.sum("inside").over(Window.partitionBy(*keys)).alias("total"),
    )
    lower = Window.partitionBy(*keys, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(sizes, [*keys, "range"]).select(
        *keys,
        "value",
        (F.col("offset") + F.coalesce(F.sum("ties").over(lower), F.lit(0))).alias("below"),
        "ties",
        "total",
    )


def _attach(df: DataFrame, ranked: Column, names: dict[str, str], by: Sequence[str], kind: str = "double") -> DataFrame:
    positions = value_positions(df, list(names.values()), by, kind, stored=True)
    if len(names) > 1:
        positions = materialise(positions)
    result = df
    for target, source in names.items():
        one = positions.where(F.col("metric") == source).select(
            *[F.col(k).alias(f"_{k}") for k in by], F.col("value").alias("_value"), ranked.alias(target)
        )
        same = F.col(source).cast(kind) == F.col("_value")
        for key in by:
            same = same & (F.col(key) == F.col(f"_{key}"))
        result = result.join(one, same, "left").drop("_value", *[f"_{k}" for k in by])
    return result


def percent_ranks(df: DataFrame, names: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Average rank of ties divided by the count of non-null values; null stays null.

    ``names`` maps each new column to the column it ranks. ``df`` is read several times: store
    it first.
    """
    average = (F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")
    return _attach(df, average, names, by)


def competition_rank(df: DataFrame, target: str, source: str, by: Sequence[str] = ()) -> DataFrame:
    """Descending rank where ties share the smallest place, over a stored table."""
    place = (F.col("total") - F.col("below") - F.col("ties") + 1).cast("long")
    return _attach(df, place, {target: source}, by)


def _quantile(metric: str, share: float) -> Column:
    """The value at a share of one metric, between its two neighbours if need be."""
    place = F.lit(share) * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)
    mine, end = F.col("metric") == metric, F.col("below") + F.col("ties")
    at = lambda i: F.max(F.when(mine & (F.col("below") <= i) & (i < end), F.col("value")))
    return at(low) + (at(high) - at(low)) * F.max(F.when(mine, place - low))


def _near_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None] | None:
    """Exact quantiles without storing the column: two scans, and only values near the wanted ranks are sorted.

    The first scan brackets every wanted rank by approximate quantiles, the second counts what lies below each
    bracket and keeps the few values inside. None if a rank lies outside its bracket.
    """
    if not wanted:
        return {}
    value = {name: F.col(column).cast("double") for name, (column, _) in wanted.items()}
    shares = {name: (max(share - SLACK, 0.0), min(share + SLACK, 1.0)) for name, (_, share) in wanted.items()}
    first = df.agg(
        *[F.percentile_approx(value[name], F.array(*map(F.lit, shares[name])), F.lit(10_000)).alias(f"cuts_{name}") for name in wanted],
        *[F.count(value[name]).alias(f"n_{name}") for name in wanted],
    ).first()
    held = [name for name in wanted if first[f"n_{name}"]]
    if not held:
        return dict.fromkeys(wanted)
    low = {name: first[f"cuts_{name}"][0] for name in held}
    high = {name: first[f"cuts_{name}"][1] for name in held}
    inside = {name: F.when(value[name].between(low[name], high[name]), value[name]) for name in held}
    # Rows outside all brackets count as nulls of the reduced table, one row per set of values.
    under = [F.sum(F.when(value[name] < low[name], F.lit(1)).otherwise(0)).alias(f"under_{name}") for name in held]
    near = materialise(df.groupBy(*[inside[name].alias(name) for name in held]).agg(F.count(F.lit(1)).alias("rows"), *under))
    below = near.agg(*[F.sum(f"under_{name}").alias(name) for name in held]).first()
    place = {name: wanted[name][1] * (first[f"n_{name}"] - 1) - below[name] for name in held}
    # The values near all wanted ranks are placed together, in one job.
    of = lambda numbers: F.create_map(*[x for n in held for x in (F.lit(n), F.lit(float(numbers[n])))])[F.col("name")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in held]))
    counted = near.select("rows", pairs.alias("pair")).select("rows", "pair.*").where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.sum("rows").alias("ties"))
    steps = {n: (high[n] - low[n]) / RANGES or 1.0 for n in held}
    ranged = counted.withColumn("range", F.least(F.floor((F.col("value") - of(low)) / of(steps)), F.lit(RANGES - 1)))
    # At most RANGES rows of each.
    earlier = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    offset = ranged.groupBy("name", "range").agg(F.sum("ties").alias("inside")).select("name", "range", (F.sum("inside").over(earlier) - F.col("inside")).alias("before"))
    run = Window.partitionBy("name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("ties").over(run)).join(offset, ["name", "range"]).withColumn("upto", F.col("upto") + F.col("before"))
    pick = lambda k: F.min(F.when(F.col("upto") > of(k), F.col("value")))
    lower, upper = {n: math.floor(p) for n, p in place.items()}, {n: math.ceil(p) for n, p in place.items()}
    at = {r["name"]: r for r in placed.groupBy("name").agg(pick(lower).alias("low"), pick(upper).alias("high")).collect()}
    found: dict[str, float | None] = dict.fromkeys(wanted)
    for name in held:
        if lower[name] < 0 or name not in at or at[name]["high"] is None:
            return None
        found[name] = at[name]["low"] + (at[name]["high"] - at[name]["low"]) * (place[name] - lower[name])
    return found


def quantiles(df: DataFrame, column: str, shares: dict[str, float], by: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group (one row in all without ``by``)."""
    if not by and (found := _near_quantiles(df, {name: (column, share) for name, share in shares.items()})) is not None:
        return df.sparkSession.range(1).select(*[F.lit(found[name]).cast("double").alias(name) for name in shares])
    positions = value_positions(df, [column], by, stored=stored)
    return positions.groupBy(*by).agg(*[_quantile(column, share).alias(name) for name, share in shares.items()])


def quantile_values(df: DataFrame, wanted: dict[str, tuple[str, float]], stored: bool = False) -> dict[str, float | None]:
    """Quantiles of several columns as numbers that steer later steps."""
    found = _near_quantiles(df, wanted)
    if found is not None:
        return found
    positions = value_positions(df, list(dict.fromkeys(c for c, _ in wanted.values())), stored=stored)
    return positions.agg(*[_quantile(c, share).alias(name) for name, (c, share) in wanted.items()]).first().asDict()


def quantile_value(df: DataFrame, column: str, share: float, stored: bool = False) -> float | None:
    return quantile_values(df, {"q": (column, share)}, stored)["q"]


def numbered(df: DataFrame, target: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """1, 2, 3 ... in the order of a unique numeric key, per group, over a stored table."""
    place = (F.col("below") + 1).cast("long")
    return _attach(df, place, {target: key}, by, "decimal(20,0)")
