"""Roll-ups that answer filtered reports without the star join.

Three tables are written once and can be added up over any date, location and channel:

* order cells: a row per order and category with its economics. Distinct orders and customers of any filter come from
  them, as an order has one date, location, channel and customer.
* item cells: a row per date, location, channel and dish. An order lies in one date, location and channel, so a dish's
  distinct orders add up over its cells.
* waste cells: a row per date, location and dish.

They are stored by year, so a date filter prunes files. ``covers`` says whether a set of filters can be answered from
the cells; other filters go to the sales themselves, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.scalar import ratio
from larder.functions.windows import series
from larder.operators import filters, metrics

#: Filters that every cell carries, and the report each kind of cell answers with more.
ALWAYS = {"date_from", "date_to", "location_id", "channel"}
ANSWERS = {"executive": ALWAYS | {"category_id"}, "items": ALWAYS | {"category_id", "item_id"}}
SUMS = ("units", "revenue", "cost", "contribution", "discount")


@dataclass
class Rollup:
    orders: DataFrame
    items: DataFrame
    waste: DataFrame


def _added(sales: DataFrame, keys: list[str], line: str, steps: int, **more: Column) -> DataFrame:
    """One row per key with the sums of its lines, sorted by ``line`` in a stage of their own.

    Nearly every line is a cell of its own: an aggregate would hold them all in hash tables, where one sort spills.
    """
    order = series(keys, line)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {name: metrics.total(sales, source, steps, whole) for name, source in metrics.SUMS.items()}
    sums |= {name: c.over(whole) for name, c in more.items()}
    placed = sales.repartition(*keys).withColumns({"_line": F.row_number().over(order)} | {f"_{name}": c for name, c in sums.items()})
    return placed.where("_line = 1").select(*keys, *[F.col(f"_{name}").alias(name) for name in sums])


def build(sales: DataFrame, wastage: DataFrame, menu: DataFrame, folder: str) -> Rollup:
    """Write the cells of ``sales`` and ``wastage`` under ``folder``: two passes over the sales, one over the wastage."""
    place = ["Date", "Location_ID", "Channel"]
    orders = _added(sales, [*place, "Category_ID", "Customer_ID", "Order_ID"], "Item_ID", 1)
    dish = [*place, "Category_ID", "Item_ID"]
    visits = sales.repartition(*dish).withColumn("_visit", F.dense_rank().over(series(dish, "Order_ID")).cast("long"))
    items = _added(visits, dish, "Order_ID", 2, orders=F.max("_visit"), first_sale=F.min("Order_DateTime"), last_sale=F.max("Order_DateTime"))
    spoilt = wastage.groupBy(F.col("Wastage_Date").alias("Date"), "Location_ID", "Item_ID").agg(F.sum("Quantity_Wasted").alias("units"), F.sum("Cost_Impact").alias("cost"))
    spoilt = spoilt.join(menu.select("Item_ID", "Category_ID"), "Item_ID", "left")
    for name, cells in (("orders", orders), ("items", items), ("waste", spoilt)):
        cells.withColumn("Year", F.year("Date")).write.partitionBy("Year").parquet(f"{folder}/{name}")
    return load(sales.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> Rollup:
    return Rollup(*[spark.read.parquet(f"{folder}/{name}") for name in ("orders", "items", "waste")])


def covers(f: filters.Filters, report: str) -> bool:
    """Whether the cells carry every column that the given filters look at."""
    given = {x.name for x in fields(f) if getattr(f, x.name) is not None} - {"channels"}
    return given <= ANSWERS[report]


def _cells(df: DataFrame, f: filters.Filters, channel: bool = True) -> DataFrame:
    years = F.lit(True)
    if f.date_from is not None:
        years = years & (F.col("Year") >= f.date_from.year)
    if f.date_to is not None:
        years = years & (F.col("Year") <= f.date_to.year)
    equal = {"Location_ID": f.location_id, "Category_ID": f.category_id, "Item_ID": f.item_id, **({"Channel": f.channel} if channel else {})}
    kept = df.where(years & filters.between_days("Date", f.date_from, f.date_to))
    for column, value in equal.items():
        if value is not None:
            kept = kept.where(F.col(column) == F.lit(value))
    return kept


def executive(cells: Rollup, f: filters.Filters) -> DataFrame:
    """The headline figures of ``metrics.executive`` from the cells."""
    if not covers(f, "executive"):
        raise ValueError("the order cells do not carry a column of these filters")
    sold = _cells(cells.orders, f).withColumnsRenamed({"revenue": "Net_Revenue", "contribution": "Contribution"})
    return metrics.executive(sold, _cells(cells.waste, f, channel=False).withColumnRenamed("cost", "Cost_Impact"))


def item_totals(cells: Rollup, f: filters.Filters) -> DataFrame:
    """Economics, orders and first and last sale of every dish sold within the filters."""
    if not covers(f, "items"):
        raise ValueError("the item cells do not carry a column of these filters")
    g = _cells(cells.items, f).groupBy("Item_ID", "Category_ID").agg(*[F.sum(c).alias(c) for c in SUMS], F.sum("orders").alias("orders"), F.min("first_sale").alias("first_sale"), F.max("last_sale").alias("last_sale"))
    return g.withColumn("profit_percent", ratio(100 * F.col("contribution"), F.col("revenue"), 0.0))


def answered(cells: Rollup, sales: DataFrame, wastage: DataFrame, menu: DataFrame, f: filters.Filters, promotions: DataFrame | None = None) -> DataFrame:
    """Headline figures from the cells where they cover the filters, from the sales elsewhere."""
    if covers(f, "executive"):
        return executive(cells, f)
    return metrics.executive(filters.apply_filters(sales, f, promotions), filters.apply_wastage_filters(wastage, f, menu))
