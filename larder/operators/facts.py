"""The line-grain facts: clean sales, the star join, as-of prices and latest snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions.scalar import MONEY
from larder.functions.windows import nth_per


def with_economics(lines: DataFrame) -> DataFrame:
    """Net revenue, cost and contribution of a line, each rounded to the cent."""
    qty, price = F.col("Quantity").cast(MONEY), F.col("Unit_Price").cast(MONEY)
    off, cost = F.col("Discount_Applied").cast(MONEY), F.col("Cost").cast(MONEY)
    return lines.withColumns(
        {
            "Net_Revenue": F.round(qty * price - off, 2).cast(MONEY),
            "Cost_Total": F.round(qty * cost, 2).cast(MONEY),
            "Contribution": F.round(qty * (price - cost) - off, 2).cast(MONEY),
        }
    )


def with_margin(lines: DataFrame) -> DataFrame:
    """Gross line total and unit margin."""
    return lines.withColumns(
        {
            "Line_Total": F.col("Quantity").cast(MONEY) * F.col("Unit_Price").cast(MONEY),
            "Profit_Margin": F.col("Unit_Price") - F.col("Cost"),
        }
    )


def completed(orders: DataFrame) -> DataFrame:
    """The realised-sales universe; cancelled headers stay in ``orders`` only."""
    return orders.where(F.col("Order_Status") == "Completed")


def build_sales(lines: DataFrame, orders: DataFrame, menu: DataFrame) -> DataFrame:
    """Clean completed lines with header and menu columns and the three measures."""
    header = completed(orders).select(
        "Order_ID", "Customer_ID", "Location_ID", "Order_DateTime", "Channel", "Promotion_ID"
    )
    dish = menu.select("Item_ID", "Item_Name", "Category_ID", "Cost")
    joined = lines.join(header, "Order_ID").join(dish, "Item_ID")
    return with_economics(joined).withColumn("Date", F.to_date("Order_DateTime"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty means a join on them is many-to-one."""
    return df.groupBy(*key).count().where(F.col("count") > 1)


def latest_per(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row per key in a total order."""
    return nth_per(df, key, order, 1)


def latest_stock(inventory: DataFrame) -> DataFrame:
    """Newest stock period per item and location; the higher id wins a tie."""
    order = [F.col("Period_End").desc(), F.col("Inventory_ID").desc()]
    if "Extended" in inventory.columns:
        order += [F.col("Extended").desc(), F.col("Stock_Quantity").desc()]
    newest = latest_per(inventory, ["Item_ID", "Location_ID"], order)
    return newest.select("Item_ID", "Location_ID", "Stock_Quantity", "Reorder_Level")


def preagg(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Reduce a one-to-many table to the join key before it meets the facts."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def rating_by_item_location(ratings: DataFrame, orders: DataFrame) -> DataFrame:
    where = orders.select("Order_ID", "Location_ID")
    return preagg(
        ratings.select("Order_ID", "Item_ID", "Stars").join(where, "Order_ID"),
        ["Item_ID", "Location_ID"],
        Rating_Count=F.count(F.lit(1)),
        Average_Rating=F.avg("Stars"),
    )


def wastage_by_item_location(wastage: DataFrame) -> DataFrame:
    return preagg(
        wastage,
        ["Item_ID", "Location_ID"],
        Wastage_Quantity=F.sum("Quantity_Wasted"),
        Wastage_Cost=F.round(F.sum("Cost_Impact"), 2),
    )


def price_intervals(prices: DataFrame) -> DataFrame:
    """Each price with the half-open range of dates it holds for; one price per item and date."""
    daily = nth_per(prices, ["Item_ID", "Effective_Date"], [F.col("Pricing_ID").desc()])
    following = F.lead("Effective_Date").over(Window.partitionBy("Item_ID").orderBy("Effective_Date"))
    return daily.select("Item_ID", F.col("Price"), F.col("Effective_Date"), following.alias("Until"))


#: Lines of one dish from which on it is dealt over several keys.
HOT_LINES = 2_000_000


def hot_items(lines: DataFrame, target: int = HOT_LINES) -> DataFrame:
    """(Item_ID, parts) of the dishes with more than ``target`` lines; at most one dish per ``target`` lines of all."""
    counted = lines.groupBy("Item_ID").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > target)
    return counted.select("Item_ID", F.ceil(F.col("n") / target).cast("int").alias("parts"))


def asof_price(sales: DataFrame, prices: DataFrame, day: str = "Date", horizon: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """The price in force on the sale date, null before an item's first price.

    ``horizon`` is a date no sale lies after; by default it is read from the sales.

    A price range is spread over the calendar quarters it touches, so that the join is an equi
    join on (item, quarter) with at most one quarter's price events per line, rather than a
    range join against an item's whole history. ``hot`` (from ``hot_items``) names dishes whose lines are dealt over
    several keys, by a hash of the line; only their few price ranges are repeated.
    """
    if horizon is None:
        horizon = sales.agg(F.max(F.col(day))).scalar()
    ranges = price_intervals(prices)
    last = F.coalesce(F.date_sub(F.col("Until"), 1), F.greatest(horizon, F.col("Effective_Date")))
    spread = ranges.withColumn("last", last).select(
        F.col("Item_ID").alias("_item"),
        F.col("Price").alias("Effective_Price"),
        "Effective_Date",
        F.col("Until").alias("_until"),
        F.explode(
            F.sequence(F.trunc("Effective_Date", "quarter"), F.trunc("last", "quarter"), F.expr("INTERVAL 3 MONTHS"))
        ).alias("_quarter"),
    )
    if hot is None:
        dealt, part = sales, F.lit(0)
        spread = spread.withColumn("_part", F.lit(0))
    else:
        parts = hot.select(F.col("Item_ID").alias("_hot"), "parts")
        spread = spread.join(parts, F.col("_item") == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("_hot", "parts")
        dealt = sales.join(parts, F.col("Item_ID") == F.col("_hot"), "left").withColumn("_deal", F.pmod(F.xxhash64("Order_Item_ID"), F.coalesce("parts", F.lit(1))).cast("int")).drop("_hot", "parts")
        part = F.col("_deal")
    at = F.col(day)
    match = (
        (F.col("Item_ID") == F.col("_item"))
        & (F.trunc(at, "quarter") == F.col("_quarter"))
        & (part == F.col("_part"))
        & (at >= F.col("Effective_Date"))
        & (F.col("_until").isNull() | (at < F.col("_until")))
    )
    return dealt.join(spread, match, "left").drop("_item", "_until", "_quarter", "_part", "_deal")


def campaign_flag(df: DataFrame, day: str = "Date") -> Column:
    """Line carries its order's campaign, inside its dates and matching its target."""
    target = (
        F.when(F.col("Applicable_Item_ID").isNotNull(), F.col("Item_ID") == F.col("Applicable_Item_ID"))
        .when(F.col("Applicable_Category_ID").isNotNull(), F.col("Category_ID") == F.col("Applicable_Category_ID"))
        .otherwise(True)
    )
    inside = F.col("Promotion_ID").isNotNull() & F.col(day).between(F.col("Start_Date"), F.col("End_Date"))
    return F.coalesce(inside & target, F.lit(False))


ENRICHMENTS = ("promotion", "rating", "stock", "wastage", "price")


def integrated(
    lines: DataFrame,
    orders: DataFrame,
    menu: DataFrame,
    customers: DataFrame,
    categories: DataFrame,
    locations: DataFrame,
    promotions: DataFrame | None = None,
    ratings: DataFrame | None = None,
    inventory: DataFrame | None = None,
    wastage: DataFrame | None = None,
    prices: DataFrame | None = None,
) -> DataFrame:
    """The star join at line grain.

    The six required tables are inner joins. Each optional table is a left join on a unique key
    and never changes the rows, so a query passes only those it reads: a location total then
    does not aggregate ratings or spread prices.
    """
    sales = (
        build_sales(lines, orders, menu)
        .join(customers.select("Customer_ID", "Customer_Name"), "Customer_ID")
        .join(categories.select("Category_ID", "Category_Name"), "Category_ID")
        .join(locations.select("Location_ID", "Location_Name", "City"), "Location_ID")
        .withColumn("Local_Hour", F.hour("Order_DateTime"))
        .withColumnRenamed("Date", "Local_Date")
    )
    pair = ["Item_ID", "Location_ID"]
    if promotions is not None:
        details = promotions.select(
            "Promotion_ID", "Promotion_Name", "Discount_Percent", "Start_Date", "End_Date",
            "Applicable_Item_ID", "Applicable_Category_ID",
        )
        sales = sales.join(details, "Promotion_ID", "left")
        sales = sales.withColumn("Campaign_Eligible", campaign_flag(sales, "Local_Date"))
    if ratings is not None:
        sales = sales.join(rating_by_item_location(ratings, orders), pair, "left")
    if inventory is not None:
        sales = sales.join(latest_stock(inventory), pair, "left")
    if wastage is not None:
        sales = sales.join(wastage_by_item_location(wastage), pair, "left")
    if prices is not None:
        # The headers alone bound the dates, without running the joins above twice.
        sales = asof_price(sales, prices, "Local_Date", orders.agg(F.max(F.to_date("Order_DateTime"))).scalar())
    return sales


def keep_known(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose key exists in the other table.

    Its keys are made distinct map-side first, so a key with very many rows there does not
    travel to one task.
    """
    return df.join(dimension.select(key).distinct(), key, "left_semi")


def unknown(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing from the other table (a null key is unknown)."""
    return df.join(dimension.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, dimension: DataFrame, key: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Attach columns of a unique-key table, with a default where the key is absent."""
    values = dimension.select(*key, *defaults)
    return df.join(values, list(key), "left").fillna(defaults)


def unified_city(lines: DataFrame, orders: DataFrame, menu: DataFrame, locations: DataFrame) -> DataFrame:
    """Lines of every status with header, dish and city."""
    header = orders.select("Order_ID", "Location_ID", "Order_DateTime", "Channel")
    return (
        lines.join(header, "Order_ID")
        .join(menu.select("Item_ID", "Item_Name", "Cost"), "Item_ID")
        .join(locations.select("Location_ID", "City"), "Location_ID")
    )


def risk_with_stock(risk: DataFrame, stock: DataFrame, level: str = "HIGH") -> DataFrame:
    """Pairs of one risk level with their stock, if any is recorded."""
    return risk.where(F.col("Risk") == level).join(stock, ["Item_ID", "Location_ID"], "left")


def align(left: DataFrame, right: DataFrame, key: str = "Case_ID", least: int = 100) -> DataFrame:
    """Pair two holdouts case by case, or fail.

    Both must hold the same cases, the same actual values and at least ``least`` of them.
    """
    paired = left.join(right.withColumnRenamed("Actual", "Actual_Right"), key, "full_outer")
    facts = paired.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(~F.col("Actual").eqNullSafe(F.col("Actual_Right"))).alias("different"),
    ).first()
    if facts["cases"] < least or facts["different"]:
        raise ValueError(f"holdouts do not align: {facts.asDict()}")
    return left.join(right.drop("Actual"), key)


def grid(keys: DataFrame, start: Column, end: Column, step: str, name: str) -> DataFrame:
    """Every key at every calendar step; grows only with its own output, without a join."""
    return keys.withColumn(name, F.explode(F.sequence(start, end, F.expr(f"INTERVAL {step}"))))


def grid_totals(keys: DataFrame, weekly: DataFrame, start: Column, end: Column, key: Sequence[str], value: str) -> DataFrame:
    """Per key and year of the complete weekly grid: its weeks, the weeks with a value, and their sum.

    ``weekly`` holds at most one row per key and week. The grid of one key is the calendar, which is cut into years
    once; a key meets it as a short list of years, beside the totals of its own rows. No row per key and week is made.
    """
    key, year = list(key), F.year("Week").cast("long").alias("Year")
    weeks = grid(keys.sparkSession.range(1).withColumns({"_start": start, "_end": end}).where("_start <= _end"), F.col("_start"), F.col("_end"), "7 DAYS", "Week")
    calendar = weeks.groupBy(year).agg(F.count(F.lit(1)).alias("weeks")).agg(F.collect_list(F.struct("Year", "weeks"))).scalar()
    known = weekly.dropna(subset=[*key, "Week"]).groupBy(*key, year).agg(F.count(value).alias("known_weeks"), F.sum(value).alias(value))
    # A key without a dated row has no totals, but its years; a null in a key equals nothing.
    blank = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("Year", "known_weeks", value)]
    own = known.unionByName(keys.select(*key, *blank)).groupBy(*key).agg(F.collect_list(F.when(F.col("Year").isNotNull(), F.struct("Year", "known_weeks", value))).alias("_own"))
    spread = own.withColumn("_years", calendar).select(*key, "_own", F.inline("_years"))
    mine = F.get(F.filter("_own", lambda x: x["Year"] == F.col("Year")), F.lit(0))
    return spread.select(
        *key, "Year", "weeks", F.coalesce(mine["known_weeks"], F.lit(0)).alias("known_weeks"), F.coalesce(mine[value], F.lit(0)).alias(value)
    )
