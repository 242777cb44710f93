"""Aggregates over the sales facts.

Distinct orders and customers are counted by reducing lines to orders, orders to customers and
customers to the reporting key. Each step is a plain aggregate with map-side partial results, so
one busy location or dish never gathers its rows in one task, and no row is copied per distinct
column. Per dish nearly every line is an order of its own, and such aggregates would hold all lines of a
task several times over; there the lines are sorted by customer and order once, and their first ones counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import calendar, ordering
from larder.functions.scalar import ratio
from larder.functions.windows import first_of, nth_per, percent_change, series
from larder.session import materialise


def per_order(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, customer and order."""
    return sales.groupBy(*keys, "Customer_ID", "Order_ID").agg(
        F.sum("Quantity").alias("units"),
        F.sum("Net_Revenue").alias("revenue"),
        F.sum("Cost_Total").alias("cost"),
        F.sum("Contribution").alias("contribution"),
        F.sum("Discount_Applied").alias("discount"),
        F.min("Order_DateTime").alias("first_sale"),
        F.max("Order_DateTime").alias("last_sale"),
    )


SUMS = {"units": "Quantity", "revenue": "Net_Revenue", "cost": "Cost_Total", "contribution": "Contribution", "discount": "Discount_Applied"}


def total(df: DataFrame, column: str, steps: int, over: WindowSpec | None = None) -> Column:
    """The sum of a column in the type that summing up in so many steps gives it."""
    kind = df.schema[column].dataType
    found = F.sum(column) if over is None else F.sum(column).over(over)
    return found.cast(T.DecimalType(min(38, kind.precision + 10 * steps), kind.scale)) if isinstance(kind, T.DecimalType) else found


def _by_dish(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``summarise`` with one sort: a line opens an order if it is the first of its rank, a customer if it is the very first."""
    visits = series([*keys, "Customer_ID"], "Order_ID")
    # In a stage of its own: the joins that made the lines hold sorted rows, too.
    dealt = sales.repartition(*keys, "Customer_ID")
    placed = dealt.withColumns({"_line": F.row_number().over(visits), "_rank": F.rank().over(visits), "_order": F.dense_rank().over(visits)})
    opens = F.col("_line") == F.col("_rank")
    return placed.groupBy(*keys).agg(
        *[total(sales, source, 3).alias(name) for name, source in SUMS.items()],
        F.count_if(opens).alias("orders"),
        F.count_if(F.col("_line") == 1).alias("customers"),
        F.count_if(opens & (F.col("_order") == 2)).alias("repeat_customers"),
        F.min("Order_DateTime").alias("first_sale"),
        F.max("Order_DateTime").alias("last_sale"),
    )


def summarise(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Economics with distinct orders, customers and returning customers per key."""
    if "Item_ID" in keys:
        return _by_dish(sales, keys)
    by_customer = (
        per_order(sales, keys)
        .groupBy(*keys, "Customer_ID")
        .agg(
            *[F.sum(c).alias(c) for c in SUMS],
            F.count(F.lit(1)).alias("orders"),
            F.min("first_sale").alias("first_sale"),
            F.max("last_sale").alias("last_sale"),
        )
    )
    return by_customer.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.sum("orders").alias("orders"),
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
        F.min("first_sale").alias("first_sale"),
        F.max("last_sale").alias("last_sale"),
    )


# -- the seven reports over the star join -----------------------------------------------------
# Names are grouping columns: they depend on the id, and a text buffer would force sorted aggregation.


def menu_profit(i: DataFrame) -> DataFrame:
    dish = ["Item_ID", "Item_Name"]
    grouped = i.repartition(*dish, "Order_ID").withColumn("_opens", first_of([*dish, "Order_ID"])).groupBy(*dish).agg(
        F.sum("Quantity").alias("Units"),
        F.round(F.sum("Net_Revenue"), 2).alias("Net_Revenue"),
        F.round(F.sum("Cost_Total"), 2).alias("Cost"),
        F.round(F.sum("Contribution"), 2).alias("Contribution"),
        F.count_if(F.col("_opens") & F.col("Order_ID").isNotNull()).alias("Orders"),
    )
    percent = F.round(100 * ratio(F.col("Contribution"), F.col("Net_Revenue")), 2)
    return grouped.withColumn("Profit_Percent", percent)


def _totals(i: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    return i.groupBy(*keys).agg(*columns)


def _orders(name: str = "Orders") -> Column:
    return F.count_distinct("Order_ID").alias(name)


_MONEY = {"Net_Revenue": "Net_Revenue", "Cost": "Cost_Total", "Contribution": "Contribution"}


def _money(*names: str) -> list[Column]:
    return [F.round(F.sum(_MONEY[n]), 2).alias(n) for n in names]


def by_location(i: DataFrame) -> DataFrame:
    return _totals(
        i, ["Location_ID", "Location_Name"], _orders(), *_money("Net_Revenue", "Cost", "Contribution"),
    )


def peaks(i: DataFrame) -> DataFrame:
    """Orders and revenue per location and local hour."""
    hours = i.withColumnRenamed("Local_Hour", "Hour")
    return _totals(hours, ["Location_ID", "Hour"], _orders(), *_money("Net_Revenue"))


def by_category(i: DataFrame) -> DataFrame:
    return _totals(
        i, ["Category_ID", "Category_Name"], F.sum("Quantity").alias("Units"), *_money("Net_Revenue", "Contribution"),
    )


def by_campaign(i: DataFrame) -> DataFrame:
    """Campaign totals over lines that carry the campaign and qualify for it."""
    return _totals(
        i.where("Campaign_Eligible"), ["Promotion_ID", "Promotion_Name"], _orders(), F.sum("Quantity").alias("Units"), *_money("Net_Revenue", "Contribution"),
    )


def high_wastage(i: DataFrame, n: int = 100) -> DataFrame:
    """The costliest item-location pairs."""
    grouped = i.where(F.col("Wastage_Quantity").isNotNull()).groupBy("Item_ID", "Location_ID", "Item_Name").agg(
        *[F.max(c).alias(c) for c in ("Wastage_Quantity", "Wastage_Cost", "Stock_Quantity", "Rating_Count")],
    )
    return grouped.orderBy(F.col("Wastage_Cost").desc(), "Item_ID", "Location_ID").limit(n)


def by_channel(i: DataFrame) -> DataFrame:
    return _totals(
        i, ["Channel"], _orders(), F.sum("Quantity").alias("Units"), *_money("Net_Revenue", "Contribution")
    )


# -- clean aggregates --------------------------------------------------------------------------


def rating_metrics(ratings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return ratings.groupBy(*scope, "Item_ID").agg(
        F.avg("Stars").alias("Average_Rating"), F.count("Stars").alias("Rating_Count")
    )


def menu_metrics(sales: DataFrame, ratings: DataFrame) -> DataFrame:
    """Item economics with distinct orders and customers and the item's ratings."""
    grouped = summarise(sales, ["Item_ID", "Item_Name", "Category_ID"]).select(
        "Item_ID", "Item_Name", "Category_ID",
        F.col("units").alias("Sales_Quantity"), F.col("revenue").alias("Revenue"), F.col("cost").alias("Cost"),
        F.col("contribution").alias("Contribution"), F.col("orders").alias("Orders"),
        F.col("customers").alias("Customers"), F.col("discount").alias("Discount"),
        (100 * ratio(F.col("contribution"), F.col("revenue"))).alias("Profit_Percent"),
    ).fillna({"Profit_Percent": 0.0})
    return grouped.join(rating_metrics(ratings), "Item_ID", "left")


def order_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Order_ID", "Customer_ID", "Location_ID").agg(F.sum("Net_Revenue").alias("Net_Revenue"))


def rfm(sales: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """Last order, distinct orders, net spend, usual location and recency per customer.

    The usual location is the one with most lines, the smallest id on ties. Recency counts whole
    days up to one day after the newest sale (or ``snapshot``).
    """
    visits = sales.groupBy("Customer_ID", "Location_ID", "Order_ID").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max("Order_DateTime").alias("at"),
        F.sum("Net_Revenue").alias("spend"),
    )
    places = visits.groupBy("Customer_ID", "Location_ID").agg(
        F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("orders"), F.max("at").alias("at"), F.sum("spend").alias("spend")
    )
    people = places.groupBy("Customer_ID").agg(
        F.max("at").alias("Last_Order"),
        F.sum("orders").alias("Frequency"),
        F.sum("spend").alias("Monetary"),
        F.max_by("Location_ID", F.struct("lines", -F.col("Location_ID"))).alias("Preferred_Location"),
    )
    if snapshot is None:
        # One row per customer is read again, not the facts.
        people = materialise(people)
        snapshot = people.agg(F.max("Last_Order")).scalar() + F.expr("INTERVAL 1 DAY")
    return people.withColumn("Recency_Days", calendar.whole_days(F.col("Last_Order"), snapshot))


def rfm_gross(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Gross spend per customer; frequency counts headers, also those without lines."""
    snapshot = orders.agg(F.max("Order_DateTime")).scalar() + F.expr("INTERVAL 1 DAY")
    visits = orders.groupBy("Customer_ID").agg(
        F.max("Order_DateTime").alias("Last_Order"), F.count("Order_ID").alias("Frequency")
    )
    spend = (
        lines.join(orders.select("Order_ID", "Customer_ID"), "Order_ID")
        .groupBy("Customer_ID")
        .agg(F.sum(F.col("Quantity") * F.col("Unit_Price")).alias("Monetary"))
    )
    return visits.join(spend, "Customer_ID").select(
        "Customer_ID", calendar.whole_days(F.col("Last_Order"), snapshot).alias("Recency"), "Frequency", "Monetary"
    )


def location_daily(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Date", "Location_ID").agg(
        F.sum("Quantity").alias("Demand"), F.sum("Net_Revenue").alias("Revenue"),
        F.sum("Contribution").alias("Contribution"), F.count_distinct("Order_ID").alias("Orders"),
    )


def daily_demand(sales: DataFrame) -> DataFrame:
    return sales.groupBy("Date").agg(F.sum("Quantity").alias("Demand"))


# -- scoped reports ----------------------------------------------------------------------------


def executive(sales: DataFrame, wastage: DataFrame) -> DataFrame:
    """One row of headline figures for already filtered sales and wastage.

    Only the wastage figure is null-free without sales. Wastage takes date, location, item and
    category filters but no channel or campaign filter, see ``filters.apply_wastage_filters``.
    """
    waste = wastage.agg(F.round(F.coalesce(F.sum("Cost_Impact"), F.lit(0)), 2)).scalar()
    people = (
        sales.groupBy("Customer_ID", "Order_ID")
        .agg(F.sum("Net_Revenue").alias("revenue"), F.sum("Contribution").alias("contribution"))
        .groupBy("Customer_ID")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"), F.sum("contribution").alias("contribution"))
    )
    return people.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.coalesce(F.round(F.sum("revenue"), 2), F.lit(0)).alias("revenue"),
        F.coalesce(F.round(F.sum("contribution"), 2), F.lit(0)).alias("contribution"),
        F.round(ratio(F.sum("revenue"), F.sum("orders")), 2).alias("aov"),
        F.count(F.lit(1)).alias("active_customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
    ).withColumn("wastage_cost", waste)


def orders_page(orders: DataFrame, totals: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest orders first; revenue is null for orders without clean completed lines."""
    page = orders.orderBy(F.col("Order_DateTime").desc(), "Order_ID").offset(offset).limit(limit)
    return page.join(totals.select("Order_ID", "Net_Revenue"), "Order_ID", "left")


def status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("Order_Status").agg(F.count(F.lit(1)).alias("orders"))


def menu_scoped(sales: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Item aggregate of a scope (or of every scope): economics, dates, campaign dependency, repeats."""
    g = summarise(sales, [*scope, "Item_ID", "Item_Name", "Category_ID"])
    gross = F.col("revenue") + F.col("discount")
    return g.select(
        *scope, "Item_ID", "Item_Name", "Category_ID",
        F.col("units").alias("sales"), "revenue", "cost", "contribution", "orders", "customers", "discount",
        "first_sale", "last_sale",
        ratio(100 * F.col("contribution"), F.col("revenue"), 0.0).alias("profit_percent"),
        ratio(F.col("discount"), gross, 0.0).alias("promotion_dependency"),
        calendar.whole_days(F.col("first_sale"), F.col("last_sale")).alias("active_days"),
        ratio(F.col("repeat_customers"), F.col("customers")).alias("repeat_purchase_rate"),
    )


def promo_dependency(sales: DataFrame, key: str = "Item_ID") -> DataFrame:
    """Discount share of list value."""
    g = sales.groupBy(key).agg(F.sum("Discount_Applied").alias("discount"), F.sum("Net_Revenue").alias("revenue"))
    return g.select(key, ratio(F.col("discount"), F.col("revenue") + F.col("discount"), 0.0).alias("promotion_dependency"))


def repeat_rate(sales: DataFrame, key: str = "Item_ID") -> DataFrame:
    """Share of a dish's customers who ordered it in more than one order."""
    g = summarise(sales, [key])
    return g.select(key, ratio(F.col("repeat_customers"), F.col("customers")).alias("repeat_purchase_rate"))


def trend(sales: DataFrame, end: Column, days: int = 30, keys: Sequence[str] = ("Item_ID",)) -> DataFrame:
    """Change of units between the last and the previous window, both ending at a global ``end``."""
    at = F.col("Order_DateTime")
    one, two = F.expr(f"INTERVAL {days} DAYS"), F.expr(f"INTERVAL {2 * days} DAYS")
    recent = F.sum(F.when(at > end - one, F.col("Quantity")).otherwise(0))
    before = F.sum(F.when((at <= end - one) & (at > end - two), F.col("Quantity")).otherwise(0))
    g = sales.groupBy(*keys).agg(recent.alias("recent_units"), before.alias("previous_units"))
    change = 100.0 * (F.col("recent_units") - F.col("previous_units")) / F.greatest(F.col("previous_units"), F.lit(1))
    return g.withColumn("sales_trend_percent", change)


def item_waste(wastage: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return wastage.groupBy(*scope, "Item_ID").agg(
        F.sum("Quantity_Wasted").alias("wastage_quantity"), F.sum("Cost_Impact").alias("wastage_cost")
    )


def scoped_ratings(ratings: DataFrame, sales: DataFrame) -> DataFrame:
    """Ratings of (order, dish) pairs that occur in the scoped sales."""
    pairs = sales.select("Order_ID", "Item_ID").distinct()
    return ratings.join(pairs, ["Order_ID", "Item_ID"], "left_semi")


def scoped_rating(ratings: DataFrame, sales: DataFrame) -> DataFrame:
    return rating_metrics(scoped_ratings(ratings, sales))


UNSOLD_ZEROES = (
    "sales", "revenue", "cost", "contribution", "orders", "customers", "discount", "profit_percent",
    "promotion_dependency", "active_days", "repeat_purchase_rate", "sales_trend_percent",
    "wastage_quantity", "wastage_cost", "Average_Rating", "Rating_Count",
)


def with_unsold(grouped: DataFrame, catalogue: DataFrame, history: DataFrame, scope: Sequence[str] = (), zeroes: Sequence[str] = UNSOLD_ZEROES) -> DataFrame:
    """Add zero-history rows for catalogue items that were never sold anywhere, in every scope there is."""
    missing = catalogue.select("Item_ID", "Item_Name", "Category_ID").join(
        history.select("Item_ID").distinct(), "Item_ID", "left_anti"
    )
    if scope:
        # One value per scope, as many as there are selling locations.
        places = history.select(F.struct(*scope).alias("place")).distinct().agg(F.collect_set("place")).scalar()
        missing = missing.withColumn("_place", F.explode(places)).select("*", *[F.col(f"_place.{c}").alias(c) for c in scope]).drop("_place")
    kinds = dict(grouped.dtypes)
    blank = missing.select(
        "*", *[F.lit(0).cast(kinds[c]).alias(c) for c in zeroes if c in kinds]
    )
    return grouped.unionByName(blank, allowMissingColumns=True)


def seasonality(sales: DataFrame, keys: Sequence[str] = ("Item_ID",)) -> DataFrame:
    """Selling months and the volume share of the three strongest calendar months."""
    monthly = sales.groupBy(*keys, F.month("Date").alias("month")).agg(F.sum("Quantity").alias("units"))
    # Twelve numbers per dish at most.
    months = monthly.groupBy(*keys).agg(F.sort_array(F.collect_list("units"), asc=False).alias("units"))
    top = F.aggregate(F.slice("units", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.aggregate("units", F.lit(0).cast("long"), lambda a, x: a + x)
    return months.select(*keys, F.size("units").alias("active_months"), ratio(top, whole, 0.0).alias("seasonal_top3_share"))


def history_days(
    grouped: DataFrame, menu: DataFrame, snapshot: Column, opening: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Days since introduction (or a later opening) and days since the last sale.

    Without a last sale the whole history counts; negative spans count as zero. ``keep`` names further columns of
    ``menu`` that the same join brings along.
    """
    joined = grouped.join(menu.select("Item_ID", "Introduced_Date", *keep), "Item_ID", "left")
    since = F.col("Introduced_Date")
    if opening is not None:
        since = F.when(since.isNotNull(), F.greatest(since, opening))
    span = F.greatest(F.coalesce(F.date_diff(snapshot, since) + 1, F.lit(0)), F.lit(0))
    gap = F.date_diff(snapshot, F.to_date("last_sale"))
    return joined.withColumn("history_days", span).withColumn(
        "days_since_last_purchase", F.greatest(F.coalesce(gap, F.col("history_days")), F.lit(0))
    ).drop("Introduced_Date")


def wastage_totals(wastage: DataFrame) -> DataFrame:
    return wastage.agg(F.sum("Cost_Impact").alias("total_cost"), F.sum("Quantity_Wasted").alias("total_quantity"))


def wastage_summary(wastage: DataFrame, n: int = 20) -> DataFrame:
    """Totals, the costliest dishes and the cost per location as one long table."""
    shape = lambda df, section, key, cost, qty: df.select(
        F.lit(section).alias("section"), key.cast("long").alias("id"), cost.alias("cost"), qty.cast("long").alias("quantity")
    )
    items = item_waste(wastage).orderBy(F.col("wastage_cost").desc(), "Item_ID").limit(n)
    places = wastage.groupBy("Location_ID").agg(F.sum("Cost_Impact").alias("cost"), F.sum("Quantity_Wasted").alias("quantity"))
    return (
        shape(wastage_totals(wastage), "total", F.lit(None), F.col("total_cost"), F.col("total_quantity"))
        .unionByName(shape(items, "item", F.col("Item_ID"), F.col("wastage_cost"), F.col("wastage_quantity")))
        .unionByName(shape(places, "location", F.col("Location_ID"), F.col("cost"), F.col("quantity")))
    )


def wastage_q3(wastage: DataFrame, key: str) -> DataFrame:
    """Waste per key over positive records; High from the third quartile of wasted units up."""
    g = wastage.where(F.col("Quantity_Wasted") > 0).groupBy(key).agg(
        F.sum("Quantity_Wasted").alias("Total_Wasted"), F.sum("Cost_Impact").alias("Total_Cost_Impact")
    )
    g = materialise(g)
    cut = ordering.quantile_value(g, "Total_Wasted", 0.75, stored=True)
    return g.withColumn("Risk_Level", F.when(F.col("Total_Wasted") >= F.lit(cut), "High").otherwise("Low"))


def channels(sales: DataFrame) -> DataFrame:
    g = summarise(sales, ["Channel"])
    return g.select(
        "Channel", F.col("units").alias("quantity"), "revenue", "contribution", "orders", "customers",
        ratio(F.col("revenue"), F.col("orders"), 0.0).alias("aov"),
    )


def locations(sales: DataFrame, wastage: DataFrame) -> DataFrame:
    """Location indicators with waste cost and the revenue rank (ties share the best place)."""
    waste = wastage.groupBy("Location_ID").agg(F.sum("Cost_Impact").alias("wastage_cost"))
    g = summarise(sales, ["Location_ID"]).select(
        "Location_ID", "revenue", "contribution", "orders", "customers",
        ratio(F.col("revenue"), F.col("orders")).alias("aov"),
        ratio(100 * F.col("contribution"), F.col("revenue")).alias("profit_percent"),
    )
    g = materialise(g.join(waste, "Location_ID", "left").fillna(0))
    return ordering.competition_rank(g, "revenue_rank", "revenue")


def by_key_line_mean(sales: DataFrame, key: Sequence[str]) -> DataFrame:
    """Gross revenue and orders per key; the 'order value' is the mean line value."""
    line = F.col("Quantity") * F.col("Unit_Price")
    return sales.groupBy(*key).agg(
        F.sum(line).alias("Total_Revenue"), F.count_distinct("Order_ID").alias("Total_Orders"),
        ratio(F.sum(line), F.count(line)).alias("Avg_Order_Value"),
    )


def city_revenue(unified: DataFrame) -> DataFrame:
    g = unified.groupBy("City").agg(F.sum(F.col("Quantity") * F.col("Unit_Price")).alias("Total_Revenue"))
    return g.orderBy(F.col("Total_Revenue").desc())


def customer(sales: DataFrame, customer_id: int) -> DataFrame:
    """One customer's orders, spend and last order; no row for a stranger."""
    own = sales.where(F.col("Customer_ID") == customer_id)
    return own.groupBy("Customer_ID").agg(
        F.count_distinct("Order_ID").alias("frequency"), F.sum("Net_Revenue").alias("monetary"),
        F.max("Order_DateTime").alias("last_order"),
    )


def order_counts(orders: DataFrame, **by: Column) -> DataFrame:
    """Orders per expression, for example ``Hour=F.hour("Order_DateTime")``."""
    return orders.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count(F.lit(1)).alias("Order_Count"))


def city_top_hour(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """Busiest hour per city, the earliest on ties."""
    placed = orders.join(locations.select("Location_ID", "City"), "Location_ID", "left")
    counts = order_counts(placed, City=F.col("City"), Hour=F.hour("Order_DateTime"))
    return nth_per(counts, ["City"], [F.col("Order_Count").desc(), F.col("Hour")])


def invalid_ratings(ratings: DataFrame) -> DataFrame:
    bad = ratings.where(~F.coalesce(F.col("Stars").between(1, 5), F.lit(False)))
    return bad.groupBy("Item_ID").agg(F.count(F.lit(1)).alias("Invalid_Rating_Count"))


def valid_ratings(ratings: DataFrame) -> DataFrame:
    return rating_metrics(ratings.where(F.col("Stars").between(1, 5)))


def price_change_label(prices: DataFrame, lines: DataFrame) -> DataFrame:
    """Mean change between consecutive list prices with a label, beside total demand."""
    moved = prices.withColumn("change", percent_change("Price", "Item_ID", ["Effective_Date", "Pricing_ID"]))
    mean = moved.groupBy("Item_ID").agg(F.avg("change").alias("Price_Change_Pct")).where(F.col("Price_Change_Pct").isNotNull())
    demand = lines.groupBy("Item_ID").agg(F.sum("Quantity").alias("Total_Demand"))
    size = F.abs(F.round("Price_Change_Pct", 9))
    label = (
        F.when(size > 10, "Highly Price Sensitive").when(size > 3, "Moderately Price Sensitive").otherwise("Low Price Sensitivity")
    )
    return mean.join(demand, "Item_ID", "left").withColumn("Sensitivity", label)


def promo_line_mean(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Volume and mean line value per tagged campaign against untagged lines."""
    line = F.col("Quantity") * F.col("Unit_Price")
    tagged = sales.where(F.col("Promotion_ID").isNotNull()).groupBy("Promotion_ID").agg(
        F.count_distinct("Order_ID").alias("Order_Volume"), F.sum(line).alias("Total_Revenue"),
        ratio(F.sum(line), F.count(line)).alias("Avg_Order_Value"),
    )
    plain = sales.where(F.col("Promotion_ID").isNull()).agg(ratio(F.sum(line), F.count(line))).scalar()
    trap = F.when(F.col("Avg_Order_Value") < plain, "Possible Trap (Lower AOV than non-promo)").otherwise("OK")
    known = promotions.select("Promotion_ID", "Promotion_Name")
    return known.join(tagged, "Promotion_ID", "left").withColumn("Trap_Flag", trap)


def profiles(segments: DataFrame) -> DataFrame:
    """Size and mean recency, frequency and spend per segment."""
    return segments.groupBy("Cluster", "Segment").agg(
        F.count(F.lit(1)).alias("size"), F.avg("Recency_Days").alias("average_recency"),
        F.avg("Frequency").alias("average_frequency"), F.avg("Monetary").alias("average_monetary"),
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("Segment").agg(F.count(F.lit(1)).alias("customers"))


def segments_page(segments: DataFrame, segment: str | None, limit: int, offset: int = 0) -> DataFrame:
    """Customers of a segment by spend."""
    chosen = segments if segment is None else segments.where(F.col("Segment") == segment)
    return chosen.orderBy(F.col("Monetary").desc(), "Customer_ID").offset(offset).limit(limit)


def slow_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("Slow_Moving_Status").agg(F.count(F.lit(1)).alias("items"))


def summary(menu: DataFrame, segments: DataFrame, places: DataFrame, recommendations: DataFrame, comparison: DataFrame) -> DataFrame:
    """Counts over finished report tables, in one row."""
    share = F.avg((F.col("Match_Status") == "Close Match").cast("double")) * 100
    return places.agg(F.sum("Total_Orders").alias("total_orders")).withColumns(
        {
            "segmented_customers": segments.agg(F.count(F.lit(1))).scalar(),
            "menu_items": menu.agg(F.count(F.lit(1))).scalar(),
            "critical_recommendations": recommendations.agg(F.count_if(F.col("Priority") == "Critical")).scalar(),
            "comparison_cases": comparison.agg(F.count(F.lit(1))).scalar(),
            "reported_agreement_percentage": comparison.agg(F.round(share, 2)).scalar(),
        }
    )
