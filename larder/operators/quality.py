"""Data quality: condition counts, stage counts, reconciliation and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import ordering
from larder.functions.scalar import TOTAL, ratio


def _long(df: DataFrame, names: list[str], label: str = "condition", value: str = "records") -> DataFrame:
    """One row of counters as (condition, records) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(n).cast("long").alias(value)) for n in names])
    return df.select(F.inline(pairs))


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows matching each condition; a null verdict counts as matching."""
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in conditions.items()])
    return _long(wide, list(conditions))


def duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias(name)).transform(_long, [name])


def orphans(df: DataFrame, key: str, dimension: DataFrame, name: str) -> DataFrame:
    """Rows whose key is null or not in the dimension."""
    return df.join(dimension.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias(name)).transform(_long, [name])


def stack(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def dq_profile(
    orders: DataFrame, lines: DataFrame, menu: DataFrame, prices: DataFrame, customers: DataFrame,
    locations: DataFrame, ratings: DataFrame, wastage: DataFrame,
) -> DataFrame:
    """The 22 detected-condition counters."""
    qty, price, off = _number("Quantity"), _number("Unit_Price"), _number("Discount_Applied")
    return stack([
        duplicates(orders, "Order_ID", "duplicate_order_headers"),
        duplicates(customers, "Customer_ID", "duplicate_customers"),
        counters(customers, missing_customer_names=F.col("Customer_Name").isNull()),
        counters(
            orders,
            missing_order_dates=F.col("Order_DateTime").isNull(),
            missing_order_ids=F.col("Order_ID").isNull(),
            invalid_order_statuses=~F.col("Order_Status").isin("Completed", "Cancelled"),
            cancelled_orders=F.col("Order_Status").eqNullSafe("Cancelled"),
        ),
        duplicates(lines, "Order_Item_ID", "duplicate_order_lines"),
        counters(
            lines,
            invalid_line_quantities=~(qty > 0),
            invalid_line_prices=~(price > 0),
            invalid_line_discounts=F.coalesce(~(off >= 0), F.lit(True)) | F.coalesce(off > qty * price, F.lit(False)),
        ),
        orphans(lines, "Order_ID", orders, "line_unknown_order_ids"),
        orphans(lines, "Item_ID", menu, "line_unknown_item_ids"),
        counters(menu, invalid_base_prices=~(_number("Base_Price") > 0)),
        counters(prices, invalid_history_prices=~(_number("Price") > 0)),
        counters(ratings, invalid_rating_stars=~_number("Stars").between(1, 5)),
        orphans(ratings, "Order_ID", orders, "rating_unknown_order_ids"),
        orphans(ratings, "Item_ID", menu, "rating_unknown_item_ids"),
        counters(
            wastage,
            invalid_wastage_quantities=~(_number("Quantity_Wasted") >= 0),
            invalid_wastage_costs=~(_number("Cost_Impact") >= 0),
        ),
        orphans(wastage, "Item_ID", menu, "wastage_unknown_item_ids"),
        orphans(wastage, "Location_ID", locations, "wastage_unknown_location_ids"),
    ])


def dq_basic(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Negative quantities, duplicate headers and missing dates."""
    return stack([
        counters(lines, negative_quantities=F.coalesce(_number("Quantity") < 0, F.lit(False))),
        duplicates(orders, "Order_ID", "duplicate_orders"),
        counters(orders, missing_order_dates=F.col("Order_DateTime").isNull()),
    ])


def quality_report(stages: dict[str, DataFrame], split: Sequence[tuple[DataFrame, dict[str, Column]]] = ()) -> DataFrame:
    """Rows at each stage of the pipeline; ``split`` names several stages of one frame, counted in one pass."""
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows") for name, df in stages.items()]
    together = [_long(df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()]), list(conditions), "stage", "rows") for df, conditions in split]
    return stack([*counted, *together])


def reconcile(integrated: DataFrame, authority: DataFrame) -> DataFrame:
    """Star join against the clean sales: rows, distinct lines, totals and missing references."""
    money = lambda c: F.sum(F.col(c).cast(TOTAL))
    wide = integrated.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("Order_Item_ID").alias("distinct_lines"),
        money("Net_Revenue").alias("net_revenue"), money("Cost_Total").alias("cost"), money("Contribution").alias("contribution"),
        F.count_if(F.col("Effective_Price").isNull()).alias("missing_price"),
        F.count_if(F.abs(F.col("Effective_Price") - F.col("Unit_Price")) > 0.01).alias("price_mismatch"),
        F.count_if(F.col("Promotion_ID").isNotNull() & F.col("Promotion_Name").isNull()).alias("missing_promotion"),
        F.count_if(F.col("Category_Name").isNull() | F.col("Location_Name").isNull()).alias("missing_dimension"),
    )
    known = authority.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("Net_Revenue").alias("net_revenue"), F.sum("Cost_Total").alias("cost"),
        F.sum("Contribution").alias("contribution"),
    )
    ours = ["rows", "distinct_lines", "net_revenue", "cost", "contribution", "missing_price", "price_mismatch", "missing_promotion", "missing_dimension"]
    pairs = lambda df, names: df.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast(TOTAL).alias("amount")) for n in names]))
    )
    side = pairs(known, ["rows", "net_revenue", "cost", "contribution"]).withColumnRenamed("amount", "authority")
    return pairs(wide, ours).join(side, "measure", "left")


def reconcile_gate(report: DataFrame, tolerance: float = 0.05) -> None:
    """Raise unless the star join kept the grain, the totals and every reference."""
    found = {r["measure"]: (r["amount"], r["authority"]) for r in report.collect()}
    problems = []
    if found["rows"][0] != found["rows"][1]:
        problems.append("join rows")
    if found["distinct_lines"][0] != found["rows"][0]:
        problems.append("line grain")
    problems += [k for k in ("missing_price", "price_mismatch", "missing_promotion", "missing_dimension") if found[k][0]]
    problems += [k for k in ("net_revenue", "cost", "contribution") if abs(float(found[k][0] or 0) - float(found[k][1] or 0)) > tolerance]
    if problems:
        raise ValueError(f"star join failed: {', '.join(problems)}")


def ledger_violations(inventory: DataFrame, wastage: DataFrame, menu: DataFrame) -> DataFrame:
    """Stock that does not close, preparations that do not add up, waste not valued at cost."""
    priced = wastage.join(menu.select("Item_ID", "Cost"), "Item_ID")
    closing = F.col("Opening_Stock") + F.col("Received_Quantity") - F.col("Consumed_Quantity") - F.col("Wasted_Quantity")
    return stack([
        counters(inventory, stock_balance=closing != F.col("Stock_Quantity")),
        counters(
            priced,
            preparation_balance=F.col("Quantity_Consumed") + F.col("Quantity_Wasted") != F.col("Prepared_Quantity"),
            wastage_cost=F.abs(F.round(F.col("Cost") * F.col("Quantity_Wasted"), 2) - F.col("Cost_Impact")) > 0.01,
        ),
    ])


def temporal_violations(
    orders: DataFrame, lines: DataFrame, ratings: DataFrame, customers: DataFrame, locations: DataFrame,
    menu: DataFrame, promotions: DataFrame,
) -> DataFrame:
    """Orders before signup, opening or introduction, ratings before orders, tags outside campaigns."""
    day = F.to_date("Order_DateTime")
    dated = orders.withColumn("day", day)
    return stack([
        counters(dated.join(customers.select("Customer_ID", "Signup_Date"), "Customer_ID"), order_before_signup=F.col("day") < F.col("Signup_Date")),
        counters(dated.join(locations.select("Location_ID", "Opening_Date"), "Location_ID"), order_before_opening=F.col("day") < F.col("Opening_Date")),
        counters(
            lines.join(dated.select("Order_ID", "day"), "Order_ID").join(menu.select("Item_ID", "Introduced_Date"), "Item_ID"),
            line_before_introduction=F.col("day") < F.col("Introduced_Date"),
        ),
        counters(ratings.join(dated.select("Order_ID", "day"), "Order_ID"), rating_before_order=F.to_date("Rating_Date") < F.col("day")),
        counters(
            dated.join(promotions.select("Promotion_ID", "Start_Date", "End_Date"), "Promotion_ID"),
            tag_outside_campaign=~F.col("day").between(F.col("Start_Date"), F.col("End_Date")),
        ),
    ])


def scenario_metrics(sales: DataFrame, wastage: DataFrame, ratings: DataFrame, rating_day: str = "Rating_Date") -> DataFrame:
    """Per dish: loss, neglect, waste, month, place, weekend, half-year and campaign skew, rating bursts."""
    units = lambda c: F.sum(F.when(c, F.col("Quantity")).otherwise(0))
    weekend, early = F.weekday("Date") >= 5, F.month("Date") <= 6
    base = sales.groupBy("Item_ID").agg(
        F.sum("Quantity").alias("units"), F.sum("Contribution").alias("contribution"),
        units(weekend).alias("weekend"), units(~weekend).alias("weekday"),
        units(early).alias("first_half"), units(~early).alias("second_half"),
        units(F.col("Discount_Applied") > 0).alias("promoted"), units(F.col("Discount_Applied") == 0).alias("plain"),
        *[units(F.month("Date") == m).alias(f"m{m}") for m in range(1, 13)],
    )
    places = sales.groupBy("Item_ID", "Location_ID").agg(F.sum("Quantity").alias("here"))
    strongest = places.groupBy("Item_ID").agg(F.max("here").alias("top_location"), F.min("here").alias("low_location"))
    waste = wastage.groupBy("Item_ID").agg(F.sum("Quantity_Wasted").alias("wasted"))
    daily = ratings.groupBy("Item_ID", F.to_date(rating_day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("Stars").alias("stars"))
    rated = daily.groupBy("Item_ID").agg(F.max("n").alias("largest_burst"), F.sum("stars").alias("stars"), F.sum("n").alias("ratings"))
    joined = base.join(strongest, "Item_ID").join(waste, "Item_ID", "left").join(rated, "Item_ID", "left")
    median = ordering.quantile_value(base.select("units"), "units", 0.5)
    top_month = F.greatest(*[F.col(f"m{m}") for m in range(1, 13)])
    return joined.select(
        "Item_ID", "units", "contribution", F.col("wasted"), F.col("largest_burst"),
        F.round(ratio(F.col("wasted"), F.col("units")), 8).alias("waste_ratio"),
        F.round(ratio(top_month, F.col("units")), 8).alias("top_month_share"),
        F.round(ratio(F.col("top_location"), F.col("low_location")), 8).alias("location_skew"),
        F.round(ratio(F.col("weekend"), F.col("weekday")), 8).alias("weekend_ratio"),
        F.round(ratio(F.col("first_half"), F.col("second_half")), 8).alias("half_year_ratio"),
        F.round(ratio(F.col("promoted"), F.col("plain")), 8).alias("promotion_ratio"),
        F.round(ratio(F.col("stars"), F.col("ratings")), 8).alias("average_stars"),
        ((F.col("units") > 5 * median) & (F.col("contribution") < 0)).alias("popular_loss"),
        ((F.col("units") < median / 10) & (F.col("contribution") > 0)).alias("hidden_profit"),
    )
