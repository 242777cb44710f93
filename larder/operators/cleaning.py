"""Cleaning rules and quarantine.

A rule is a name, a reason and a verdict column that is true for a bad row; a null verdict is bad
as well. ``quarantine`` lists the failures, ``accepted`` keeps the rows without any.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import calendar
from larder.functions.scalar import finite, fractional, known
from larder.functions.windows import nth_per


class Rule(NamedTuple):
    name: str
    reason: str
    bad: Column


class Cleaned(NamedTuple):
    rows: DataFrame
    rejections: DataFrame


def _verdict(rule: Rule) -> Column:
    return F.coalesce(rule.bad, F.lit(True))


def _failures(rules: Sequence[Rule], first_only: bool = False) -> Column:
    """The failed rules of a row as an array of (rule, reason)."""
    failed = F.filter(
        F.array(
            *[
                F.when(_verdict(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.reason).alias("reason")))
                for r in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    return F.slice(failed, 1, 1) if first_only else failed


def _listed(df: DataFrame, table: str, record: Column, failed: Column) -> DataFrame:
    return df.select(record.cast("string").alias("record_identifier"), F.explode(failed).alias("failure")).select(
        "record_identifier", F.lit(table).alias("source_table"), "failure.rule", "failure.reason",
        F.lit("quarantined").alias("action"),
    )


def quarantine(df: DataFrame, table: str, key: str, rules: Sequence[Rule], first_only: bool = False) -> DataFrame:
    """One row per record and failed rule; with ``first_only`` the first failure of a record."""
    return _listed(df, table, F.col(key), _failures(rules, first_only))


def accepted(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for rule in rules:
        df = df.where(~_verdict(rule))
    return df


def checked(df: DataFrame, table: str, key: str, rules: Sequence[Rule], first_only: bool = True) -> Cleaned:
    return Cleaned(accepted(df, rules), quarantine(df, table, key, rules, first_only))


def dedup_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row per key in an explicit total order."""
    return nth_per(df, [key], order)


def first_of_sound(df: DataFrame, key: str, sound: Column, order: Sequence[Column]) -> DataFrame:
    """The first row per key of the sound rows, and every unsound row.

    Each unsound row is a group of its own: it meets no sound row and does not gather in one task. Both kinds pass the
    same limit of one row per group, which Spark applies before the shuffle.
    """
    marked = df.withColumns({"_key": F.when(sound, F.col(key)), "_alone": F.when(~sound, F.monotonically_increasing_id())})
    return nth_per(marked, ["_key", "_alone"], order).drop("_key", "_alone")


def routed(judged: DataFrame, table: str) -> Cleaned:
    """Accepted rows and rejections of rows that carry all their verdicts: ``_failed`` and the ``_record`` they are reported under."""
    rows = judged.where(F.size("_failed") == 0).drop("_failed", "_record")
    return Cleaned(rows, _listed(judged, table, F.col("_record"), F.col("_failed")))


def with_known(df: DataFrame, dimension: DataFrame, key: str, flag: str, name: str | None = None) -> DataFrame:
    """Add a flag telling whether the key exists in a table."""
    keys = dimension.select(F.col(name or key).alias(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


# -- verdicts ----------------------------------------------------------------------------------
# Fixed texts: rule names and reasons, as they appear in the quarantine.


def finite_rules(columns: Sequence[str], reason: str) -> list[Rule]:
    return [Rule(f"finite_{c}", reason, ~finite(F.col(c))) for c in columns]


def channel_rule(channels: Sequence[str]) -> Rule:
    return Rule("known_channel", "Unknown ordering channel", ~known(F.col("Channel"), channels))


def integer_rule(column: str = "Quantity") -> Rule:
    return Rule("integer_quantity", "Quantity must be whole portions", fractional(F.col(column)))


def required_rule(columns: Sequence[str]) -> Rule:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return Rule("required_order_fields", "Missing ID or invalid timestamp", missing)


def line_value_rule() -> Rule:
    qty, price, off = F.col("Quantity"), F.col("Unit_Price"), F.col("Discount_Applied")
    missing = F.col("Order_Item_ID").isNull() | F.col("Order_ID").isNull() | F.col("Item_ID").isNull()
    good = (qty > 0) & (price > 0) & (off >= 0) & (off <= qty * price)
    return Rule("valid_line_values", "Missing reference or invalid quantity, price, or discount", missing | ~good)


def reference_rule(name: str, reason: str, *flags: str) -> Rule:
    unknown = F.lit(False)
    for flag in flags:
        unknown = unknown | ~F.col(flag)
    return Rule(name, reason, unknown)


# -- tables ------------------------------------------------------------------------------------


def clean_orders(raw: DataFrame, customers: DataFrame, locations: DataFrame, channels: Sequence[str], order: Sequence[Column]) -> Cleaned:
    """Known channel, ids and a readable timestamp on the restaurant clock, first row per id,
    known customer and location. Cancelled headers stay."""
    channel = channel_rule(channels)
    parsed = accepted(raw, [channel]).withColumns(
        {c: F.col(c).try_cast("long") for c in ("Order_ID", "Customer_ID", "Location_ID", "Promotion_ID")}
    ).withColumn("Order_DateTime", calendar.local_time(F.col("Order_DateTime").try_cast("timestamp")))
    required = required_rule(["Order_ID", "Customer_ID", "Location_ID", "Order_DateTime"])
    first = accepted(dedup_first(parsed, "Order_ID", order), [required])
    flagged = with_known(with_known(first, customers, "Customer_ID", "_customer"), locations, "Location_ID", "_location")
    reference = reference_rule("known_order_references", "Unknown customer or location", "_customer", "_location")
    rejections = (
        quarantine(raw, "Orders", "Order_ID", [channel])
        .unionByName(quarantine(parsed, "Orders", "Order_ID", [required]))
        .unionByName(quarantine(flagged, "Orders", "Order_ID", [reference]))
    )
    return Cleaned(accepted(flagged, [reference]).drop("_customer", "_location"), rejections)


def judged_lines(raw: DataFrame, orders: DataFrame, menu: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Order lines with all their verdicts, from one pass over ``raw``: finite whole quantities, first row per id, valid
    values, known order and dish."""
    shape = [*finite_rules(["Quantity", "Unit_Price", "Discount_Applied"], "Nonfinite financial or quantity value"), integer_rule()]
    numbers = raw.withColumns({"_record": F.col("Order_Item_ID").cast("string"), "_shape": _failures(shape, first_only=True)}).withColumns(
        {
            **{c: F.col(c).try_cast("long") for c in ("Order_Item_ID", "Order_ID", "Item_ID")},
            "Quantity": F.col("Quantity").try_cast("double").try_cast("long"),
            "Unit_Price": F.col("Unit_Price").try_cast("decimal(20,4)"),
            "Discount_Applied": F.col("Discount_Applied").try_cast("decimal(20,4)"),
        }
    )
    first = first_of_sound(numbers, "Order_Item_ID", F.size("_shape") == 0, order)
    flagged = with_known(with_known(first, menu, "Item_ID", "_item"), orders, "Order_ID", "_order")
    reference = reference_rule("known_line_references", "Unknown order or valid item", "_item", "_order")
    later = _failures([line_value_rule(), reference], first_only=True)
    return flagged.withColumn("_failed", F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(later)).drop("_shape", "_item", "_order")


def clean_lines(raw: DataFrame, orders: DataFrame, menu: DataFrame, order: Sequence[Column]) -> Cleaned:
    """Accepted order lines and the rejected ones."""
    return routed(judged_lines(raw, orders, menu, order), "Order_Items")


def clean_menu(menu: DataFrame, prices: DataFrame, order: Sequence[Column]) -> Cleaned:
    """Cost of at least zero and one positive price event; an invalid base price is only flagged."""
    shape = finite_rules(["Base_Price", "Cost"], "Nonfinite menu financial value")
    priced = prices.where(finite(F.col("Price")) & (F.col("Price") > 0)).select("Item_ID").distinct()
    kept = accepted(menu, shape).where(F.col("Cost") >= 0).join(priced, "Item_ID", "left_semi")
    first = dedup_first(kept, "Item_ID", order)
    flagged = first.withColumn("Base_Price_Valid", F.coalesce(F.col("Base_Price") > 0, F.lit(False)))
    return Cleaned(flagged, quarantine(menu, "Menu_Items", "Item_ID", shape, first_only=True))


def clean_prices(prices: DataFrame, menu: DataFrame, order: Sequence[Column]) -> Cleaned:
    shape = [Rule("finite_price", "Nonfinite price", ~finite(F.col("Price")))]
    kept = accepted(prices, shape).where(F.col("Price") > 0).join(menu.select("Item_ID"), "Item_ID", "left_semi")
    return Cleaned(dedup_first(kept, "Pricing_ID", order), quarantine(prices, "Pricing_History", "Pricing_ID", shape))


def clean_promotions(promotions: DataFrame, menu: DataFrame) -> DataFrame:
    """Campaigns whose targets exist; a campaign without a dish or category target stays."""
    flagged = with_known(promotions, menu, "Applicable_Item_ID", "_item", "Item_ID")
    flagged = with_known(flagged, menu, "Applicable_Category_ID", "_category", "Category_ID")
    fine = (F.col("Applicable_Item_ID").isNull() | F.col("_item")) & (F.col("Applicable_Category_ID").isNull() | F.col("_category"))
    return flagged.where(fine).drop("_item", "_category")


def clean_inventory(inventory: DataFrame, menu: DataFrame, locations: DataFrame, order: Sequence[Column]) -> DataFrame:
    first = dedup_first(inventory, "Inventory_ID", order)
    return first.join(menu.select("Item_ID"), "Item_ID", "left_semi").join(locations.select("Location_ID"), "Location_ID", "left_semi")


def clean_ratings(ratings: DataFrame, orders: DataFrame, menu: DataFrame, order: Sequence[Column]) -> Cleaned:
    """One to five stars on a completed order and a known dish."""
    first = dedup_first(ratings.withColumn("Stars", F.col("Stars").try_cast("long")), "Rating_ID", order)
    done = orders.where(F.col("Order_Status") == "Completed")
    flagged = with_known(with_known(first, done, "Order_ID", "_order"), menu, "Item_ID", "_item")
    rule = Rule(
        "valid_rating_references", "Invalid stars, order, or item",
        ~F.col("Stars").between(1, 5) | ~F.col("_order") | ~F.col("_item"),
    )
    kept = checked(flagged, "Ratings", "Rating_ID", [rule])
    return Cleaned(kept.rows.drop("_order", "_item"), kept.rejections)


WASTE_VALUES = ("Quantity_Wasted", "Cost_Impact", "Demand_Quantity", "Prepared_Quantity", "Quantity_Consumed")


def clean_wastage(raw: DataFrame, menu: DataFrame, locations: DataFrame, order: Sequence[Column]) -> Cleaned:
    """Finite balanced amounts, first row per id, known dish and location, valid date and values; one pass over ``raw``."""
    shape = [
        *finite_rules(WASTE_VALUES, "Nonfinite wastage value"),
        Rule("preparation_balance", "Consumed plus wasted exceeds prepared",
             F.col("Quantity_Consumed") + F.col("Quantity_Wasted") > F.col("Prepared_Quantity")),
    ]
    marked = raw.withColumns({"_record": F.col("Wastage_ID").cast("string"), "_shape": _failures(shape, first_only=True)})
    first = first_of_sound(marked, "Wastage_ID", F.size("_shape") == 0, order)
    flagged = with_known(with_known(first, menu, "Item_ID", "_item"), locations, "Location_ID", "_location")
    reference = reference_rule("known_wastage_references", "Unknown item or location", "_item", "_location")
    good = F.col("Wastage_Date").isNotNull() & (F.col("Quantity_Wasted") <= F.col("Prepared_Quantity"))
    for c in WASTE_VALUES:
        good = good & (F.col(c) >= 0)
    value = Rule("valid_wastage_values", "Invalid date or negative/impossible wastage value", ~good)
    failed = F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(_failures([reference, value]))
    return routed(flagged.withColumn("_failed", failed).drop("_shape", "_item", "_location"), "Wastage")


def fk_reject(df: DataFrame, key: str, dimension: DataFrame) -> Cleaned:
    """Rows with a known key, and the rest."""
    keys = dimension.select(key).distinct()
    return Cleaned(df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti"))
