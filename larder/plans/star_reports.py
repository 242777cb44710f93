"""The star join and its seven reports as one run over one stored fact."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larder.binding import Tables
from larder.operators import facts, metrics, quality
from larder.session import scratch_path

# What the seven reports read; the wide descriptive columns are not stored.
COLUMNS = (
    "Order_Item_ID", "Order_ID", "Item_ID", "Item_Name", "Category_ID", "Category_Name", "Location_ID", "Location_Name", "Local_Hour",
    "Channel", "Promotion_ID", "Promotion_Name", "Campaign_Eligible", "Quantity", "Unit_Price", "Net_Revenue", "Cost_Total", "Contribution",
    "Effective_Price", "Rating_Count", "Stock_Quantity", "Wastage_Quantity", "Wastage_Cost",
)


def star_fact(t: Tables) -> DataFrame:
    """All eleven tables joined at line grain, written once to shared storage."""
    joined = facts.integrated(
        t.lines, t.orders, t.menu, t.customers, t.categories, t.locations, promotions=t.promotions, ratings=t.ratings,
        inventory=t.inventory, wastage=t.wastage, prices=t.prices,
    )
    path = scratch_path(t.spark, "star")
    joined.select(*COLUMNS).write.parquet(path)
    return t.spark.read.parquet(path)


def star_reports(star: DataFrame) -> dict[str, DataFrame]:
    return {
        "menu": metrics.menu_profit(star),
        "locations": metrics.by_location(star),
        "peaks": metrics.peaks(star),
        "categories": metrics.by_category(star),
        "campaigns": metrics.by_campaign(star),
        "high_wastage": metrics.high_wastage(star),
        "channels": metrics.by_channel(star),
    }


def star_check(t: Tables, star: DataFrame) -> DataFrame:
    """The star join against the clean sales."""
    return quality.reconcile(star, t.sales)
