"""The typed filter contract and campaign eligibility."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.scalar import same_text
from larder.sources import contract

# The filters each report accepts, the classes and the status names.
SUPPORTED = {
    "dashboard": {"date_from", "date_to", "location_id", "item_id", "category_id", "channel", "promotion_id"},
    "menu": {"date_from", "date_to", "location_id", "item_id", "category_id", "channel", "promotion_id",
             "performance_class", "rating", "slow_status"},
    "slow-moving": {"location_id", "category_id"},
    "customers": {"location_id", "segment"},
    "forecast": {"location_id"},
    "wastage": {"location_id"},
    "promotions": {"location_id"},
    "basket": set(),
}
CLASSES = ("Profit Driver", "Volume Driver", "Hidden Opportunity", "Low Performer")
SLOW_STATUSES = ("SLOW_MOVER", "WATCHLIST", "HIDDEN_OPPORTUNITY", "SEASONAL_REVIEW",
                 "INSUFFICIENT_HISTORY", "NO_OBSERVED_SALES", "NOT_SLOW")
RISKS = ("LOW", "MEDIUM", "HIGH")


@dataclass(frozen=True)
class Filters:
    """Optional filters of a report; dates are inclusive local days. The field names are fixed by the contract."""

    date_from: date | None = None
    date_to: date | None = None
    location_id: int | None = None
    item_id: int | None = None
    category_id: int | None = None
    channel: str | None = None
    promotion_id: int | None = None
    segment: str | None = None
    performance_class: str | None = None
    slow_status: str | None = None
    rating: float | None = None
    wastage_risk: str | None = None
    #: The channels there are; not a filter itself.
    channels: tuple[str, ...] = contract.CHANNELS

    def __post_init__(self):
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from lies after date_to")
        if self.rating is not None and not 1 <= self.rating <= 5:
            raise ValueError("rating must be between 1 and 5")
        for name, allowed in (("performance_class", CLASSES), ("slow_status", SLOW_STATUSES), ("wastage_risk", RISKS), ("channel", self.channels)):
            if getattr(self, name) not in (None, *allowed):
                raise ValueError(f"unknown {name}")
        for name in ("location_id", "item_id", "category_id", "promotion_id"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")

    def for_report(self, report: str) -> Filters:
        """The same filters, or an error if the report does not support one of them."""
        given = {f.name for f in fields(self) if getattr(self, f.name) is not None} - {"channels"}
        extra = sorted(given - SUPPORTED[report])
        if extra:
            raise ValueError(f"unsupported {report} filter: {', '.join(extra)}")
        return self


def _equal(pairs: dict[str, object]) -> Column:
    kept = F.lit(True)
    for column, value in pairs.items():
        if value is not None:
            kept = kept & (F.col(column) == F.lit(value))
    return kept


def between_days(column: str, start: date | None, end: date | None) -> Column:
    kept = F.lit(True)
    if start is not None:
        kept = kept & (F.col(column) >= F.lit(start))
    if end is not None:
        kept = kept & (F.col(column) <= F.lit(end))
    return kept


def apply_filters(sales: DataFrame, f: Filters, promotions: DataFrame | None = None) -> DataFrame:
    """Scoped sales. A campaign filter keeps lines eligible for it during its dates."""
    kept = sales.where(
        between_days("Date", f.date_from, f.date_to)
        & _equal({"Location_ID": f.location_id, "Item_ID": f.item_id, "Category_ID": f.category_id, "Channel": f.channel})
    )
    if f.promotion_id is not None:
        if promotions is None:
            raise ValueError("a campaign filter needs the campaigns")
        kept = eligible(kept, promotions.where(F.col("Promotion_ID") == f.promotion_id)).select(*sales.columns)
    return kept


def apply_wastage_filters(wastage: DataFrame, f: Filters, menu: DataFrame) -> DataFrame:
    """Wastage of a scope: dates, location, item and category, never channel or campaign."""
    kept = wastage.where(
        between_days("Wastage_Date", f.date_from, f.date_to) & _equal({"Location_ID": f.location_id, "Item_ID": f.item_id})
    )
    if f.category_id is not None:
        kept = kept.join(menu.where(F.col("Category_ID") == f.category_id).select("Item_ID"), "Item_ID", "left_semi")
    return kept


def scope(df: DataFrame, allowed: DataFrame, key: str = "Location_ID") -> DataFrame:
    """Rows of the allowed locations."""
    return df.join(allowed.select(key), key, "left_semi")


def having(df: DataFrame, f: Filters) -> DataFrame:
    """Selection after aggregation: class, minimum rating and slow-moving status."""
    kept = _equal({"classification": f.performance_class, "Slow_Moving_Status": f.slow_status,
                   "Item_ID": f.item_id, "Category_ID": f.category_id})
    if f.rating is not None:
        kept = kept & (F.col("Average_Rating") >= f.rating)
    return df.where(kept)


def casefold(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(same_text(F.col(column), value))


# -- campaigns ------------------------------------------------------------------------------

ANYTHING = -1


def within(lines: DataFrame, days: DataFrame) -> DataFrame:
    """Lines between the first and the last date of some calendar; the bounds reach the scan."""
    low, high = (days.agg(f("Date")).scalar() for f in (F.min, F.max))
    return lines.where(F.col("Date").between(low, high))


def target_keys(sales: DataFrame) -> DataFrame:
    """Each row of a reduced table three times over: as its dish, as its category and as any row."""
    kinds = F.array(
        F.struct(F.lit("item").alias("kind"), F.col("Item_ID").alias("target")),
        F.struct(F.lit("category").alias("kind"), F.col("Category_ID").alias("target")),
        F.struct(F.lit("any").alias("kind"), F.lit(ANYTHING).cast("long").alias("target")),
    )
    return sales.select("*", F.inline(kinds))


def on_target_days(lines: DataFrame, days: DataFrame) -> DataFrame:
    """Lines beside every campaign day that applies to them.

    Campaigns for a dish, for a category and for any line are joined apart, each on its own columns, so no
    line is repeated before it meets a campaign and only campaigns for any line meet by date alone.
    """
    near = within(lines, days)
    own = {"item": ["Item_ID"], "category": ["Category_ID"], "any": []}
    parts = []
    for kind, columns in own.items():
        some = days.where(F.col("kind") == kind).drop("kind")
        some = some.withColumnRenamed("target", columns[0]) if columns else some.drop("target")
        parts.append(near.join(some, [*columns, "Date"]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def campaign_targets(campaigns: DataFrame) -> DataFrame:
    """The kind and id a campaign applies to: a dish wins over a category, neither means any line."""
    item, category = F.col("Applicable_Item_ID"), F.col("Applicable_Category_ID")
    kind = F.when(item.isNotNull(), "item").when(category.isNotNull(), "category").otherwise("any")
    return campaigns.select(
        F.col("Promotion_ID").alias("Campaign_ID"),
        F.col("Location_ID").alias("Campaign_Location"),
        F.col("Start_Date").alias("Campaign_Start"),
        F.col("End_Date").alias("Campaign_End"),
        kind.alias("kind"),
        F.coalesce(item, category, F.lit(ANYTHING).cast("long")).alias("target"),
    )


def _here() -> Column:
    return F.col("Campaign_Location").isNull() | (F.col("Campaign_Location") == F.col("Location_ID"))


def eligible_for(sales: DataFrame, item: int | None = None, category: int | None = None, location: int | None = None) -> DataFrame:
    """Lines of all dates one campaign applies to."""
    target = {"Item_ID": item} if item is not None else {"Category_ID": category}
    return sales.where(_equal({**target, "Location_ID": location}))


def eligible(sales: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(campaign, line) pairs of lines inside the inclusive campaign dates.

    A campaign is spread over its dates, so even one for any line meets only the lines of its own days.
    """
    days = campaign_targets(campaigns).withColumn("Date", F.explode(F.sequence("Campaign_Start", "Campaign_End")))
    return on_target_days(sales, days).where(_here())
