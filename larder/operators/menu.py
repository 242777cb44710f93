"""Menu classes and slow-moving assessment as column rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import ordering
from larder.functions.scalar import clip, ratio, round_exact
from larder.functions.windows import first_of
from larder.operators import metrics
from larder.session import materialise

# Rule versions, evidence weights and the limits of both rule sets.
CLASS_RULES = "menu-multifactor-v1"
SLOW_RULES = "slow-moving-multifactor-v1"
WEIGHTS = {"volume": 0.25, "margin": 0.25, "rating": 0.12, "repeat": 0.10, "waste": 0.10, "promotion": 0.10, "trend": 0.08}
YOUNG_DAYS, FEW_ORDERS = 30, 20
HIGH_VOLUME, HEALTHY_MARGIN, TIDY_WASTE = 0.55, 0.5, 15
ENOUGH_RATINGS, FAIR_RATING, GOOD_RATING = 5, 3.5, 4
FALLING_TREND, OWN_MERIT, LOYAL_SHARE = -30, 0.35, 0.2
LOW_SHARE, STRONG_MARGIN = 0.35, 0.60
FADING_TREND, STALE_DAYS, WEAK_REPEAT, STEADY_REPEAT = -20, 30, 0.10, 0.15
GRAVE_DAYS, GRAVE_TREND, GRAVE_WASTE = 60, -40, 30
KNOWN_DAYS, SEASON_DAYS, SEASON_MONTHS, SEASON_SHARE = 90, 180, 4, 0.70


def menu_facts(
    sales: DataFrame, wastage: DataFrame, ratings: DataFrame, end: Column, catalogue: DataFrame | None = None,
    history: DataFrame | None = None, scope: Sequence[str] = (),
) -> DataFrame:
    """Everything the menu rules read, one row per dish (and per scope).

    With a catalogue, dishes never sold anywhere in ``history`` join with zeroes.
    """
    keys = [*scope, "Item_ID"]
    g = metrics.menu_scoped(sales, scope)
    g = g.join(metrics.trend(sales, end, keys=keys).select(*keys, "sales_trend_percent"), keys, "left")
    g = g.join(metrics.item_waste(wastage, scope), keys, "left").fillna(0, ["wastage_quantity", "wastage_cost"])
    pairs = sales.select("Order_ID", "Item_ID", *scope).distinct()
    rated = metrics.rating_metrics(ratings.select("Order_ID", "Item_ID", "Stars").join(pairs, ["Order_ID", "Item_ID"]), scope)
    g = g.join(rated, keys, "left")
    if catalogue is not None:
        g = metrics.with_unsold(g, catalogue, sales if history is None else history, scope)
    return g


def with_rates(g: DataFrame) -> DataFrame:
    """Missing rates as zero, and the waste share of sold plus wasted units."""
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in
            ("repeat_purchase_rate", "sales_trend_percent", "Average_Rating", "Rating_Count", "promotion_dependency")}
    g = g.withColumns(zero)
    waste = 100 * F.col("wastage_quantity")
    return g.withColumn("wastage_percent", ratio(waste, F.col("sales") + F.col("wastage_quantity"), 0.0))


def classify_items(g: DataFrame) -> DataFrame:
    """Percentiles, waste share, evidence score and one of four classes per dish."""
    g = with_rates(g)
    g = g.withColumn("insufficient_history", (F.col("active_days") < YOUNG_DAYS) | (F.col("orders") < FEW_ORDERS))
    g = ordering.percent_ranks(materialise(g), {"sales_percentile": "sales", "margin_percentile": "profit_percent"})
    share = lambda c: clip(c, 0.0, 1.0)
    evidence = {
        "volume": F.col("sales_percentile"),
        "margin": F.col("margin_percentile"),
        "rating": share(F.col("Average_Rating") / 5),
        "repeat": share(F.col("repeat_purchase_rate")),
        "waste": share(1 - F.col("wastage_percent") / 100),
        "promotion": share(1 - F.col("promotion_dependency")),
        "trend": share((F.col("sales_trend_percent") + 100) / 200),
    }
    score = sum((F.lit(WEIGHTS[name]) * value for name, value in evidence.items()), F.lit(0.0))
    popular = (F.col("sales") > 0) & (F.col("sales_percentile") >= HIGH_VOLUME)
    healthy = (F.col("contribution") > 0) & (F.col("margin_percentile") >= HEALTHY_MARGIN)
    tidy = F.col("wastage_percent") <= TIDY_WASTE
    often_rated = F.col("Rating_Count") >= ENOUGH_RATINGS
    liked = ~often_rated | (F.col("Average_Rating") >= FAIR_RATING)
    steady = F.col("sales_trend_percent") >= FALLING_TREND
    own_merit = F.col("promotion_dependency") <= OWN_MERIT
    promising = (often_rated & (F.col("Average_Rating") >= GOOD_RATING)) | (F.col("repeat_purchase_rate") >= LOYAL_SHARE)
    label = (
        F.when(popular & healthy & tidy & liked & steady & own_merit, "Profit Driver")
        .when(popular, "Volume Driver")
        .when(healthy & tidy & promising, "Hidden Opportunity")
        .otherwise("Low Performer")
    )
    return g.withColumns(
        {"evidence_score": score, "classification": label, "classification_rule_version": F.lit(CLASS_RULES)}
    ).withColumn("classification_evidence", class_evidence())


def class_evidence() -> Column:
    """What a class rests on, rounded."""
    return F.struct(
        round_exact(F.col("sales_percentile"), 4).alias("sales_percentile"),
        round_exact(F.col("profit_percent"), 2).alias("profit_percent"),
        round_exact(F.col("Average_Rating"), 2).alias("rating"),
        round_exact(F.col("repeat_purchase_rate"), 4).alias("repeat_purchase_rate"),
        round_exact(F.col("wastage_percent"), 2).alias("wastage_percent"),
        round_exact(F.col("promotion_dependency"), 4).alias("promotion_dependency"),
        round_exact(F.col("sales_trend_percent"), 2).alias("sales_trend_percent"),
        F.col("insufficient_history"),
    )


def global_sales(sales: DataFrame) -> DataFrame:
    """Units of each dish over all scopes."""
    return sales.groupBy("Item_ID").agg(F.sum("Quantity").alias("global_sales"))


def with_global_sales(g: DataFrame, sales: DataFrame) -> DataFrame:
    return g.join(global_sales(sales), "Item_ID", "left").fillna({"global_sales": 0})


def slow_facts(
    classified: DataFrame, sales: DataFrame, menu: DataFrame, snapshot: Column, opening: Column | None = None,
    scope_name: str = "GLOBAL",
) -> DataFrame:
    """History, recency and seasonality of each dish in one scope."""
    g = with_global_sales(metrics.history_days(classified, menu, snapshot, opening), sales)
    g = g.join(metrics.seasonality(sales), "Item_ID", "left").fillna({"active_months": 0, "seasonal_top3_share": 0.0})
    return g.withColumn("Scope", F.lit(scope_name))


def slow_facts_by_location(
    rated: DataFrame, sales: DataFrame, menu: DataFrame, locations: DataFrame, snapshot: Column
) -> DataFrame:
    """The same for all locations at once; a dish is known from introduction or opening on.

    Seasons join first, as the rows lie by location and dish already; what is known of a dish everywhere joins as one
    table. So the wide rows travel once and not three times.
    """
    opened = locations.select("Location_ID", "Opening_Date")
    season = metrics.seasonality(sales, ["Location_ID", "Item_ID"])
    g = rated.join(season, ["Location_ID", "Item_ID"], "left").fillna({"active_months": 0, "seasonal_top3_share": 0.0})
    known = menu.select("Item_ID", "Introduced_Date").join(global_sales(sales), "Item_ID", "full_outer")
    g = metrics.history_days(g.join(opened, "Location_ID"), known, snapshot, F.col("Opening_Date"), ["global_sales"]).drop("Opening_Date")
    g = g.fillna({"global_sales": 0})
    return g.withColumn("Scope", F.concat(F.lit("LOCATION_"), F.col("Location_ID").cast("string")))


def assess_slow_moving(g: DataFrame, scope: str = "Scope") -> DataFrame:
    """Status, severity, reason, action and evidence; ranks are relative to each scope."""
    per_30 = 30 * F.col("orders") / F.greatest(F.col("history_days"), F.lit(1))
    g = materialise(g.withColumn("_orders_per_30_days", per_30))
    g = ordering.percent_ranks(
        g, {"_volume": "sales", "_frequency": "_orders_per_30_days", "_margin": "profit_percent"}, [scope]
    )
    recency, trend, repeat = F.col("days_since_last_purchase"), F.col("sales_trend_percent"), F.col("repeat_purchase_rate")
    waste, rated = F.col("wastage_percent"), F.col("Rating_Count")
    low_volume, low_frequency = F.col("_volume") <= LOW_SHARE, F.col("_frequency") <= LOW_SHARE
    fading = (trend <= FADING_TREND) | (recency >= STALE_DAYS)
    weak = (repeat <= WEAK_REPEAT) | (F.col("contribution") <= 0) | (F.col("_margin") <= LOW_SHARE) | (waste >= TIDY_WASTE)
    strong_margin = (F.col("contribution") > 0) & (F.col("_margin") >= STRONG_MARGIN)
    wanted = ((rated >= ENOUGH_RATINGS) & (F.col("Average_Rating") >= GOOD_RATING)) | (trend >= 0) | (repeat >= STEADY_REPEAT)
    seasonal = (
        (F.col("history_days") >= SEASON_DAYS) & (F.col("active_months") >= SEASON_MONTHS) & (F.col("seasonal_top3_share") >= SEASON_SHARE)
    )
    high = (recency >= GRAVE_DAYS) | (trend <= GRAVE_TREND) | (waste >= GRAVE_WASTE)
    # Fixed texts: status, severity, reason and action of each outcome, first match wins.
    outcomes = [
        (F.col("history_days") < KNOWN_DAYS, "INSUFFICIENT_HISTORY", F.lit("UNDETERMINED"),
         "Fewer than 90 calendar days since introduction; demand pattern is immature.",
         "Continue observing; review after at least 90 days of availability."),
        (F.col("sales") == 0, "NO_OBSERVED_SALES", F.lit("REVIEW"),
         "No completed sales in this scope; local availability is not proven.",
         "Verify listing, stock, and availability before judging demand."),
        (seasonal, "SEASONAL_REVIEW", F.lit("REVIEW"),
         "At least 70% of volume falls in three months; one year cannot prove recurring seasonality.",
         "Review seasonal timing and stock; avoid permanent removal from one off-season."),
        (low_volume & strong_margin & wanted, "HIDDEN_OPPORTUNITY", F.lit("LOW"),
         "Low relative volume with healthy contribution and quality or positive demand momentum.",
         "Test visibility and placement before reducing menu presence."),
        (low_volume & low_frequency & fading & weak, "SLOW_MOVER", F.when(high, "HIGH").otherwise("MEDIUM"),
         "Low relative volume and order frequency with declining or stale demand, plus weak repeats or economics.",
         "Review local menu placement, preparation, and stock; test changes before removal."),
        (low_volume & low_frequency & weak, "WATCHLIST", F.lit("LOW"),
         "Low relative volume and order frequency with weak repeats or economics; demand decline is unconfirmed.",
         "Monitor trend, repeat purchasing, and waste before intervening."),
        (F.lit(True), "NOT_SLOW", F.lit("NONE"),
         "The combined slow-moving conditions are not met in this scope.", "Continue normal monitoring."),
    ]
    verdict = F.coalesce(
        *[
            F.when(test, F.struct(F.lit(status).alias("Slow_Moving_Status"), severity.alias("Severity"),
                                  F.lit(reason).alias("Reason"), F.lit(action).alias("Recommended_Action")))
            for test, status, severity, reason, action in outcomes
        ]
    )
    known_everywhere = F.col("global_sales").cast("long") if "global_sales" in g.columns else F.lit(None).cast("long")
    evidence = F.struct(
        F.col("sales").cast("long").alias("sales"),
        round_exact(F.col("_volume"), 4).alias("volume_percentile"),
        F.col("orders").cast("long").alias("orders"),
        round_exact(F.col("_orders_per_30_days"), 2).alias("orders_per_30_days"),
        round_exact(F.col("_frequency"), 4).alias("order_frequency_percentile"),
        recency.cast("int").alias("days_since_last_purchase"),
        round_exact(trend, 2).alias("recent_trend_percent"),
        round_exact(repeat, 4).alias("repeat_purchase_rate"),
        round_exact(F.col("profit_percent"), 2).alias("profit_percent"),
        round_exact(F.col("contribution"), 2).alias("contribution"),
        round_exact(waste, 2).alias("wastage_percent"),
        round_exact(F.col("seasonal_top3_share"), 4).alias("seasonal_top3_month_share"),
        F.col("active_months").cast("int").alias("active_months"),
        F.col("history_days").cast("int").alias("history_days"),
        F.col(scope).alias("location_context"),
        known_everywhere.alias("global_sales"),
    )
    assessed = g.withColumn("_verdict", verdict).withColumn("Evidence", evidence)
    return assessed.select(
        *[c for c in g.columns if not c.startswith("_")], "_verdict.*", "Evidence",
        F.when(F.col("history_days") < KNOWN_DAYS, "INSUFFICIENT").otherwise("ESTABLISHED").alias("History_Status"),
        F.lit(SLOW_RULES).alias("Slow_Moving_Rule_Version"),
    )


def menu_item(assessed: DataFrame, item_id: int) -> DataFrame:
    """One dish of a finished report; its ranks were taken over the whole scope."""
    return assessed.where(F.col("Item_ID") == item_id)


# -- median rules ------------------------------------------------------------------------------


def item_stats(
    sales: DataFrame, menu: DataFrame, ratings: DataFrame, wastage: DataFrame
) -> DataFrame:
    """Gross revenue, tagged-line share, cost, profit, rating and waste per dish."""
    line = F.col("Quantity") * F.col("Unit_Price")
    opens = F.col("_opens") & F.col("Order_ID").isNotNull()
    g = sales.repartition("Item_ID", "Order_ID").withColumn("_opens", first_of(["Item_ID", "Order_ID"])).groupBy("Item_ID").agg(
        F.sum("Quantity").alias("Total_Quantity_Sold"), F.sum(line).alias("Total_Revenue"),
        F.count_if(opens).alias("Order_Count"), F.count("Promotion_ID").alias("Promo_Order_Count"),
    )
    rated = ratings.where(F.col("Stars") <= 5).groupBy("Item_ID").agg(F.avg("Stars").alias("Avg_Rating"))
    wasted = wastage.where(F.col("Quantity_Wasted") > 0).groupBy("Item_ID").agg(F.sum("Quantity_Wasted").alias("Total_Wasted"))
    g = g.join(menu.select("Item_ID", "Item_Name", "Cost", "Base_Price"), "Item_ID", "left")
    g = g.join(rated, "Item_ID", "left").join(wasted, "Item_ID", "left").fillna(0, ["Total_Wasted"])
    cost = F.col("Total_Quantity_Sold") * F.col("Cost")
    profit = F.col("Total_Revenue") - cost
    percent = lambda a, b: F.round(ratio(a, b) * 100, 2)
    return g.withColumns(
        {
            "Promotion_Dependency_Pct": percent(F.col("Promo_Order_Count"), F.col("Order_Count")),
            "Total_Cost": cost,
            "Total_Profit": profit,
            "Profit_Pct": percent(profit, F.col("Total_Revenue")),
            "Wastage_Pct": percent(F.col("Total_Wasted"), F.col("Total_Quantity_Sold") + F.col("Total_Wasted")),
        }
    )


def location_item_stats(sales: DataFrame, menu: DataFrame) -> DataFrame:
    line = F.col("Quantity") * F.col("Unit_Price")
    g = sales.groupBy("Location_ID", "Item_ID").agg(
        F.sum("Quantity").alias("Total_Quantity_Sold"), F.sum(line).alias("Total_Revenue")
    )
    g = g.join(menu.select("Item_ID", "Item_Name", "Cost"), "Item_ID", "left")
    profit = F.col("Total_Revenue") - F.col("Total_Quantity_Sold") * F.col("Cost")
    return g.withColumn("Total_Profit", profit).withColumn(
        "Profit_Pct", F.round(ratio(profit, F.col("Total_Revenue")) * 100, 2)
    )


def median_classes(stats: DataFrame) -> DataFrame:
    """Four classes by the medians of volume and profit share, whatever the grain of the rows."""
    stats = materialise(stats)
    middle = ordering.quantile_values(stats, {"volume": ("Total_Quantity_Sold", 0.5), "profit": ("Profit_Pct", 0.5)}, stored=True)
    volume, profit = middle["volume"], middle["profit"]
    popular = F.col("Total_Quantity_Sold") >= F.lit(volume)
    rich = F.col("Profit_Pct") >= F.lit(profit)
    label = (
        F.when(popular & rich, "Profit Driver").when(popular, "Volume Driver").when(rich, "Hidden Opportunity").otherwise("Low Performer")
    )
    return stats.withColumns(
        {"Performance_Class": label, "Volume_Median": F.lit(volume), "Profit_Median": F.lit(profit)}
    )


def tricky_cases(classes: DataFrame) -> DataFrame:
    """One row per dish and contradiction."""
    popular = F.col("Total_Quantity_Sold") >= F.col("Volume_Median")
    rich = F.col("Profit_Pct") >= F.col("Profit_Median")
    cases = {
        "High-selling but loss-making": popular & (F.col("Total_Profit") < 0),
        "High-margin but rarely purchased": rich & (F.col("Total_Quantity_Sold") < F.col("Volume_Median") * 0.3),
        "Popular but excessive wastage": popular & (F.col("Wastage_Pct") > 20),
        "Highly rated but poor profitability": (F.col("Avg_Rating") >= 4.5) & (F.col("Profit_Pct") < F.col("Profit_Median")),
        "Promotion-dependent dish": F.col("Promotion_Dependency_Pct") > 50,
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in cases.items()]))
    return classes.select("Item_ID", "Item_Name", F.explode(found).alias("Case"))


def waste_ratio_q3(wastage: DataFrame, lines: DataFrame) -> DataFrame:
    """Waste share of demand plus waste per dish; label 1 from the third quartile up."""
    g = wastage.where(F.col("Quantity_Wasted") > 0).groupBy("Item_ID").agg(
        F.sum("Quantity_Wasted").alias("Total_Wasted"), F.count("Wastage_ID").alias("Wastage_Events")
    )
    demand = lines.groupBy("Item_ID").agg(F.sum("Quantity").alias("Historical_Demand"))
    g = g.join(demand, "Item_ID", "left").fillna(0, ["Historical_Demand"])
    g = materialise(
        g.withColumn("Wastage_Ratio", ratio(F.col("Total_Wasted"), F.col("Historical_Demand") + F.col("Total_Wasted")))
    )
    cut = ordering.quantile_value(g, "Wastage_Ratio", 0.75, stored=True)
    return g.withColumn("Risk_Label", (F.col("Wastage_Ratio") >= F.lit(cut)).cast("int"))
