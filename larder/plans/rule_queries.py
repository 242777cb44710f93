"""Decision rules, event windows, baskets and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.binding import Tables
from larder.functions import ordering, scalar, windows
from larder.operators import advice, basket, customers, events, facts, filters, menu, metrics, stats
from larder.plans.registry import query
from larder.plans.sales_queries import CAMPAIGN_MATCH, RFM_SQL, SCOPED, STAR
from larder.session import materialise


def newest(t: Tables):
    return t.sales.agg(F.max("Order_DateTime")).scalar()


def last_day(t: Tables):
    return t.sales.agg(F.max("Date")).scalar()


def graded(t: Tables):
    return menu.classify_items(menu.menu_facts(t.sales, t.wastage, t.ratings, newest(t), catalogue=t.menu))


def assessed(t: Tables):
    g = menu.slow_facts(graded(t), t.sales, t.menu, last_day(t))
    return menu.assess_slow_moving(g)


def average_rank(column: str, part: str = "") -> str:
    return (
        f"(rank() OVER ({part} ORDER BY {column}) + (count(*) OVER ({part or 'PARTITION BY 1'}, {column}) - 1) / 2.0)"
        f" / count(*) OVER ({part})"
    )


RULES = {
    **STAR, **SCOPED,
    "rated_pairs": """SELECT Item_ID, avg(Stars) AS Average_Rating, count(*) AS Rating_Count FROM ratings WHERE (Order_ID, Item_ID) IN (SELECT Order_ID, Item_ID FROM sales) GROUP BY 1""",
    "base": """SELECT m.Item_ID, m.Introduced_Date, s.last_sale, coalesce(s.sales, 0) AS sales, coalesce(CAST(s.revenue AS DOUBLE), 0) AS revenue,
        coalesce(CAST(s.contribution AS DOUBLE), 0) AS contribution, coalesce(s.orders, 0) AS orders, coalesce(s.profit_percent, 0) AS profit_percent,
        coalesce(s.promotion_dependency, 0) AS promotion_dependency, coalesce(s.active_days, 0) AS active_days, coalesce(s.repeat_purchase_rate, 0) AS repeat_purchase_rate,
        coalesce(t.sales_trend_percent, 0) AS sales_trend_percent, CASE WHEN s.Item_ID IS NULL THEN 0 ELSE coalesce(w.wastage_quantity, 0) END AS wastage_quantity,
        CASE WHEN s.Item_ID IS NULL THEN 0 ELSE coalesce(r.Average_Rating, 0) END AS Average_Rating, CASE WHEN s.Item_ID IS NULL THEN 0 ELSE coalesce(r.Rating_Count, 0) END AS Rating_Count
        FROM menu m LEFT JOIN menu_scoped s USING (Item_ID) LEFT JOIN trend t USING (Item_ID) LEFT JOIN waste_item w USING (Item_ID) LEFT JOIN rated_pairs r USING (Item_ID)""",
    "ranked": f"""SELECT *, {average_rank('sales')} AS sales_percentile, {average_rank('profit_percent')} AS margin_percentile,
        coalesce(CAST(100 * wastage_quantity AS DOUBLE) / nullif(CAST(sales + wastage_quantity AS DOUBLE), 0), 0) AS wastage_percent, active_days < 30 OR orders < 20 AS insufficient_history FROM base""",
    "classed": """SELECT *, 0.25 * sales_percentile + 0.25 * margin_percentile + 0.12 * least(greatest(Average_Rating / 5, 0), 1) + 0.10 * least(greatest(repeat_purchase_rate, 0), 1)
        + 0.10 * least(greatest(1 - wastage_percent / 100, 0), 1) + 0.10 * least(greatest(1 - promotion_dependency, 0), 1) + 0.08 * least(greatest((sales_trend_percent + 100) / 200, 0), 1) AS evidence_score,
        CASE WHEN sales > 0 AND sales_percentile >= 0.55 AND contribution > 0 AND margin_percentile >= 0.5 AND wastage_percent <= 15 AND (Rating_Count < 5 OR Average_Rating >= 3.5)
              AND sales_trend_percent >= -30 AND promotion_dependency <= 0.35 THEN 'Profit Driver'
             WHEN sales > 0 AND sales_percentile >= 0.55 THEN 'Volume Driver'
             WHEN contribution > 0 AND margin_percentile >= 0.5 AND wastage_percent <= 15 AND ((Rating_Count >= 5 AND Average_Rating >= 4) OR repeat_purchase_rate >= 0.2) THEN 'Hidden Opportunity'
             ELSE 'Low Performer' END AS classification FROM ranked""",
    "season": """SELECT Item_ID, count(*) AS active_months, CAST(sum(CASE WHEN rn <= 3 THEN q ELSE 0 END) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS top3 FROM
        (SELECT Item_ID, month(Date) AS m, sum(Quantity) AS q, row_number() OVER (PARTITION BY Item_ID ORDER BY sum(Quantity) DESC) AS rn FROM sales GROUP BY 1, 2) GROUP BY 1""",
    "dated": """SELECT c.*, greatest(date_diff('day', Introduced_Date, d) + 1, 0) AS history_days,
        greatest(coalesce(date_diff('day', CAST(last_sale AS DATE), d), greatest(date_diff('day', Introduced_Date, d) + 1, 0)), 0) AS recency,
        coalesce(active_months, 0) AS active_months, coalesce(top3, 0) AS top3, 'GLOBAL' AS Scope FROM classed c LEFT JOIN season USING (Item_ID), (SELECT max(Date) AS d FROM sales)""",
}


def slow_sql(source: str, part: str, keys: str) -> str:
    """Slow-moving status over a table of dish facts, ranked within ``part``."""
    return f"""SELECT {keys}, CASE WHEN history_days < 90 THEN 'INSUFFICIENT_HISTORY' WHEN sales = 0 THEN 'NO_OBSERVED_SALES'
        WHEN history_days >= 180 AND active_months >= 4 AND top3 >= 0.70 THEN 'SEASONAL_REVIEW'
        WHEN vol <= 0.35 AND contribution > 0 AND mar >= 0.60 AND ((Rating_Count >= 5 AND Average_Rating >= 4) OR sales_trend_percent >= 0 OR repeat_purchase_rate >= 0.15) THEN 'HIDDEN_OPPORTUNITY'
        WHEN vol <= 0.35 AND fre <= 0.35 AND (sales_trend_percent <= -20 OR recency >= 30) AND (repeat_purchase_rate <= 0.10 OR contribution <= 0 OR mar <= 0.35 OR wastage_percent >= 15) THEN 'SLOW_MOVER'
        WHEN vol <= 0.35 AND fre <= 0.35 AND (repeat_purchase_rate <= 0.10 OR contribution <= 0 OR mar <= 0.35 OR wastage_percent >= 15) THEN 'WATCHLIST' ELSE 'NOT_SLOW' END AS Slow_Moving_Status,
        recency >= 60 OR sales_trend_percent <= -40 OR wastage_percent >= 30 AS grave, round(vol, 8) AS vol, round(fre, 8) AS fre, round(mar, 8) AS mar, history_days, recency
        FROM (SELECT *, {average_rank('sales', part)} AS vol, {average_rank('per_30', part)} AS fre, {average_rank('profit_percent', part)} AS mar
              FROM (SELECT *, 30 * orders / greatest(history_days, 1) AS per_30 FROM {source}))"""


SLOW_OUT = """Slow_Moving_Status, CASE Slow_Moving_Status WHEN 'INSUFFICIENT_HISTORY' THEN 'UNDETERMINED' WHEN 'NO_OBSERVED_SALES' THEN 'REVIEW' WHEN 'SEASONAL_REVIEW' THEN 'REVIEW'
    WHEN 'HIDDEN_OPPORTUNITY' THEN 'LOW' WHEN 'SLOW_MOVER' THEN CASE WHEN grave THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'WATCHLIST' THEN 'LOW' ELSE 'NONE' END AS Severity,
    CAST(history_days AS INTEGER) AS history_days, CAST(recency AS INTEGER) AS days_since_last_purchase,
    (SELECT CAST(sum(Quantity) AS BIGINT) FROM sales u WHERE u.Item_ID = w.Item_ID) AS global_sales"""
SLOW = {**RULES, "slow": slow_sql("dated", "PARTITION BY Scope", "Item_ID")}


SLOW_COLUMNS = ("Slow_Moving_Status", "Severity", "history_days", "days_since_last_purchase", "Evidence.global_sales")


@query("rule_menu_class", """SELECT Item_ID, round(sales_percentile, 8) AS sales_percentile, round(margin_percentile, 8) AS margin_percentile, round(wastage_percent, 6) AS wastage_percent,
    round(evidence_score, 6) AS evidence_score, classification, CAST(insufficient_history AS INTEGER) AS insufficient_history FROM classed""", RULES)
def rule_menu_class(t):
    return graded(t).select(
        "Item_ID", F.round("sales_percentile", 8).alias("sales_percentile"), F.round("margin_percentile", 8).alias("margin_percentile"),
        F.round("wastage_percent", 6).alias("wastage_percent"), F.round("evidence_score", 6).alias("evidence_score"), "classification", "insufficient_history",
    )


EVIDENCE = {"sales_percentile": ("sales_percentile", 4), "profit_percent": ("profit_percent", 2), "rating": ("Average_Rating", 2), "repeat_purchase_rate": ("repeat_purchase_rate", 4),
            "wastage_percent": ("wastage_percent", 2), "promotion_dependency": ("promotion_dependency", 4), "sales_trend_percent": ("sales_trend_percent", 2)}


@query("prj_evidence", f"""SELECT Item_ID, {', '.join(f'{scalar.round_exact_sql(*source)} AS {name}' for name, source in EVIDENCE.items())},
    CAST(insufficient_history AS INTEGER) AS insufficient_history FROM classed""", RULES)
def prj_evidence(t):
    evidence = graded(t).select("Item_ID", "classification_evidence.*")
    return evidence.select("Item_ID", *[F.col(c).cast("double").alias(c) for c in EVIDENCE], "insufficient_history")


@query("flt_having", """SELECT Item_ID, classification, round(Average_Rating, 8) AS Average_Rating FROM classed WHERE classification = 'Volume Driver' AND Average_Rating >= 3.0""", RULES)
def flt_having(t):
    f = filters.Filters(performance_class="Volume Driver", rating=3.0).for_report("menu")
    return filters.having(graded(t), f).select("Item_ID", "classification", F.round("Average_Rating", 8).alias("Average_Rating"))


@query("rule_slow_moving", f"SELECT Item_ID, {SLOW_OUT} FROM slow w", SLOW)
def rule_slow_moving(t):
    return assessed(t).select("Item_ID", *SLOW_COLUMNS)


PAIR = "Location_ID, Item_ID"
SCOPED_SLOW = {
    **RULES,
    "loc_base": f"""SELECT s.*, sales_trend_percent, wastage_quantity, coalesce(100.0 * wastage_quantity / nullif(CAST(sales + wastage_quantity AS DOUBLE), 0), 0) AS wastage_percent,
        coalesce(Average_Rating, 0) AS Average_Rating, coalesce(Rating_Count, 0) AS Rating_Count, rate AS repeat_purchase_rate,
        greatest(date_diff('day', greatest(Introduced_Date, Opening_Date), d) + 1, 0) AS history_days, greatest(date_diff('day', CAST(last_sale AS DATE), d), 0) AS recency,
        active_months, top3 FROM
        (SELECT {PAIR}, CAST(sum(Quantity) AS BIGINT) AS sales, CAST(sum(Contribution) AS DOUBLE) AS contribution, count(DISTINCT Order_ID) AS orders, max(Order_DateTime) AS last_sale,
         CAST(100 * sum(Contribution) AS DOUBLE) / CAST(sum(Net_Revenue) AS DOUBLE) AS profit_percent FROM sales GROUP BY 1, 2) s
        JOIN (SELECT {PAIR}, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS rate FROM (SELECT {PAIR}, Customer_ID, count(DISTINCT Order_ID) AS n FROM sales GROUP BY 1, 2, 3) GROUP BY 1, 2) USING ({PAIR})
        JOIN (SELECT {PAIR}, 100.0 * (CAST(a AS DOUBLE) - b) / greatest(b, 1) AS sales_trend_percent FROM (SELECT {PAIR},
              sum(CASE WHEN Order_DateTime > e - INTERVAL 30 DAY THEN Quantity ELSE 0 END) AS a,
              sum(CASE WHEN Order_DateTime <= e - INTERVAL 30 DAY AND Order_DateTime > e - INTERVAL 60 DAY THEN Quantity ELSE 0 END) AS b
              FROM sales, (SELECT max(Order_DateTime) AS e FROM sales) GROUP BY 1, 2)) USING ({PAIR})
        JOIN (SELECT {PAIR}, count(*) AS active_months, CAST(sum(CASE WHEN rn <= 3 THEN q ELSE 0 END) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS top3 FROM
              (SELECT {PAIR}, month(Date), sum(Quantity) AS q, row_number() OVER (PARTITION BY {PAIR} ORDER BY sum(Quantity) DESC) AS rn FROM sales GROUP BY 1, 2, 3) GROUP BY 1, 2) USING ({PAIR})
        LEFT JOIN (SELECT {PAIR}, sum(Quantity_Wasted) AS wq FROM wastage GROUP BY 1, 2) w USING ({PAIR})
        LEFT JOIN (SELECT s.Location_ID, r.Item_ID, avg(Stars) AS Average_Rating, count(*) AS Rating_Count FROM ratings r JOIN (SELECT DISTINCT Order_ID, Item_ID, Location_ID FROM sales) s
              ON r.Order_ID = s.Order_ID AND r.Item_ID = s.Item_ID GROUP BY 1, 2) USING ({PAIR})
        JOIN menu USING (Item_ID) JOIN locations USING (Location_ID), (SELECT max(Date) AS d FROM sales), LATERAL (SELECT coalesce(CAST(wq AS BIGINT), 0) AS wastage_quantity)""",
    "loc_slow": slow_sql("loc_base", "PARTITION BY Location_ID", "Location_ID, Item_ID"),
}


@query("rule_slow_moving_scoped", f"SELECT Location_ID, Item_ID, {SLOW_OUT} FROM loc_slow w", SCOPED_SLOW)
def rule_slow_moving_scoped(t):
    rated = menu.with_rates(menu.menu_facts(t.sales, t.wastage, t.ratings, newest(t), catalogue=t.menu, scope=["Location_ID"]))
    g = menu.slow_facts_by_location(rated, t.sales, t.menu, t.locations, last_day(t))
    return menu.assess_slow_moving(g).select("Location_ID", "Item_ID", *SLOW_COLUMNS)


@query("agg_slow_status_counts", "SELECT Slow_Moving_Status, count(*) AS items FROM slow GROUP BY 1", SLOW)
def agg_slow_status_counts(t):
    return metrics.slow_counts(assessed(t))


@query("agg_item_one", f"SELECT Item_ID, {SLOW_OUT} FROM slow w WHERE Item_ID = 17", SLOW)
def agg_item_one(t):
    return menu.menu_item(assessed(t), 17).select("Item_ID", *SLOW_COLUMNS)


# -- median rules ------------------------------------------------------------------------------------


def pct(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * 100, 2)"


MEDIANS = {
    "stats": f"""SELECT s.*, m.Item_Name, m.Base_Price, r.Avg_Rating, coalesce(w.q, 0) AS Total_Wasted, Total_Revenue - Total_Quantity_Sold * m.Cost AS Total_Profit,
        {pct('Total_Revenue - Total_Quantity_Sold * m.Cost', 'Total_Revenue')} AS Profit_Pct, {pct('Promo_Order_Count', 'Order_Count')} AS Promotion_Dependency_Pct,
        {pct('coalesce(w.q, 0)', 'Total_Quantity_Sold + coalesce(w.q, 0)')} AS Wastage_Pct FROM
        (SELECT Item_ID, CAST(sum(Quantity) AS BIGINT) AS Total_Quantity_Sold, sum(Quantity * Unit_Price) AS Total_Revenue, count(DISTINCT Order_ID) AS Order_Count, count(Promotion_ID) AS Promo_Order_Count FROM sales GROUP BY 1) s
        LEFT JOIN menu m USING (Item_ID) LEFT JOIN (SELECT Item_ID, avg(Stars) AS Avg_Rating FROM raw_ratings WHERE Stars <= 5 GROUP BY 1) r USING (Item_ID)
        LEFT JOIN (SELECT Item_ID, CAST(sum(Quantity_Wasted) AS BIGINT) AS q FROM wastage WHERE Quantity_Wasted > 0 GROUP BY 1) w USING (Item_ID)""",
    "medians": "SELECT quantile_cont(CAST(Total_Quantity_Sold AS DOUBLE), 0.5) AS vm, quantile_cont(Profit_Pct, 0.5) AS pm FROM stats",
}


def by_median(volume: str, profit: str) -> str:
    return f"""CASE WHEN Total_Quantity_Sold >= {volume} AND Profit_Pct >= {profit} THEN 'Profit Driver' WHEN Total_Quantity_Sold >= {volume} THEN 'Volume Driver'
    WHEN Profit_Pct >= {profit} THEN 'Hidden Opportunity' ELSE 'Low Performer' END"""


def item_classes(t):
    return t.kept("item_classes", lambda: menu.median_classes(menu.item_stats(t.sales, t.menu, t.raw_ratings, t.wastage)))


@query("rule_menu_class_legacy", f"""SELECT Item_ID, Total_Quantity_Sold, CAST(Total_Profit AS DOUBLE) AS Total_Profit, Profit_Pct, Promotion_Dependency_Pct, Wastage_Pct,
    {by_median('vm', 'pm')} AS Performance_Class FROM stats, medians""", MEDIANS)
def rule_menu_class_legacy(t):
    return item_classes(t).select("Item_ID", "Total_Quantity_Sold", "Total_Profit", "Profit_Pct", "Promotion_Dependency_Pct", "Wastage_Pct", "Performance_Class")


@query("rule_tricky_cases", """SELECT Item_ID, Item_Name, unnest(list_filter([CASE WHEN Total_Quantity_Sold >= vm AND Total_Profit < 0 THEN 'High-selling but loss-making' END,
    CASE WHEN Profit_Pct >= pm AND Total_Quantity_Sold < vm * 0.3 THEN 'High-margin but rarely purchased' END, CASE WHEN Wastage_Pct > 20 AND Total_Quantity_Sold >= vm THEN 'Popular but excessive wastage' END,
    CASE WHEN Avg_Rating >= 4.5 AND Profit_Pct < pm THEN 'Highly rated but poor profitability' END, CASE WHEN Promotion_Dependency_Pct > 50 THEN 'Promotion-dependent dish' END],
    lambda x: x IS NOT NULL)) AS "Case" FROM stats, medians""", MEDIANS)
def rule_tricky_cases(t):
    return menu.tricky_cases(item_classes(t))


@query("rule_menu_class_location", f"""WITH ls AS (SELECT s.*, {pct('rev - Total_Quantity_Sold * m.Cost', 'rev')} AS Profit_Pct FROM
    (SELECT Location_ID, Item_ID, CAST(sum(Quantity) AS BIGINT) AS Total_Quantity_Sold, sum(Quantity * Unit_Price) AS rev FROM sales GROUP BY 1, 2) s LEFT JOIN menu m USING (Item_ID))
    SELECT Location_ID, Item_ID, Total_Quantity_Sold, Profit_Pct, {by_median('vm', 'pm')} AS Performance_Class FROM ls,
    (SELECT quantile_cont(CAST(Total_Quantity_Sold AS DOUBLE), 0.5) AS vm, quantile_cont(Profit_Pct, 0.5) AS pm FROM ls)""")
def rule_menu_class_location(t):
    return menu.median_classes(menu.location_item_stats(t.sales, t.menu)).select("Location_ID", "Item_ID", "Total_Quantity_Sold", "Profit_Pct", "Performance_Class")


@query("rule_wastage_ratio_legacy", """WITH g AS (SELECT Item_ID, w AS Total_Wasted, n AS Wastage_Events, coalesce(d, 0) AS Historical_Demand, CAST(w AS DOUBLE) / CAST(coalesce(d, 0) + w AS DOUBLE) AS r FROM
    (SELECT Item_ID, CAST(sum(Quantity_Wasted) AS BIGINT) AS w, count(*) AS n FROM wastage WHERE Quantity_Wasted > 0 GROUP BY 1) LEFT JOIN (SELECT Item_ID, CAST(sum(Quantity) AS BIGINT) AS d FROM lines GROUP BY 1) USING (Item_ID))
    SELECT Item_ID, Total_Wasted, Wastage_Events, Historical_Demand, round(r, 8) AS Wastage_Ratio, CAST(r >= (SELECT quantile_cont(r, 0.75) FROM g) AS INTEGER) AS Risk_Label FROM g""")
def rule_wastage_ratio_legacy(t):
    return menu.waste_ratio_q3(t.wastage, t.lines).withColumn("Wastage_Ratio", F.round("Wastage_Ratio", 8))


# -- price and campaign windows ------------------------------------------------------------------------

CHANGES = {"changes": """SELECT * FROM (SELECT *, lag(Price) OVER (PARTITION BY Item_ID ORDER BY Effective_Date, Pricing_ID) AS prev FROM prices) WHERE prev IS NOT NULL AND Price <> prev"""}
SIDES = ", ".join(
    f"CAST(sum(CASE WHEN s.Date {op} c.Effective_Date THEN {expr} END) AS DOUBLE) AS {side}_{name}"
    for side, op in (("before", "<"), ("after", ">="))
    for name, expr in (("quantity", "Quantity"), ("gross", "Quantity * Unit_Price"), ("revenue", "Net_Revenue"), ("contribution", "Contribution"))
)
CHANGES["around"] = f"""SELECT c.Pricing_ID, c.Item_ID, c.Effective_Date, CAST(c.prev AS DOUBLE) AS p0, CAST(c.Price AS DOUBLE) AS p1, {SIDES} FROM changes c JOIN sales s
    ON s.Item_ID = c.Item_ID AND s.Date >= c.Effective_Date - 30 AND s.Date < c.Effective_Date + 30 GROUP BY 1, 2, 3, 4, 5"""


@query("jn_interval", """SELECT Pricing_ID, before_quantity, after_quantity, before_gross, after_gross, before_revenue, after_revenue, before_contribution, after_contribution FROM around""", CHANGES)
def jn_interval(t):
    joined = events.window_join(t.sales, events.price_changes(t.prices))
    return joined.withColumns({c: F.col(c).cast("double") for c in ("before_quantity", "after_quantity")})


@query("rule_price_windows", """SELECT Item_ID, CAST(Effective_Date AS VARCHAR) AS Effective_Date, CAST(before_quantity AS BIGINT) AS Before_Quantity, CAST(after_quantity AS BIGINT) AS After_Quantity,
    round(100 * (p1 / p0 - 1), 6) AS List_Price_Change_Percent, round(100 * (n / o - 1), 6) AS Observed_Price_Change_Percent, round(100 * (after_quantity / before_quantity - 1), 6) AS Demand_Change_Percent,
    round(100 * (after_revenue / greatest(before_revenue, 1) - 1), 6) AS Revenue_Change_Percent, round(100 * (after_contribution - before_contribution) / greatest(abs(before_contribution), 1), 6) AS Contribution_Change_Percent,
    CASE WHEN o <= 0 OR before_quantity <= 0 OR abs((n - o) / o) < 0.005 THEN 'NOT VERIFIABLE' WHEN ((n - o) / o) * ((after_quantity - before_quantity) / before_quantity) >= 0 THEN 'UNDETERMINED'
         WHEN abs(((after_quantity - before_quantity) / before_quantity) / ((n - o) / o)) >= 1 THEN 'HIGH' WHEN abs(((after_quantity - before_quantity) / before_quantity) / ((n - o) / o)) >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS Sensitivity
    FROM (SELECT *, before_gross / before_quantity AS o, after_gross / after_quantity AS n FROM around WHERE before_quantity IS NOT NULL AND after_quantity IS NOT NULL)""", CHANGES)
def rule_price_windows(t):
    w = events.price_windows(t.sales, t.prices)
    rounded = {c: F.round(c, 6) for c in w.columns if c.endswith("_Percent")}
    return w.withColumns(rounded).drop("Before_Avg_Price", "After_Avg_Price", "Previous_List_Price", "New_List_Price")


@query("rule_sensitivity", """SELECT Sensitivity, count(*) AS changes FROM (SELECT CASE WHEN abs((p1 - p0) / p0) < 0.005 THEN 'NOT VERIFIABLE' WHEN ((p1 - p0) / p0) * ((a - b) / b) >= 0 THEN 'UNDETERMINED'
    WHEN abs(((a - b) / b) / ((p1 - p0) / p0)) >= 1 THEN 'HIGH' WHEN abs(((a - b) / b) / ((p1 - p0) / p0)) >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS Sensitivity
    FROM (SELECT p0, p1, before_quantity AS b, after_quantity AS a FROM around WHERE before_quantity IS NOT NULL AND after_quantity IS NOT NULL)) GROUP BY 1""", CHANGES)
def rule_sensitivity(t):
    w = events.price_windows(t.sales, t.prices)
    label = events.sensitivity(F.col("Previous_List_Price"), F.col("New_List_Price"), F.col("Before_Quantity").cast("double"), F.col("After_Quantity").cast("double"))
    return w.groupBy(label.alias("Sensitivity")).agg(F.count(F.lit(1)).alias("changes"))


PHASED = {
    "phased": f"""SELECT p.Promotion_ID AS c, CASE WHEN s.Date < p.Start_Date THEN 'before' WHEN s.Date <= p.End_Date THEN 'during' ELSE 'after' END AS phase, s.* FROM promotions p JOIN sales s
        ON s.Date BETWEEN p.Start_Date - CAST(p.End_Date - p.Start_Date + 1 AS INTEGER) AND p.End_Date + CAST(p.End_Date - p.Start_Date + 1 AS INTEGER) AND {CAMPAIGN_MATCH}""",
    "phase_sums": """SELECT c, phase, CAST(sum(Quantity) AS BIGINT) AS quantity, CAST(sum(Net_Revenue) AS DOUBLE) AS net_revenue, CAST(sum(Contribution) AS DOUBLE) AS contribution,
        count(DISTINCT Order_ID) AS orders, count(DISTINCT Customer_ID) AS customers, count(DISTINCT CASE WHEN Promotion_ID = c THEN Order_ID END) AS tagged FROM phased GROUP BY 1, 2""",
}


@query("rule_window_metrics", "SELECT c AS Campaign_ID, phase, quantity, net_revenue, contribution, orders, customers, tagged FROM phase_sums", PHASED)
def rule_window_metrics(t):
    return events.campaign_metrics(t.sales, t.promotions).drop("repeat_customers")


def phase_columns() -> str:
    out = []
    for phase, there in (("before", "b"), ("during", "true"), ("after", "a")):
        for m in events.MEASURES:
            out.append(f"CASE WHEN {there} THEN coalesce({phase}.{m}, 0) END AS {phase}_{m}")
    return ", ".join(out)


@query("rule_promo_windows", f"""WITH w AS (SELECT p.*, Start_Date - CAST(End_Date - Start_Date + 1 AS INTEGER) >= lo AS b, End_Date + CAST(End_Date - Start_Date + 2 AS INTEGER) <= hi AS a
        FROM promotions p, (SELECT min(Order_DateTime) AS lo, max(Order_DateTime) AS hi FROM sales)),
    rep AS (SELECT c, count(*) AS r FROM (SELECT c, Customer_ID FROM phased WHERE phase = 'during' GROUP BY 1, 2 HAVING count(DISTINCT Order_ID) > 1) GROUP BY 1),
    items AS (SELECT p.Promotion_ID AS c, count(DISTINCT s.Item_ID) AS n FROM promotions p JOIN sales s ON {CAMPAIGN_MATCH} GROUP BY 1),
    spoil AS (SELECT p.Promotion_ID AS c, CAST(sum(Cost_Impact) AS DOUBLE) AS v FROM promotions p JOIN wastage x ON x.Wastage_Date BETWEEN p.Start_Date AND p.End_Date
        AND (p.Location_ID IS NULL OR x.Location_ID = p.Location_ID) AND EXISTS (SELECT 1 FROM sales s WHERE s.Item_ID = x.Item_ID AND {CAMPAIGN_MATCH}) GROUP BY 1)
    SELECT w.Promotion_ID, Promotion_Name, {phase_columns()}, coalesce(during.tagged, 0) AS tagged_campaign_orders, coalesce(items.n, 0) AS eligible_item_count, coalesce(rep.r, 0) AS repeat_customers,
    coalesce(spoil.v, 0) AS wastage_cost, CAST(b AS INTEGER) AS comparison_available,
    CAST(CASE WHEN b AND before.orders > 0 AND during.orders > 0 THEN during.quantity > before.quantity AND during.contribution < before.contribution END AS INTEGER) AS promotion_trap
    FROM w LEFT JOIN (SELECT * FROM phase_sums WHERE phase = 'before') before ON before.c = w.Promotion_ID LEFT JOIN (SELECT * FROM phase_sums WHERE phase = 'during') during ON during.c = w.Promotion_ID
    LEFT JOIN (SELECT * FROM phase_sums WHERE phase = 'after') after ON after.c = w.Promotion_ID LEFT JOIN rep ON rep.c = w.Promotion_ID LEFT JOIN items ON items.c = w.Promotion_ID LEFT JOIN spoil ON spoil.c = w.Promotion_ID""", PHASED)
def rule_promo_windows(t):
    w = events.promo_windows(t.sales, t.promotions, t.wastage)
    return w.drop("Discount_Percent", "Start_Date", "End_Date", *[f"{p}_aov" for p in events.PHASES])


@query("rule_promo_trap", """SELECT CAST(CASE WHEN b.orders > 0 AND d.orders > 0 THEN d.quantity > b.quantity AND d.contribution < b.contribution END AS INTEGER) AS trap, b.c AS Campaign_ID
    FROM phase_sums b JOIN phase_sums d ON b.c = d.c AND b.phase = 'before' AND d.phase = 'during'""", PHASED)
def rule_promo_trap(t):
    m = events.campaign_metrics(t.sales, t.promotions).select("Campaign_ID", "phase", "orders", "quantity", "contribution")
    side = lambda p, s: m.where(F.col("phase") == p).select("Campaign_ID", *[F.col(c).alias(f"{s}_{c}") for c in ("orders", "quantity", "contribution")])
    both = side("before", "b").join(side("during", "d"), "Campaign_ID")
    pair = lambda c: (F.col(f"b_{c}"), F.col(f"d_{c}"))
    return both.select("Campaign_ID", events.promo_trap(pair("orders"), pair("quantity"), pair("contribution")).alias("trap"))


# -- customers ---------------------------------------------------------------------------------------

CHURN = {
    "rfm": RFM_SQL,
    "activity": """SELECT Customer_ID, count(DISTINCT CASE WHEN Order_DateTime > e - INTERVAL 90 DAY THEN Order_ID END) AS recent_orders,
        count(DISTINCT CASE WHEN Order_DateTime <= e - INTERVAL 90 DAY AND Order_DateTime > e - INTERVAL 180 DAY THEN Order_ID END) AS previous_orders
        FROM sales, (SELECT max(Order_DateTime) AS e FROM sales) GROUP BY 1""",
    "profile": """SELECT Location_ID % 5 AS Cluster, avg(Recency_Days) AS Recency_Days, avg(Frequency) AS Frequency, CAST(sum(Monetary) AS DOUBLE) / count(*) AS Monetary, count(*) AS size FROM
        (SELECT r.*, l.Preferred_Location AS Location_ID FROM rfm r JOIN (SELECT Customer_ID, Preferred_Location FROM rfm) l USING (Customer_ID)) GROUP BY 1""",
}


@query("rule_churn", """SELECT r.Customer_ID, Recency_Days, recent_orders, previous_orders, CAST(previous_orders >= 2 AND recent_orders < previous_orders * 0.5 AS INTEGER) AS declining
    FROM rfm r JOIN activity a ON r.Customer_ID = a.Customer_ID WHERE Recency_Days > 90 OR (previous_orders >= 2 AND recent_orders < previous_orders * 0.5)""", CHURN)
def rule_churn(t):
    return customers.churn(t.sales, metrics.rfm(t.sales), newest(t)).select("Customer_ID", "Recency_Days", "recent_orders", "previous_orders", "declining")


LEGACY_RECENCY = """SELECT Customer_ID, CAST(floor((epoch((SELECT max(Order_DateTime) FROM clean_orders WHERE Order_Status = 'Completed')) + 86400 - epoch(max(Order_DateTime))) / 86400) AS BIGINT) AS Recency
    FROM clean_orders WHERE Order_Status = 'Completed' GROUP BY 1"""


def visits(t):
    done = facts.completed(t.orders)
    snapshot = done.agg(F.max("Order_DateTime")).scalar() + F.expr("INTERVAL 1 DAY")
    last = done.groupBy("Customer_ID").agg(F.max("Order_DateTime").alias("at"))
    return last.select("Customer_ID", F.timestamp_diff("DAY", F.col("at"), snapshot).alias("Recency"))


@query("rule_churn_legacy", f"""WITH g AS ({LEGACY_RECENCY}) SELECT Customer_ID, Recency, CASE WHEN Recency >= (SELECT quantile_cont(Recency, 0.75) FROM g) THEN 'High' ELSE 'Low' END AS Churn_Risk FROM g""")
def rule_churn_legacy(t):
    return customers.churn_q3(visits(t))


def place_profiles(t):
    """Five customer groups by usual location, as named-cluster input that SQL can reproduce."""
    return metrics.rfm(t.sales).groupBy((F.col("Preferred_Location") % 5).alias("Cluster")).agg(
        F.avg("Recency_Days").alias("Recency_Days"), F.avg("Frequency").alias("Frequency"),
        scalar.ratio(F.sum("Monetary"), F.count(F.lit(1))).alias("Monetary"), F.count(F.lit(1)).alias("size"),
    )


SEGMENT_SQL = """SELECT Cluster, size, Recency_Days, Monetary, CASE WHEN risk THEN 'At Risk' WHEN val THEN 'High Value' WHEN rare THEN 'Occasional' WHEN Recency_Days > 90 THEN 'Cooling'
    WHEN Frequency >= (SELECT median(Frequency) FROM profile) THEN 'Engaged' ELSE 'Developing' END AS Segment FROM
    (SELECT *, NOT risk AND NOT val AND row_number() OVER (ORDER BY risk OR val, Frequency, Cluster) = 1 AS rare FROM
    (SELECT *, NOT risk AND row_number() OVER (ORDER BY risk, Monetary DESC, Cluster) = 1 AS val FROM
    (SELECT *, row_number() OVER (ORDER BY Recency_Days DESC, Cluster) = 1 AS risk FROM profile)))"""


@query("rule_segment_labels", f"SELECT Cluster, Segment FROM ({SEGMENT_SQL})", CHURN)
def rule_segment_labels(t):
    return customers.segment_labels(place_profiles(t)).select("Cluster", "Segment")


@query("rule_segment_labels_legacy", """SELECT Cluster, CASE WHEN Monetary > (SELECT median(Monetary) FROM profile) AND Frequency > (SELECT median(Frequency) FROM profile) THEN 'High-Value Loyal'
    WHEN Recency_Days > (SELECT median(Recency_Days) FROM profile) THEN 'At-Risk' WHEN Frequency > (SELECT median(Frequency) FROM profile) THEN 'Frequent' ELSE 'Occasional' END AS Segment_Label FROM profile""", CHURN)
def rule_segment_labels_legacy(t):
    return customers.segment_labels_median(place_profiles(t)).select("Cluster", "Segment_Label")


# -- advice ------------------------------------------------------------------------------------------

RISK_SQL = """SELECT Item_ID, Location_ID, w.wq AS Expected_Wastage, CASE WHEN wq > 8 THEN 'HIGH' WHEN wq > 4 THEN 'MEDIUM' ELSE 'LOW' END AS Risk FROM (SELECT Item_ID, Location_ID, sum(Quantity_Wasted) AS wq FROM wastage GROUP BY 1, 2) w"""


def risk(t):
    waste = facts.wastage_by_item_location(t.wastage)
    found = waste.select("Item_ID", "Location_ID", F.col("Wastage_Quantity").alias("Expected_Wastage"), scalar.band(F.col("Wastage_Quantity"), 8).alias("Risk"))
    return facts.risk_with_stock(found, facts.latest_stock(t.inventory))


def pair_sql(item: str, least: int, lift: float) -> dict[str, str]:
    return {
        "members": f"SELECT DISTINCT Order_ID AS o, {item} AS i FROM sales",
        "single": "SELECT i, count(*) AS n FROM members GROUP BY 1",
        "pair": f"SELECT a.i AS l, b.i AS r, count(*) AS k FROM members a JOIN members b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= {least}",
        "found_rules": f"""SELECT x AS Antecedent_Item_ID, y AS Consequent_Item_ID, k AS Pair_Count, CAST(k AS DOUBLE) / n AS Support, CAST(k AS DOUBLE) / sx.n1 AS Confidence, (CAST(k AS DOUBLE) / sx.n1) / (CAST(sy.n1 AS DOUBLE) / n) AS Lift
            FROM (SELECT l AS x, r AS y, k FROM pair UNION ALL SELECT r, l, k FROM pair) JOIN (SELECT i AS x, n AS n1 FROM single) sx USING (x) JOIN (SELECT i AS y, n AS n1 FROM single) sy USING (y),
            (SELECT count(DISTINCT o) AS n FROM members) WHERE (CAST(k AS DOUBLE) / sx.n1) / (CAST(sy.n1 AS DOUBLE) / n) >= {lift}""",
    }


BASKET = pair_sql("Item_ID", 2, 1.05)


@query("jn_basket_pairs", "SELECT l AS \"left\", r AS \"right\", k AS count FROM pair", pair_sql("Item_ID", 2, 0))
def jn_basket_pairs(t):
    return basket.pair_counts(basket.baskets(t.sales), 2)


@query("bsk_rules", """SELECT Antecedent_Item_ID, Consequent_Item_ID, Pair_Count, round(Support, 8) AS Support, round(Confidence, 8) AS Confidence, round(Lift, 8) AS Lift FROM found_rules""", BASKET)
def bsk_rules(t):
    found = basket.rules(t.sales, min_pairs=2)
    return found.withColumns({c: F.round(c, 8) for c in ("Support", "Confidence", "Lift")})


@query("bsk_apriori_legacy")
def bsk_apriori_legacy(t):
    return basket.bundles(basket.fp_rules(t.sales, min_support=0.0002), n=1000)


@query("rule_recommendations", f"""SELECT 'slow_moving:' || Item_ID || ':all' AS rec_key, 'slow_moving' AS type, CASE WHEN Slow_Moving_Status = 'SLOW_MOVER' AND grave THEN 'High' WHEN Slow_Moving_Status = 'SLOW_MOVER' THEN 'Medium' ELSE 'Low' END AS priority
    FROM slow WHERE Slow_Moving_Status IN ('SLOW_MOVER', 'WATCHLIST', 'HIDDEN_OPPORTUNITY', 'SEASONAL_REVIEW')
    UNION ALL SELECT kind || ':' || Item_ID || ':all', kind, CASE kind WHEN 'pricing' THEN 'Critical' ELSE 'High' END FROM (SELECT c.Item_ID, CASE WHEN classification = 'Hidden Opportunity' AND Average_Rating >= 4 AND Slow_Moving_Status <> 'HIDDEN_OPPORTUNITY' THEN 'menu'
        WHEN classification = 'Volume Driver' AND contribution < 0 THEN 'pricing' WHEN wastage_quantity > sales * 0.2 AND wastage_quantity > 100 THEN 'wastage' END AS kind FROM classed c JOIN slow USING (Item_ID)) WHERE kind IS NOT NULL
    UNION ALL SELECT 'inventory:' || r.Item_ID || ':' || r.Location_ID || ':all', 'inventory', 'High' FROM ({RISK_SQL}) r WHERE Risk = 'HIGH'
    UNION ALL SELECT 'customer_targeting:' || Cluster || ':all', 'customer_targeting', 'Medium' FROM ({SEGMENT_SQL}) WHERE Segment = 'At Risk'
    UNION ALL (SELECT 'bundle:' || Antecedent_Item_ID || ':' || Consequent_Item_ID || ':all', 'bundle', 'Medium' FROM found_rules ORDER BY Lift DESC, Pair_Count DESC, Antecedent_Item_ID, Consequent_Item_ID LIMIT 10)
    UNION ALL SELECT 'promotion:' || b.c || ':all', 'promotion', 'Critical' FROM phase_sums b JOIN phase_sums d ON b.c = d.c AND b.phase = 'before' AND d.phase = 'during' AND b.orders > 0 AND d.orders > 0
        AND d.quantity > b.quantity AND d.contribution < b.contribution""", {**SLOW, **CHURN, **BASKET, **PHASED})
def rule_recommendations(t):
    profiles = customers.segment_labels(place_profiles(t)).withColumns({"average_recency": F.col("Recency_Days"), "average_monetary": F.col("Monetary")})
    return recommendations(t, risk(t), profiles)


def recommendations(t, risky, profiles):
    """Advice over high-risk pairs with stock and named segments."""
    best = basket.best_first(basket.rules(t.sales, min_pairs=2), 10)
    advice_rows = advice.recommend(assessed(t), risky, profiles, best, events.promo_windows(t.sales, t.promotions, t.wastage))
    return advice_rows.select("rec_key", "type", "priority")


WASTE_Q3 = {"wq3": """WITH g AS (SELECT Item_ID, CAST(sum(Quantity_Wasted) AS BIGINT) AS Total_Wasted FROM wastage WHERE Quantity_Wasted > 0 GROUP BY 1)
    SELECT *, CASE WHEN Total_Wasted >= (SELECT quantile_cont(Total_Wasted, 0.75) FROM g) THEN 'High' ELSE 'Low' END AS Risk_Level FROM g""",
    "lost": f"""WITH g AS ({LEGACY_RECENCY}) SELECT Customer_ID, CASE WHEN Recency >= (SELECT quantile_cont(Recency, 0.75) FROM g) THEN 'High' ELSE 'Low' END AS Churn_Risk FROM g"""}
SIMPLE = {**MEDIANS, **WASTE_Q3, "advice": f"""SELECT row_number() OVER (ORDER BY part, k) AS Recommendation_ID, k AS Entity_ID, Type, Priority FROM (
    SELECT 1 AS part, Item_ID AS k, 'Menu Optimization' AS Type, CASE cls WHEN 'Hidden Opportunity' THEN 'High' ELSE 'Medium' END AS Priority FROM (SELECT Item_ID, {by_median('vm', 'pm')} AS cls FROM stats, medians) WHERE cls IN ('Hidden Opportunity', 'Low Performer')
    UNION ALL SELECT 2, Item_ID, 'Inventory', 'Critical' FROM wq3 WHERE Risk_Level = 'High'
    UNION ALL (SELECT 3, Customer_ID, 'Customer Targeting', 'Medium' FROM lost WHERE Churn_Risk = 'High' ORDER BY Customer_ID LIMIT 50))"""}


def waste_levels(t):
    return t.kept("waste_levels", lambda: metrics.wastage_q3(t.wastage, "Item_ID"))


def lost_customers(t):
    return t.kept("lost_customers", lambda: customers.churn_q3(visits(t)))


def simple_advice(t):
    return t.kept("simple_advice", lambda: advice.recommend_simple(item_classes(t), waste_levels(t), lost_customers(t)))


@query("rule_recommendations_legacy", "SELECT * FROM advice", SIMPLE)
def rule_recommendations_legacy(t):
    return simple_advice(t).drop("Action", "Reason")


# Scenarios for every dish: the changes follow from the dish and its category.
SCENARIOS = {
    "scenarios": """SELECT Item_ID * 10 + k AS Scenario_ID, Item_ID, CASE WHEN k = 1 THEN Category_ID - 1 END AS Location_ID, CASE WHEN k = 2 THEN Category_ID END AS Promotion_ID,
        CAST(Category_ID - 10 AS DOUBLE) AS price_change_percent, CAST(k * 5 AS DOUBLE) AS discount_change_percent, CAST(8 - Category_ID AS DOUBLE) AS demand_change_percent,
        CAST(k * 10 - 10 AS DOUBLE) AS preparation_change_percent, CASE WHEN Category_ID % 3 = 0 THEN 12.0::DOUBLE END AS promotion_discount_percent FROM menu, (SELECT unnest([0, 1, 2]) AS k)""",
    "chosen": """SELECT c.Scenario_ID, s.* FROM scenarios c JOIN sales s ON s.Item_ID = c.Item_ID AND (c.Location_ID IS NULL OR c.Location_ID = s.Location_ID) LEFT JOIN promotions p ON c.Promotion_ID = p.Promotion_ID
        WHERE c.Promotion_ID IS NULL OR (s.Date BETWEEN p.Start_Date AND p.End_Date AND (p.Location_ID IS NULL OR p.Location_ID = s.Location_ID)
        AND CASE WHEN p.Applicable_Item_ID IS NOT NULL THEN s.Item_ID = p.Applicable_Item_ID WHEN p.Applicable_Category_ID IS NOT NULL THEN s.Category_ID = p.Applicable_Category_ID ELSE true END)""",
    "sums": """SELECT Scenario_ID, CAST(sum(Quantity) AS DOUBLE) AS q, CAST(sum(Net_Revenue) AS DOUBLE) AS rev, CAST(sum(Contribution) AS DOUBLE) AS con, CAST(sum(Cost_Total) AS DOUBLE) AS cost,
        CAST(sum(Quantity * Unit_Price) AS DOUBLE) AS gross, CAST(sum(Discount_Applied) AS DOUBLE) AS off FROM chosen GROUP BY 1""",
    "spoilt": """SELECT c.Scenario_ID, CAST(sum(Quantity_Wasted) AS DOUBLE) AS wasted, CAST(sum(Prepared_Quantity) AS DOUBLE) AS prepared FROM scenarios c JOIN wastage w ON w.Item_ID = c.Item_ID
        AND (c.Location_ID IS NULL OR c.Location_ID = w.Location_ID) GROUP BY 1""",
    "moved": """SELECT *, q * (1 + demand_change_percent / 100) AS sq, gross / q * (1 + price_change_percent / 100) AS sp, cost / q AS uc FROM scenarios JOIN sums USING (Scenario_ID) LEFT JOIN spoilt USING (Scenario_ID)""",
    "priced": """SELECT *, sq * greatest(sp - CASE WHEN promotion_discount_percent IS NOT NULL THEN sp * promotion_discount_percent / 100 ELSE greatest(off / q * (1 + discount_change_percent / 100), 0) END, 0) AS srev,
        CASE WHEN wasted IS NOT NULL THEN greatest(wasted + prepared * preparation_change_percent / 100 - (sq - q), 0) END AS sw FROM moved""",
}


def scenarios(t):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    base = t.menu.select("Item_ID", "Category_ID", k.alias("k"))
    cat = F.col("Category_ID")
    return base.select(
        (F.col("Item_ID") * 10 + F.col("k")).alias("Scenario_ID"), "Item_ID", F.when(F.col("k") == 1, cat - 1).alias("Location_ID"),
        F.when(F.col("k") == 2, cat).alias("Promotion_ID"), (cat - 10).cast("double").alias("price_change_percent"),
        (F.col("k") * 5).cast("double").alias("discount_change_percent"), (8 - cat).cast("double").alias("demand_change_percent"),
        (F.col("k") * 10 - 10).cast("double").alias("preparation_change_percent"), F.when(cat % 3 == 0, 12.0).alias("promotion_discount_percent"),
    )


WHAT_IF = {
    "baseline_quantity": "q", "scenario_quantity": "sq", "baseline_revenue": "rev", "scenario_revenue": "srev", "delta_revenue": "srev - rev", "baseline_contribution": "con",
    "scenario_contribution": "srev - sq * uc", "baseline_wastage_units": "wasted", "scenario_wastage_units": "sw", "scenario_wastage_cost": "sw * uc",
}


@query("rule_what_if", "SELECT Scenario_ID, Item_ID, " + ", ".join(f"floor(({e}) * 10000 + 0.5) / 10000 AS {c}" for c, e in WHAT_IF.items()) + " FROM priced", SCENARIOS)
def rule_what_if(t):
    w = advice.what_if(t.sales, t.wastage, scenarios(t), t.promotions)
    return w.select("Scenario_ID", "Item_ID", *[(F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) for c in WHAT_IF])


@query("rule_what_if_legacy", """SELECT Item_ID, CAST(Total_Revenue AS DOUBLE) AS baseline_revenue, CAST(round(CAST(Total_Quantity_Sold * (1 - 10 * 0.8::DOUBLE / 100) * CAST(Base_Price AS DOUBLE) * (1 + 10 / 100) AS DECIMAL(28,9)), 2) AS DOUBLE) AS scenario_revenue FROM stats""", MEDIANS)
def rule_what_if_legacy(t):
    w = advice.what_if_linear(menu.item_stats(t.sales, t.menu, t.raw_ratings, t.wastage), 10)
    return w.select("Item_ID", "baseline_revenue", "scenario_revenue")


@query("rule_wastage_band", """SELECT Wastage_ID, CASE WHEN p >= 0.14 THEN 'HIGH' WHEN e <= 1000.0 THEN 'LOW' ELSE 'MEDIUM' END AS Risk
    FROM (SELECT Wastage_ID, CAST(Cost_Impact AS DOUBLE) AS e, CAST(Quantity_Wasted AS DOUBLE) / Prepared_Quantity AS p FROM wastage)""")
def rule_wastage_band(t):
    from larder.operators.wastage import risk_band

    share = F.col("Quantity_Wasted") / F.col("Prepared_Quantity")
    return t.wastage.select("Wastage_ID", risk_band(F.col("Cost_Impact").cast("double"), share, 2000.0, 0.14).alias("Risk"))


# -- statistics ---------------------------------------------------------------------------------------

LINE = "CAST(Quantity * Unit_Price AS DOUBLE)"


@query("stat_quantile", "SELECT " + ", ".join(f"round(quantile_cont(CAST(Net_Revenue AS DOUBLE), {q}), 6) AS {n}" for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q999", 0.999))) + " FROM sales")
def stat_quantile(t):
    found = ordering.quantiles(t.sales, "Net_Revenue", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q999": 0.999})
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("stat_quantile_by", "SELECT Category_ID, round(quantile_cont(CAST(Net_Revenue AS DOUBLE), 0.5), 6) AS middle FROM sales GROUP BY 1")
def stat_quantile_by(t):
    return ordering.quantiles(t.sales, "Net_Revenue", {"middle": 0.5}, ["Category_ID"]).withColumn("middle", F.round("middle", 6))


@query("stat_iqr_outliers", f"""WITH x AS (SELECT Order_Item_ID, {LINE} AS Line_Total FROM sales), q AS (SELECT quantile_cont(Line_Total, 0.25) AS a, quantile_cont(Line_Total, 0.75) AS b FROM x)
    SELECT x.* FROM x, q WHERE Line_Total > b + 0.25 * (b - a)""")
def stat_iqr_outliers(t):
    lines = t.sales.select("Order_Item_ID", (F.col("Quantity") * F.col("Unit_Price")).cast("double").alias("Line_Total"))
    return stats.iqr_outliers(lines, "Line_Total", k=0.25)


@query("stat_sales_anomaly", """SELECT CAST(Date AS VARCHAR) AS Date, Location_ID, quantity, revenue, round(z, 6) AS z_score FROM (SELECT *, (quantity - avg(quantity) OVER w) / CASE WHEN stddev_samp(quantity) OVER w = 0 THEN 1 ELSE stddev_samp(quantity) OVER w END AS z
    FROM (SELECT Date, Location_ID, CAST(sum(Quantity) AS BIGINT) AS quantity, CAST(sum(Net_Revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2) WINDOW w AS (PARTITION BY Location_ID)) WHERE abs(round(z, 9)) > 3
    ORDER BY abs(round(z, 9)) DESC, Location_ID, Date LIMIT 100""")
def stat_sales_anomaly(t):
    return stats.sales_anomalies(t.sales).withColumn("z_score", F.round("z_score", 6))


@query("stat_unusual_orders", """WITH o AS (SELECT Order_ID, CAST(sum(Net_Revenue) AS DOUBLE) AS revenue, CAST(sum(Discount_Applied) AS DOUBLE) AS discount, CAST(sum(Quantity) AS BIGINT) AS quantity FROM sales GROUP BY 1)
    SELECT * FROM o WHERE coalesce(discount / nullif(revenue + discount, 0) > 0.09, false) OR quantity > (SELECT quantile_cont(quantity, 0.999) FROM o)""")
def stat_unusual_orders(t):
    return stats.unusual_orders(t.sales, rate=0.09)


def burst_sql(source: str, day: str, least: int) -> str:
    return f"""SELECT Item_ID, CAST(Rating_Day AS VARCHAR) AS Rating_Day, n AS count, round(s, 8) AS average_stars, round(f, 8) AS five_star_rate, round(z, 6) AS count_z_score FROM
    (SELECT *, (n - avg(n) OVER w) / CASE WHEN coalesce(stddev_samp(n) OVER w, 1) = 0 THEN 1 ELSE coalesce(stddev_samp(n) OVER w, 1) END AS z FROM (SELECT Item_ID, {day} AS Rating_Day, count(*) AS n, avg(Stars) AS s, avg(CASE WHEN Stars = 5 THEN 1.0 ELSE 0.0 END) AS f
    FROM {source} WHERE Stars BETWEEN 1 AND 5 GROUP BY 1, 2) WINDOW w AS (PARTITION BY Item_ID)) WHERE n >= {least} AND round(z, 9) > 1.5 ORDER BY round(z, 9) DESC, Item_ID, Rating_Day LIMIT 100"""


def rounded_bursts(found):
    return found.withColumns({"average_stars": F.round("average_stars", 8), "five_star_rate": F.round("five_star_rate", 8), "count_z_score": F.round("count_z_score", 6)})


#: A dish of the sample tables has few ratings, so two on one day are already a burst.
FEW_RATINGS = 2


@query("stat_rating_burst", burst_sql("(SELECT r.* FROM raw_ratings r JOIN (SELECT DISTINCT Order_ID, Item_ID FROM sales) s ON r.Order_ID = s.Order_ID AND r.Item_ID = s.Item_ID)", "Rating_Date", FEW_RATINGS))
def stat_rating_burst(t):
    """Ratings of dishes that their order really sold: cancelled orders and unsold dishes do not count."""
    valid = t.raw_ratings.where(F.col("Stars").between(1, 5))
    return rounded_bursts(stats.rating_bursts(valid, "Rating_Date", z=1.5, min_n=FEW_RATINGS, sold=t.sales))


@query("stat_rating_burst_events", burst_sql("event_ratings", "Rating_Day", 5))
def stat_rating_burst_events(t):
    """The dense event log, which has no orders to check against."""
    return rounded_bursts(stats.rating_bursts(t.event_ratings.where(F.col("Stars").between(1, 5)), "Rating_Day", z=1.5))


# Two simple predictions of location demand: the value seven rows back and the mean of the last seven.
FORECASTS = {"cases": """SELECT strftime(Date, '%Y-%m-%d') || ':' || Location_ID AS Case_ID, Location_ID, d AS Actual, lag(d, 7) OVER w AS seasonal, CASE WHEN count(d) OVER p = 7 THEN avg(d) OVER p END AS rolling FROM
    (SELECT Location_ID, Date, CAST(sum(Quantity) AS DOUBLE) AS d FROM sales GROUP BY 1, 2) WINDOW w AS (PARTITION BY Location_ID ORDER BY Date), p AS (PARTITION BY Location_ID ORDER BY Date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""}


def cases(t):
    daily = metrics.location_daily(t.sales).select("Location_ID", "Date", F.col("Demand").cast("double").alias("Actual"))
    lagged = windows.lags(daily, "Actual", "Location_ID", "Date", [7])
    return lagged.select(
        scalar.case_id(F.col("Date"), F.col("Location_ID")).alias("Case_ID"), "Location_ID", "Actual", F.col("lag_7").alias("seasonal"),
        windows.prior_mean("Actual", "Location_ID", "Date", 7).alias("rolling"),
    ).where(F.col("seasonal").isNotNull())


def error_sql(p: str) -> str:
    return f"""SELECT Location_ID, '{p}' AS model, count(*) AS cases, round(avg(abs(Actual - {p})), 6) AS mae, round(sqrt(avg((Actual - {p}) ** 2)), 6) AS rmse,
    round(1 - sum((Actual - {p}) ** 2) / nullif(count(*) * var_pop(Actual), 0), 6) AS r2 FROM cases WHERE {p} IS NOT NULL GROUP BY 1"""


@query("stat_error_metrics", f"{error_sql('seasonal')} UNION ALL {error_sql('rolling')}", FORECASTS)
def stat_error_metrics(t):
    found = stats.errors(cases(t), "Actual", {"seasonal": "seasonal", "rolling": "rolling"}, ["Location_ID"])
    return found.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "r2")})


@query("jn_one_to_one", "SELECT Case_ID, Actual, seasonal, round(rolling, 8) AS rolling FROM cases WHERE seasonal IS NOT NULL", FORECASTS)
def jn_one_to_one(t):
    both = materialise(cases(t))
    left, right = both.select("Case_ID", "Actual", "seasonal"), both.select("Case_ID", "Actual", F.round("rolling", 8).alias("rolling"))
    return facts.align(left, right)


@query("stat_forecast_agreement", """SELECT count(*) AS case_count, round(avg(abs(seasonal - Actual)), 6) AS left_mae, round(avg(abs(rolling - Actual)), 6) AS right_mae, round(avg(abs(seasonal - rolling)), 6) AS average_difference,
    round(100 * avg(CASE WHEN abs(seasonal - rolling) <= 50 THEN 1.0 ELSE 0.0 END), 6) AS agreement_percentage FROM cases WHERE seasonal IS NOT NULL""", FORECASTS)
def stat_forecast_agreement(t):
    found = stats.agreement(cases(t), "seasonal", "rolling")
    return found.select("case_count", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("stat_agreement_legacy", """WITH x AS (SELECT *, abs(seasonal - rolling) AS n FROM cases WHERE seasonal IS NOT NULL) SELECT Case_ID, round(n, 8) AS Numerical_Difference,
    CASE WHEN n < (SELECT quantile_cont(n, 0.5) FROM x) THEN 'Close Match' ELSE 'Divergent' END AS Match_Status FROM x""", FORECASTS)
def stat_agreement_legacy(t):
    found = stats.agreement_median(cases(t), "seasonal", "rolling")
    return found.select("Case_ID", F.round("Numerical_Difference", 8).alias("Numerical_Difference"), "Match_Status")


LABELLED = {"labelled": "SELECT Wastage_ID, Quantity_Wasted > 3 AS y, 1 - CAST(Quantity_Wasted AS DOUBLE) / Prepared_Quantity AS p FROM wastage"}


def labelled(t):
    return t.wastage.select("Wastage_ID", (F.col("Quantity_Wasted") > 3).alias("y"), (1 - F.col("Quantity_Wasted") / F.col("Prepared_Quantity")).alias("p"))


@query("stat_confusion", """SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 8) AS accuracy, round(CAST(tp AS DOUBLE) / (tp + fp), 8) AS "precision", round(CAST(tp AS DOUBLE) / (tp + fn), 8) AS recall,
    round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 8) AS f1 FROM (SELECT count(*) FILTER (y AND p >= 0.88) AS tp, count(*) FILTER (NOT y AND p >= 0.88) AS fp, count(*) FILTER (y AND NOT p >= 0.88) AS fn,
    count(*) FILTER (NOT y AND NOT p >= 0.88) AS tn FROM labelled)""", LABELLED)
def stat_confusion(t):
    found = stats.confusion(labelled(t).withColumn("hit", F.col("p") >= 0.88), "y", "hit")
    return found.withColumns({c: F.round(c, 8) for c in ("accuracy", "precision", "recall", "f1")})


F1 = "coalesce(CAST(2 * count(*) FILTER (y AND p >= th) AS DOUBLE) / nullif(2 * count(*) FILTER (y AND p >= th) + count(*) FILTER (NOT y AND p >= th) + count(*) FILTER (y AND NOT p >= th), 0), 0)"


@query("stat_threshold_sweep", f"""SELECT round(th, 6) AS threshold, round({F1}, 8) AS f1 FROM labelled, (SELECT 0.1::DOUBLE + 0.05::DOUBLE * unnest(range(17)) AS th) GROUP BY th""", LABELLED)
def stat_threshold_sweep(t):
    found = stats.threshold_scores(labelled(t), "y", "p")
    return found.select(F.round("threshold", 6).alias("threshold"), F.round("f1", 8).alias("f1"))


@query("stat_best_threshold", f"""SELECT round(th, 6) AS threshold, round(f, 8) AS f1 FROM (SELECT th, {F1} AS f FROM labelled, (SELECT 0.1::DOUBLE + 0.05::DOUBLE * unnest(range(17)) AS th) GROUP BY th) ORDER BY round(f, 12) DESC, th LIMIT 1""", LABELLED)
def stat_best_threshold(t):
    found = stats.best_threshold(labelled(t), "y", "p")
    return found.select(F.round("threshold", 6).alias("threshold"), F.round("f1", 8).alias("f1"))


# -- report tables ---------------------------------------------------------------------------------------

PRICE_LABELS = """SELECT count(*) AS n FROM (SELECT Item_ID, avg((CAST(Price AS DOUBLE) / CAST(prev AS DOUBLE) - 1) * 100) AS p FROM (SELECT *, lag(Price) OVER (PARTITION BY Item_ID ORDER BY Effective_Date, Pricing_ID) AS prev FROM prices) GROUP BY 1)
    WHERE abs(round(p, 9)) > 10"""
REPORT = {
    **SIMPLE, **CHURN, **BASKET, **FORECASTS, **RULES,
    "class_rows": f"SELECT *, {by_median('vm', 'pm')} AS cls FROM stats, medians",
}


def top_sql(section: str, label: str, value: str, source: str, n: int) -> str:
    return f"""(SELECT '{section}' AS section, row_number() OVER (ORDER BY round(v, 9) DESC, l) AS rank, l AS label, v AS value FROM
        (SELECT CAST({label} AS VARCHAR) AS l, CAST({value} AS DOUBLE) AS v FROM {source} ORDER BY {value} DESC, {label} LIMIT {n}))"""


def count_sql(section: str, label: str, source: str) -> str:
    return f"SELECT '{section}' AS section, 0 AS rank, {label} AS label, CAST(count(*) AS DOUBLE) AS value FROM {source} GROUP BY 3"


@query("rpt_sections", " UNION ALL ".join([
    top_sql("01 most profitable", "Item_ID", "Total_Profit", "class_rows", 5), top_sql("02 highest volume", "Item_ID", "Total_Quantity_Sold", "class_rows", 5),
    top_sql("03 hidden opportunities", "Item_ID", "Profit_Pct", "class_rows WHERE cls = 'Hidden Opportunity'", 5), top_sql("04 low performers", "Item_ID", "Profit_Pct", "class_rows WHERE cls = 'Low Performer'", 5),
    top_sql("05 high wastage", "Item_ID", "Total_Wasted", "wq3 WHERE Risk_Level = 'High'", 5), count_sql("06 customer segments", "Segment", f"({SEGMENT_SQL})"),
    count_sql("07 at-risk customers", "'customers'", "lost WHERE Churn_Risk = 'High'"),
    top_sql("08 combinations", "pair", "round(Lift, 8)", "(SELECT *, Antecedent_Item_ID || ' -> ' || Consequent_Item_ID AS pair FROM found_rules)", 5),
    top_sql("09 forecast errors", "model", "mae", f"(SELECT model, mae FROM ({error_sql('seasonal').replace('SELECT Location_ID,', 'SELECT', 1).replace('GROUP BY 1', '')} UNION ALL {error_sql('rolling').replace('SELECT Location_ID,', 'SELECT', 1).replace('GROUP BY 1', '')}))", 10),
    f"SELECT '10 price-sensitive items' AS section, 0 AS rank, 'items' AS label, CAST(n AS DOUBLE) AS value FROM ({PRICE_LABELS})",
    top_sql("11 top locations", "Location_ID", "rev", "(SELECT Location_ID, sum(Quantity * Unit_Price) AS rev FROM sales GROUP BY 1)", 3), count_sql("12 recommendations", "Priority", "advice"),
]), REPORT)
def rpt_sections(t):
    return report(t, customers.segment_labels(place_profiles(t)))


def report(t, segments):
    """The report over named segments; tables that several sections read are stored once."""
    mean = stats.errors(cases(t), "Actual", {"seasonal": "seasonal", "rolling": "rolling"}).withColumn("mae", F.round("mae", 6))
    rules = basket.rules(t.sales, min_pairs=2).withColumn("Lift", F.round("Lift", 8))
    return advice.report_sections(
        item_classes(t), waste_levels(t), segments, lost_customers(t), rules, mean,
        metrics.price_change_label(t.prices, t.lines), metrics.by_key_line_mean(t.sales, ["Location_ID"]), simple_advice(t),
    )


@query("agg_legacy_summary", """SELECT (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT Location_ID, count(DISTINCT Order_ID) AS n FROM sales GROUP BY 1)) AS total_orders, (SELECT count(*) FROM rfm) AS segmented_customers, (SELECT count(*) FROM stats) AS menu_items,
    (SELECT count(*) FROM advice WHERE Priority = 'Critical') AS critical_recommendations, (SELECT count(*) FROM cases WHERE seasonal IS NOT NULL) AS comparison_cases,
    (WITH x AS (SELECT abs(seasonal - rolling) AS n FROM cases WHERE seasonal IS NOT NULL) SELECT round(100 * avg(CASE WHEN n < (SELECT quantile_cont(n, 0.5) FROM x) THEN 1.0 ELSE 0.0 END), 2) FROM x) AS reported_agreement_percentage""", REPORT)
def agg_legacy_summary(t):
    compared = stats.agreement_median(cases(t), "seasonal", "rolling")
    return metrics.summary(
        menu.item_stats(t.sales, t.menu, t.raw_ratings, t.wastage), metrics.rfm(t.sales), metrics.by_key_line_mean(t.sales, ["Location_ID"]), simple_advice(t), compared
    )



