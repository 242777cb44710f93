"""Decision rules on tiny tables."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.operators import advice, customers, events, filters, menu, stats
from larder.operators.wastage import risk_band


def test_menu_contradictions(rows):
    df = rows(
        "Item_ID long, sales long, profit_percent double, contribution double, Average_Rating double, Rating_Count long, wastage_quantity long, "
        "repeat_purchase_rate double, promotion_dependency double, sales_trend_percent double, orders long, active_days long",
        [
            (1, 1000, 40.0, 40000.0, 4.5, 100, 10, 0.35, 0.05, 12.0, 80, 365),
            (2, 900, -10.0, -9000.0, 4.2, 100, 5, 0.30, 0.08, 2.0, 70, 365),
            (3, 700, 30.0, 21000.0, 4.0, 100, 300, 0.25, 0.05, 3.0, 60, 365),
            (4, 50, 60.0, 3000.0, 4.8, 30, 1, 0.32, 0.02, 20.0, 15, 365),
            (5, 20, -5.0, -100.0, 2.0, 20, 8, 0.01, 0.60, -50.0, 10, 10),
        ],
    )
    got = {r["Item_ID"]: r for r in menu.classify_items(df).collect()}
    assert [got[i]["classification"] for i in range(1, 5)] == ["Profit Driver", "Volume Driver", "Volume Driver", "Hidden Opportunity"]
    assert got[5]["insufficient_history"]
    assert got[3]["classification_evidence"]["wastage_percent"] == 30.0


SLOW = (
    "Item_ID long, Scope string, sales long, orders long, history_days int, days_since_last_purchase int, sales_trend_percent double, repeat_purchase_rate double, "
    "profit_percent double, contribution double, wastage_percent double, seasonal_top3_share double, active_months int, Average_Rating double, Rating_Count long"
)


def dish(item, sales, orders, scope="GLOBAL", **changes):
    row = dict(Item_ID=item, Scope=scope, sales=sales, orders=orders, history_days=365, days_since_last_purchase=2, sales_trend_percent=10.0, repeat_purchase_rate=0.25,
               profit_percent=50.0, contribution=1000.0, wastage_percent=3.0, seasonal_top3_share=0.35, active_months=12, Average_Rating=4.2, Rating_Count=20)
    return tuple({**row, **changes}.values())


def test_slow_moving_statuses(rows):
    data = [
        dish(1, 2, 2, profit_percent=90.0, contribution=500.0, repeat_purchase_rate=0.2),
        dish(2, 3, 2, history_days=20),
        dish(3, 4, 3, seasonal_top3_share=0.9, active_months=8, days_since_last_purchase=60, sales_trend_percent=-60.0, repeat_purchase_rate=0.01),
        dish(4, 1, 1, days_since_last_purchase=45, sales_trend_percent=-50.0, repeat_purchase_rate=0.01, profit_percent=5.0, wastage_percent=25.0),
        *[dish(10 + i, 100 + i, 70 + i) for i in range(8)],
    ]
    got = {r["Item_ID"]: r for r in menu.assess_slow_moving(rows(SLOW, data)).collect()}
    assert [got[i]["Slow_Moving_Status"] for i in range(1, 5)] == ["HIDDEN_OPPORTUNITY", "INSUFFICIENT_HISTORY", "SEASONAL_REVIEW", "SLOW_MOVER"]
    assert got[2]["History_Status"] == "INSUFFICIENT" and got[4]["Severity"] == "HIGH"
    assert got[4]["Evidence"]["volume_percentile"] < 0.35 and "order frequency" in got[4]["Reason"]


def test_slow_moving_is_relative_to_the_scope(rows):
    data = [
        dish(99, 1, 1, "LOCATION_1", days_since_last_purchase=50, sales_trend_percent=-50.0, repeat_purchase_rate=0.01),
        dish(99, 1000, 500, "LOCATION_2", days_since_last_purchase=1, sales_trend_percent=20.0, repeat_purchase_rate=0.3),
        *[dish(200 + i, 100 + i, 70 + i, f"LOCATION_{s}") for s in (1, 2) for i in range(5)],
    ]
    got = {(r["Scope"], r["Item_ID"]): r for r in menu.assess_slow_moving(rows(SLOW, data)).collect()}
    assert got["LOCATION_1", 99]["Slow_Moving_Status"] == "SLOW_MOVER"
    assert got["LOCATION_2", 99]["Slow_Moving_Status"] == "NOT_SLOW"
    assert got["LOCATION_1", 99]["Evidence"]["location_context"] == "LOCATION_1"


def test_sensitivity_and_trap(rows):
    df = rows("a double, b double, c double, d double", [(100.0, 100.0, 50.0, 20.0), (100.0, 140.0, 100.0, 10.0), (100.0, 140.0, 100.0, 75.0), (100.0, 140.0, 100.0, 110.0), (100.0, 140.0, 100.0, 95.0), (0.0, 1.0, 1.0, 1.0)])
    got = [r[0] for r in df.select(events.sensitivity(*[F.col(c) for c in "abcd"])).collect()]
    assert got == ["NOT VERIFIABLE", "HIGH", "MODERATE", "UNDETERMINED", "LOW", "NOT VERIFIABLE"]
    # Exactly at the limits of one half, one and 0.005.
    edge = rows("a double, b double, c double, d double", [(100.0, 110.0, 100.0, 90.0), (100.0, 60.0, 100.0, 120.0), (200.0, 201.0, 100.0, 99.9)])
    assert [r[0] for r in edge.select(events.sensitivity(*[F.col(c) for c in "abcd"])).collect()] == ["HIGH", "MODERATE", "LOW"]
    pair = rows("o0 long, o1 long, q0 long, q1 long, c0 double, c1 double", [(0, 5, 1, 2, 2.0, 1.0), (3, 5, 1, 2, 2.0, 1.0), (3, 5, 1, 2, 1.0, 2.0)])
    trap = events.promo_trap(*[(F.col(f"{c}0"), F.col(f"{c}1")) for c in "oqc"])
    assert [r[0] for r in pair.select(trap).collect()] == [None, True, False]


def test_segment_names_respect_recency(rows):
    data = list(zip(range(5), [224.0, 21.0, 13.0, 28.0, 152.0], [1.0, 2.4, 22.5, 1.0, 2.2], [15000.0, 38000.0, 348000.0, 15600.0, 34600.0]))
    df = rows("Cluster int, Recency_Days double, Frequency double, Monetary double", data)
    got = {r["Cluster"]: r["Segment"] for r in customers.segment_labels(df).collect()}
    assert (got[0], got[2], got[3], got[4]) == ("At Risk", "High Value", "Occasional", "Cooling")


def test_risk_band_follows_the_probability(rows):
    df = rows("e double, p double", [(1.0, 0.9), (20.0, 0.1), (8.0, 0.1), (1.0, 0.1)])
    assert [r[0] for r in df.select(risk_band(F.col("e"), F.col("p"), 10.0, 0.5)).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_filter_contract():
    with pytest.raises(ValueError, match="date_from"):
        filters.Filters(date_from=date(2025, 2, 1), date_to=date(2025, 1, 1))
    with pytest.raises(ValueError, match="unsupported wastage filter"):
        filters.Filters(channel="App").for_report("wastage")
    with pytest.raises(ValueError):
        filters.Filters(location_id=0)
    with pytest.raises(ValueError, match="channel"):
        filters.Filters(channel="Carrier pigeon")
    assert filters.Filters(location_id=3).for_report("customers").location_id == 3


SALE = "Order_Item_ID long, Order_ID long, Customer_ID long, Item_ID long, Category_ID long, Location_ID long, Order_DateTime timestamp_ntz, Promotion_ID long, Quantity long, Unit_Price decimal(18,2), Net_Revenue decimal(18,2), Cost_Total decimal(18,2), Contribution decimal(18,2), Discount_Applied decimal(18,2)"


def sale(n, item, category, place, at, qty=1, tag=None, customer=1):
    d = Decimal
    return (n, n, customer, item, category, place, at, tag, qty, d(10), d(10 * qty), d(4 * qty), d(6 * qty), d(0))


CAMPAIGN = "Promotion_ID long, Promotion_Name string, Discount_Percent long, Start_Date date, End_Date date, Applicable_Item_ID long, Applicable_Category_ID long, Location_ID long"


def test_campaign_targets_and_midnight(rows):
    june = [datetime(2025, 5, 31, 23, 59), datetime(2025, 6, 1), datetime(2025, 6, 30, 23, 59), datetime(2025, 7, 1)]
    sales = rows(SALE, [sale(i, 4, 4, 1, t) for i, t in enumerate(june)] + [sale(10, 5, 4, 1, june[1]), sale(11, 4, 4, 2, june[1])]).withColumn("Date", F.to_date("Order_DateTime"))
    span = (date(2025, 6, 1), date(2025, 6, 30))
    campaigns = rows(CAMPAIGN, [(1, "dish", 1, *span, 4, 4, 1), (2, "category", 1, *span, None, 4, None), (3, "all", 1, *span, None, None, None)])
    got = {}
    for r in filters.eligible(sales, campaigns).collect():
        got.setdefault(r["Campaign_ID"], set()).add(r["Order_Item_ID"])
    assert got == {1: {1, 2}, 2: {1, 2, 10, 11}, 3: {1, 2, 10, 11}}
    assert {r[0] for r in filters.eligible_for(sales, item=4, location=1).select("Order_Item_ID").collect()} == {0, 1, 2, 3}


def test_campaign_windows_outside_the_data_are_null(rows):
    days = [datetime(2025, 1, 1) + timedelta(days=i) for i in range(40)]
    sales = rows(SALE, [sale(i, 4, 4, 1, t, qty=1 + (10 <= i < 20), customer=i % 3, tag=1) for i, t in enumerate(days)]).withColumn("Date", F.to_date("Order_DateTime"))
    campaigns = rows(CAMPAIGN, [(1, "middle", 1, date(2025, 1, 11), date(2025, 1, 20), 4, None, None), (2, "early", 1, date(2025, 1, 3), date(2025, 1, 12), 4, None, None)])
    wastage = rows("Item_ID long, Location_ID long, Wastage_Date date, Cost_Impact decimal(18,2)", [(4, 1, date(2025, 1, 11), Decimal(7)), (9, 1, date(2025, 1, 11), Decimal(9))])
    got = {r["Promotion_ID"]: r for r in events.promo_windows(sales, campaigns, wastage).collect()}
    one, two = got[1], got[2]
    assert (one["before_quantity"], one["during_quantity"], one["after_quantity"]) == (10, 20, 10)
    assert (one["during_customers"], one["repeat_customers"], one["tagged_campaign_orders"], one["wastage_cost"]) == (3, 3, 10, 7)
    assert one["promotion_trap"] is False and one["eligible_item_count"] == 1
    assert two["before_quantity"] is None and two["promotion_trap"] is None and not two["comparison_available"]


def test_price_windows_match_brute_force(rows):
    days = [datetime(2025, 1, 1) + timedelta(days=i) for i in range(200)]
    sales = rows(SALE, [sale(i * 2 + k, k, 1, 1, t, qty=1 + (i * 7 + k) % 5) for i, t in enumerate(days) for k in (1, 2)]).withColumn("Date", F.to_date("Order_DateTime"))
    changes = [(i, 1 + i % 2, Decimal(10 + i % 5), date(2025, 1, 5) + timedelta(days=9 * i)) for i in range(20)]
    prices = rows("Pricing_ID long, Item_ID long, Price decimal(18,2), Effective_Date date", changes)
    got = {(r["Item_ID"], r["Effective_Date"]): (r["Before_Quantity"], r["After_Quantity"]) for r in events.price_windows(sales, prices).collect()}
    units = {(r["Item_ID"], r["Date"]): r["Quantity"] for r in sales.collect()}
    expected = {}
    for item in (1, 2):
        own = sorted([c for c in changes if c[1] == item], key=lambda c: c[3])
        for old, new in zip(own, own[1:]):
            if old[2] != new[2]:
                sums = [sum(units.get((item, new[3] + timedelta(days=x)), 0) for x in span) for span in (range(-30, 0), range(0, 30))]
                if all(sums):
                    expected[item, new[3]] = tuple(sums)
    assert got == expected


def test_threshold_sweep_matches_brute_force(rows):
    data = [((i * 37 % 100) / 100, (i * 53 % 7) < 2) for i in range(500)]
    df = rows("p double, y boolean", data)
    got = [(r["threshold"], r["f1"]) for r in stats.threshold_scores(df, "y", "p").orderBy("threshold").collect()]
    assert len(got) == 17
    for threshold, f1 in got:
        tp = sum(y and p >= threshold for p, y in data)
        fp = sum((not y) and p >= threshold for p, y in data)
        fn = sum(y and p < threshold for p, y in data)
        assert f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    best = stats.best_threshold(df, "y", "p").first()
    assert best["f1"] == pytest.approx(max(f for _, f in got))


def test_what_if_without_waste(rows):
    sales = rows(SALE, [sale(1, 4, 4, 1, datetime(2025, 1, 1), qty=10), sale(2, 4, 4, 2, datetime(2025, 1, 2), qty=10)]).withColumn("Date", F.to_date("Order_DateTime"))
    wastage = rows("Item_ID long, Location_ID long, Quantity_Wasted long, Prepared_Quantity long", [(4, 1, 2, None)])
    ddl = ("Scenario_ID long, Item_ID long, Location_ID long, Promotion_ID long, price_change_percent double, discount_change_percent double, "
           "demand_change_percent double, preparation_change_percent double, promotion_discount_percent double")
    scenarios = rows(ddl, [(1, 4, None, None, 10.0, 0.0, -10.0, 0.0, None), (2, 4, 2, None, 0.0, 0.0, 0.0, 0.0, 50.0), (3, 77, None, None, 0.0, 0.0, 0.0, 0.0, None)])
    got = {r["Scenario_ID"]: r for r in advice.what_if(sales, wastage, scenarios).collect()}
    assert set(got) == {1, 2}
    assert got[1]["baseline_quantity"] == 20 and got[1]["scenario_quantity"] == pytest.approx(18)
    assert got[1]["scenario_revenue"] == pytest.approx(18 * 11) and got[1]["scenario_wastage_units"] == pytest.approx(4)
    assert got[2]["scenario_revenue"] == pytest.approx(50) and got[2]["baseline_wastage_units"] is None
