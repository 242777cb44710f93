"""Two sale lines through eleven tables."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.operators import facts, metrics, quality


@pytest.fixture
def tables(rows):
    d = Decimal
    return {
        "lines": rows("Order_Item_ID long, Order_ID long, Item_ID long, Quantity long, Unit_Price decimal(18,2), Discount_Applied decimal(18,2)",
                      [(1, 1, 4, 2, d(100), d(40)), (2, 1, 21, 1, d(50), d(0))]),
        "orders": rows("Order_ID long, Customer_ID long, Location_ID long, Order_DateTime timestamp_ntz, Channel string, Promotion_ID long, Order_Status string",
                       [(1, 1, 1, datetime(2025, 7, 1), "App", 1, "Completed")]),
        "menu": rows("Item_ID long, Item_Name string, Category_ID long, Cost decimal(18,2)", [(4, "Target", 4, d(60)), (21, "Other", 4, d(20))]),
        "customers": rows("Customer_ID long, Customer_Name string", [(1, "Customer")]),
        "categories": rows("Category_ID long, Category_Name string", [(4, "Shared")]),
        "locations": rows("Location_ID long, Location_Name string, City string", [(1, "A", "Karachi")]),
        "promotions": rows("Promotion_ID long, Promotion_Name string, Discount_Percent long, Start_Date date, End_Date date, Applicable_Item_ID long, Applicable_Category_ID long",
                           [(1, "Item four", 20, date(2025, 7, 1), date(2025, 7, 31), 4, 4)]),
        "ratings": rows("Rating_ID long, Order_ID long, Item_ID long, Stars long", [(1, 1, 4, 4), (2, 1, 4, 5)]),
        "inventory": rows("Inventory_ID long, Item_ID long, Location_ID long, Period_End date, Stock_Quantity long, Reorder_Level long",
                          [(1, 4, 1, date(2025, 6, 30), 10, 2), (2, 4, 1, date(2025, 7, 31), 5, 2)]),
        "wastage": rows("Wastage_ID long, Item_ID long, Location_ID long, Quantity_Wasted long, Cost_Impact decimal(18,2)", [(1, 4, 1, 2, d(120)), (2, 4, 1, 3, d(180))]),
        "prices": rows("Pricing_ID long, Item_ID long, Price decimal(18,2), Effective_Date date",
                       [(1, 4, d(90), date(2025, 1, 1)), (2, 4, d(100), date(2025, 7, 1)), (3, 21, d(50), date(2025, 1, 1))]),
    }


def test_golden_lines(tables):
    lines = facts.integrated(**tables).orderBy("Order_Item_ID").collect()
    assert len(lines) == 2
    first, second = lines
    assert (first["Effective_Price"], first["Rating_Count"], first["Wastage_Quantity"], first["Stock_Quantity"]) == (100, 2, 5, 5)
    assert [first["Campaign_Eligible"], second["Campaign_Eligible"]] == [True, False]
    assert (first["Net_Revenue"], first["Cost_Total"], first["Contribution"]) == (160, 120, 40)


def test_golden_reports(tables):
    i = facts.integrated(**tables)
    category = metrics.by_category(i).first()
    assert (category["Units"], category["Contribution"]) == (3, 70)
    campaign = metrics.by_campaign(i).first()
    assert (campaign["Units"], campaign["Net_Revenue"]) == (2, 160)
    assert metrics.high_wastage(i).first()["Wastage_Quantity"] == 5
    quality.reconcile_gate(quality.reconcile(i, facts.build_sales(tables["lines"], tables["orders"], tables["menu"])))


def test_unknown_customer_fails_the_gate(tables):
    authority = facts.build_sales(tables["lines"], tables["orders"], tables["menu"])
    broken = {**tables, "customers": tables["customers"].where(F.col("Customer_ID") > 5)}
    with pytest.raises(ValueError, match="join rows"):
        quality.reconcile_gate(quality.reconcile(facts.integrated(**broken), authority))


def test_asof_price_matches_brute_force(rows):
    sales = rows("Order_Item_ID long, Item_ID long, Date date", [(i, i % 3, date(2025, 1 + i % 12, 1 + i % 28)) for i in range(300)])
    events = [(p, p % 2, Decimal(p), date(2025, 1 + (p * 5) % 12, 1 + (p * 11) % 28)) for p in range(40)]
    events += [(100, 0, Decimal(77), date(2025, 3, 3)), (101, 0, Decimal(78), date(2025, 3, 3))]
    prices = rows("Pricing_ID long, Item_ID long, Price decimal(18,2), Effective_Date date", events)
    got = {r["Order_Item_ID"]: r["Effective_Price"] for r in facts.asof_price(sales, prices).collect()}
    assert len(got) == 300
    for r in sales.collect():
        known = [(e[3], e[0], e[2]) for e in events if e[1] == r["Item_ID"] and e[3] <= r["Date"]]
        assert got[r["Order_Item_ID"]] == (max(known)[2] if known else None)


def test_hot_dish_is_dealt_over_keys(rows):
    """One dish has a third of all lines: the same prices, and no key of the join holds more than twice the target."""
    sales = rows("Order_Item_ID long, Item_ID long, Date date", [(i, 1 if i % 3 == 0 else i % 40, date(2025, 1 + i % 3, 1 + i % 28)) for i in range(1800)])
    prices = rows("Pricing_ID long, Item_ID long, Price decimal(18,2), Effective_Date date", [(p, p % 40, Decimal(p), date(2024 + p % 2, 1 + p % 12, 1)) for p in range(200)])
    hot = facts.hot_items(sales, 100)
    assert {r["Item_ID"]: r["parts"] for r in hot.collect()} == {1: 7}
    plain, dealt = (sorted((r["Order_Item_ID"], r["Effective_Price"]) for r in facts.asof_price(sales, prices, hot=h).collect()) for h in (None, hot))
    assert plain == dealt and len(plain) == 1800
    assert facts.asof_price(sales, prices, hot=hot).columns == facts.asof_price(sales, prices).columns
    keys = sales.where("Item_ID = 1").groupBy(F.pmod(F.xxhash64("Order_Item_ID"), F.lit(7))).count().agg(F.max("count")).first()[0]
    assert keys <= 200


def test_rollup_answers_like_the_sales(spark, tmp_path):
    """Every mix of covered filters gives what the sales give; others go to the sales."""
    from larder.binding import CHANNELS, Tables
    from larder.operators import filters, metrics, rollup
    from larder.session import materialise

    t = Tables(spark, "/root/testdata/sf0.001")
    sales = materialise(t.sales)
    cells = rollup.build(sales, t.wastage, t.menu, str(tmp_path / "cells"))
    for days, place, kind, channel in [({}, None, None, None), ({"date_from": date(1996, 5, 1), "date_to": date(1999, 2, 3)}, 3, None, "5-LOW"), ({"date_to": date(1997, 2, 3)}, None, 7, "5-LOW")]:
        f = filters.Filters(**days, location_id=place, category_id=kind, channel=channel, channels=CHANNELS)
        direct = metrics.executive(filters.apply_filters(sales, f), filters.apply_wastage_filters(t.wastage, f, t.menu))
        assert rollup.covers(f, "executive") and rollup.executive(cells, f).collect() == direct.collect()
    item = filters.Filters(item_id=17, channels=CHANNELS)
    assert not rollup.covers(item, "executive") and rollup.covers(item, "items")
    with pytest.raises(ValueError):
        rollup.executive(cells, item)
    direct = metrics.executive(filters.apply_filters(sales, item), filters.apply_wastage_filters(t.wastage, item, t.menu))
    assert rollup.answered(cells, sales, t.wastage, t.menu, item).collect() == direct.collect()
    assert "Year" in rollup.executive(cells, filters.Filters(date_from=date(1998, 1, 1), channels=CHANNELS))._jdf.queryExecution().executedPlan().toString()


def test_holdouts_must_align(rows):
    left = rows("Case_ID string, Actual double, a double", [(str(i), float(i), 1.0) for i in range(120)])
    right = rows("Case_ID string, Actual double, b double", [(str(i), float(i), 2.0) for i in range(120)])
    assert facts.align(left, right).count() == 120
    with pytest.raises(ValueError):
        facts.align(left, right.where("Case_ID <> '5'"))
    with pytest.raises(ValueError):
        facts.align(left.limit(50), right.limit(50))
