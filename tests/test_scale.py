"""Results that must not cost a row per key and calendar step, nor a broadcast of a large table."""

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from larder.binding import Tables
from larder.functions import ordering
from larder.operators import advice, demand, facts, forecast, menu, metrics, rollup, wastage
from larder.plans import model_queries

PAIR = ["Item_ID", "Location_ID"]


def test_grid_totals_equal_the_built_grid(rows):
    monday = date(2023, 11, 6)
    data = [(i, p, monday + timedelta(days=7 * w), (w * i) % 5 if w % 4 else None) for i in (1, 2) for p in (1, None) for w in range(0, 70, i + 2)]
    weekly = rows("Item_ID long, Location_ID long, Week date, Wasted long", [*data, (3, 1, None, 4)])
    keys = weekly.select(*PAIR).distinct()
    low, high = weekly.agg(F.min("Week")).scalar(), weekly.agg(F.max("Week")).scalar()
    grid = facts.grid(keys, low, high, "7 DAYS", "Week").join(weekly, [*PAIR, "Week"], "left")
    wanted = grid.groupBy(*PAIR, F.year("Week").cast("long").alias("Year")).agg(F.count(F.lit(1)).alias("weeks"), F.count("Wasted").alias("known_weeks"), F.coalesce(F.sum("Wasted"), F.lit(0)).alias("Wasted"))
    totals = facts.grid_totals(keys, weekly, low, high, PAIR, "Wasted")
    assert sorted(totals.collect(), key=repr) == sorted(wanted.select(*totals.columns).collect(), key=repr)
    assert facts.grid_totals(keys.limit(0), weekly.limit(0), weekly.limit(0).agg(F.min("Week")).scalar(), weekly.limit(0).agg(F.max("Week")).scalar(), PAIR, "Wasted").count() == 0


def test_scenarios_are_never_broadcast(rows):
    sales = rows(
        "Item_ID long, Category_ID long, Location_ID long, Date date, Quantity long, Unit_Price double, Discount_Applied double, Net_Revenue double, Contribution double, Cost_Total double, Promotion_ID long",
        [(1, 1, 1, date(2024, 1, 5), 2, 3.0, 0.0, 6.0, 2.0, 4.0, 7)],
    )
    wastage = rows("Item_ID long, Location_ID long, Quantity_Wasted long, Prepared_Quantity long", [(1, 1, 1, 3)])
    campaigns = rows("Promotion_ID long, Start_Date date, End_Date date, Applicable_Item_ID long, Applicable_Category_ID long, Location_ID long", [(7, date(2024, 1, 1), date(2024, 2, 1), 1, None, None)])
    names = ("price_change_percent", "discount_change_percent", "demand_change_percent", "preparation_change_percent", "promotion_discount_percent")
    scenarios = rows(f"Scenario_ID long, Item_ID long, Location_ID long, Promotion_ID long, {', '.join(n + ' double' for n in names)}", [(1, 1, None, None, 0.0, 0.0, 0.0, 0.0, None), (2, 1, None, 7, 0.0, 0.0, 0.0, 0.0, None)])
    found = advice.what_if(sales, wastage, scenarios, campaigns)
    assert {r["Scenario_ID"]: r["baseline_quantity"] for r in found.collect()} == {1: 2.0, 2: 2.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 4


def test_monthly_totals_equal_the_daily_series(rows):
    start = date(2024, 12, 20)
    data = [(1 + i % 5, start + timedelta(days=(i * i * 7 + i) % 190), 1 + i % 4) for i in range(70)]
    sold = rows("Item_ID long, Date date, Quantity long", [*data, (2, start, 0), (3, start + timedelta(days=5), None), (None, start, 3), (9, start, 1)])
    # One dish starts twice, one has no key, one starts after the last day.
    starts = rows("Entity_ID long, Start date", [(1, date(2024, 1, 1)), (2, date(2025, 2, 3)), (2, date(2025, 3, 31)), (3, None), (4, date(2025, 3, 1)), (None, start), (7, date(2026, 1, 1)), (8, start)])
    for first in (starts, None):
        daily = forecast.daily_series(sold, "Item_ID", first)
        wanted = daily.groupBy("Entity_ID", F.date_format("Date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("days"), F.sum("Demand").alias("demand"), F.count_if(F.col("Demand") == 0).alias("quiet_days"))
        got = forecast.monthly_totals(sold, "Item_ID", first)
        assert sorted(got.collect(), key=repr) == sorted(wanted.collect(), key=repr)
    assert forecast.monthly_totals(sold.limit(0), "Item_ID", starts).count() == 0


def test_forest_over_compact_days_loses_none(rows):
    start = date(2024, 1, 1)
    data = [(e, start + timedelta(days=(e * 13 + k * 29) % 200), 1 + (e + k) % 3) for e in range(1, 81) for k in range(5)]
    s = demand.series(rows("Item_ID long, Date date, Quantity long", data), "Item_ID")
    days = demand.weighted_features(s, s.last)
    cuts = ordering.bands(days, demand.CUT)
    assert "Entity_ID" in cuts and len(cuts["Entity_ID"]) <= 31
    small = demand.compact(days, cuts)
    total = lambda df: df.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("Demand"))).first()
    assert tuple(total(small)) == tuple(total(days)) and small.count() < days.count()
    model = demand.fit(s, s.last, trees=3, compact_from=1)
    assert isinstance(model, forecast.Banded)
    ahead = demand.future(model, s, 3).collect()
    assert ahead and all(0 <= r["Prediction"] <= 9 for r in ahead)
    assert not isinstance(demand.fit(s, s.last, trees=3), forecast.Banded)


def test_tree_over_means_is_the_tree_over_days(rows):
    start = date(2024, 1, 1)
    data = [(e, start + timedelta(days=(e * 13 + k * 29) % 200), 1 + (e + k) % 3) for e in range(1, 81) for k in range(5)]
    s = demand.series(rows("Item_ID long, Date date, Quantity long", data), "Item_ID")
    active = demand.active_features(s, s.last)
    cuts = ordering.bands(active, demand.CUT)
    days, means = demand.compact(demand.weighted_features(s, s.last), cuts), demand.averaged(s, s.last, active, cuts)
    total = lambda df: df.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("Demand"))).first()
    assert total(means)[0] == total(days)[0] and abs(total(means)[1] - total(days)[1]) < 1e-6
    assert means.count() < days.count()
    grow = lambda df: DecisionTreeRegressor(labelCol="Demand", weightCol="weight", maxDepth=6).fit(forecast.vectors(df))
    one, two = grow(days), grow(means)
    seen = forecast.vectors(days)
    read = lambda model: sorted(r["prediction"] for r in model.transform(seen).select("prediction").collect())
    assert one.numNodes == two.numNodes > 9 and all(abs(a - b) < 1e-9 for a, b in zip(read(one), read(two)))


def test_active_days_are_made_from_sold_days_alone(rows):
    start = date(2024, 1, 1)
    s = demand.series(rows("Item_ID long, Date date, Quantity long", [(e, start + timedelta(days=9 * k), 1) for e in (1, 2) for k in range(20)]), "Item_ID")
    plan = demand.active_features(s, s.last)._jdf.queryExecution().optimizedPlan().toString()
    # No second read of the sold days and no distinct over the days after them.
    assert "Aggregate [" not in plan and plan.count("Relation [Entity_ID") == 2


def test_recursion_deals_entities_over_tasks(rows, spark, monkeypatch):
    monkeypatch.setattr(forecast, "PER_TASK", 10)
    histories = rows("Entity_ID long, history array<double>", [(e, [float(e % 3)] * 7) for e in range(25)]).coalesce(1)
    lagged = histories.select("Entity_ID", F.element_at("history", 7).alias("lag_1"), *[F.lit(1.0).alias(c) for c in forecast.FEATURES[1:3] + forecast.FEATURES[4:]], F.lit(2.0).alias("Demand"))
    ahead = forecast.recursive(forecast.fit_rf(lagged, trees=1, depth=2), histories, date(2024, 1, 1), 2)
    assert ahead.count() == 50 and ahead.rdd.getNumPartitions() == 3


def test_grains_share_one_join_of_the_sales(rows, spark):
    t = Tables(spark, "no folder")
    day = date(2024, 1, 1)
    data = [(i, None if i == 3 else i % 2, i % 3, day + timedelta(days=k // 2), None if k == 5 else k) for i in range(5) for k in range(9)]
    vars(t).update(sales=rows("Item_ID long, Category_ID long, Location_ID long, Date date, Quantity long", data), menu=rows("Item_ID long, Introduced_Date date", [(i, day) for i in range(5)]))
    for grain, entity in model_queries.GRAINS.items():
        listed = lambda s: sorted(map(repr, s.observed.collect()))
        starts = t.menu.select(F.col("Item_ID").alias("Entity_ID"), F.col("Introduced_Date").alias("Start")) if grain == "item" else None
        assert listed(model_queries.grain_series(t, grain)) == listed(demand.series(t.sales, entity, starts))
    assert list(t._kept) == ["daily_units"]


def test_boosting_over_counted_weeks_is_boosting_over_weeks(rows):
    first = date(2024, 1, 1)
    data = [(i, p, first + timedelta(days=7 * w), (i + w) % 4, 6 + i % 2, (w + p) % 5) for i in range(1, 7) for p in (1, 2) for w in range(0, 60) if (i * w + p) % 3]
    known = rows("Item_ID long, Location_ID long, Week date, Wasted long, Prepared long, Demand long", data)
    split = wastage.split_weeks(wastage.sparse_features(known, F.lit(first)))
    # The same weeks twice: a counted week weighs two.
    twice = split.unionByName(split)
    train = twice.where(F.col("split") == "train")
    assert wastage.compact(train, {}).agg(F.sum("weight")).first()[0] == train.count() > wastage.compact(train, {}).count()
    plain, counted = wastage.fit_wastage(twice, iterations=3, depth=3), wastage.fit_wastage(twice, iterations=3, depth=3, compact_from=1)
    assert plain.cuts is None and counted.cuts == {} and plain.cut == counted.cut
    test = split.where(F.col("split") == "test")
    keyed = lambda m: {(r["Item_ID"], r["Location_ID"], r["Week"]): r["Expected_Wastage"] for r in wastage.score(m, test).collect()}
    one, two = keyed(plain), keyed(counted)
    assert one and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_boosting_learns_each_label_from_its_own_weeks(rows):
    data = [(i % 3, 1, 6, 23, None, 1, None, 0, 0.5, None, w) for i in range(40) for w in (0, 0, 1, 2, 5, i % 7)]
    kinds = {"rolling_demand_4": "double", "rolling_waste_4": "double"}
    train = rows(", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*wastage.FEATURES, "Wasted"]), data)
    counted = wastage.compact(train, {})
    amount, risk = wastage.by_label(counted, 1.0)
    assert (amount.count(), risk.count()) == (3, 6) and counted.count() > 6
    sums = amount.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("Wasted"))).first()
    assert sums[0] == train.count() and abs(sums[1] - train.agg(F.sum("Wasted")).first()[0]) < 1e-9
    high = {r["High"]: r["n"] for r in risk.groupBy("High").agg(F.sum("weight").alias("n")).collect()}
    assert high == {1.0: train.where("Wasted > 1").count(), 0.0: train.where("Wasted <= 1").count()}


def test_scoped_slow_facts_move_wide_rows_once(rows, spark):
    day = date(2024, 5, 1)
    sold = rows("Location_ID long, Item_ID long, Date date, Quantity long", [(p, i, day + timedelta(days=40 * k), 1 + k) for p in (1, 2) for i in (1, 2, None) for k in range(5)])
    rated = rows("Location_ID long, Item_ID long, last_sale timestamp_ntz", [(1, 1, datetime(2024, 9, 1)), (2, 1, None), (2, 2, None), (2, 4, None), (None, 1, None), (1, None, None), (1, 5, None)])
    dishes = rows("Item_ID long, Introduced_Date date", [(1, day), (2, day), (2, date(2024, 6, 1)), (5, None), (None, day), (7, day)])
    places = rows("Location_ID long, Opening_Date date", [(1, date(2024, 4, 1)), (2, date(2024, 5, 9))])
    snapshot = F.lit(date(2024, 12, 1))
    apart = metrics.history_days(rated.join(places, "Location_ID"), dishes, snapshot, F.col("Opening_Date")).drop("Opening_Date")
    apart = menu.with_global_sales(apart, sold).join(metrics.seasonality(sold, ["Location_ID", "Item_ID"]), ["Location_ID", "Item_ID"], "left").fillna({"active_months": 0, "seasonal_top3_share": 0.0})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = menu.slow_facts_by_location(rated, sold, dishes, places, snapshot)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.count() == 7 and sorted(map(repr, got.drop("Scope").select(apart.columns).collect())) == sorted(map(repr, apart.collect()))
    # Seasons meet the rows first, where they lie by both keys; the two tables of a dish meet each other.
    assert plan.index("FullOuter") > plan.index("LeftOuter") and plan.count("LeftOuter") == 2


def test_ranges_of_many_dishes_leave_the_columns_as_they_were(rows):
    weeks = rows("Item_ID long, lag_waste_1 long", [(i, i % 2 or None) for i in range(100)])
    cuts = ordering.bands(weeks, ["Item_ID", "lag_waste_1"])
    assert set(cuts) == {"Item_ID"}
    placed = weeks.select("Item_ID", ordering.banded(cuts)["Item_ID"].alias("range")).collect()
    sizes = [sum(r["range"] == k for r in placed) for k in range(len(cuts["Item_ID"]) + 1)]
    assert sum(sizes) == 100 and max(sizes) <= 5


def some_sales(rows):
    """Orders of two lines or more of one dish, repeated lines, and missing orders and customers."""
    data = [
        (None if n % 11 == 0 else n // 3 % 17, None if n % 13 == 0 else n // 3 % 17 % 5, n % 4 + 1, f"dish {n % 4 + 1}", n % 2, n % 3, "a" if n % 2 else None,
         datetime(2024, 1, 1 + n // 3 % 17 % 3, 5), date(2024, 1, 1 + n // 3 % 17 % 3), n % 5 + 1, Decimal(n) / 4, Decimal(n) / 8, Decimal(n) / 8, Decimal(1))
        for n in [*range(120), 5, 5, 7]
    ]
    return rows(
        "Order_ID long, Customer_ID long, Item_ID long, Item_Name string, Category_ID long, Location_ID long, Channel string, Order_DateTime timestamp_ntz, Date date, Quantity long,"
        " Net_Revenue decimal(18,2), Cost_Total decimal(18,2), Contribution decimal(18,2), Discount_Applied decimal(18,2)", data,
    )


def test_dish_totals_hold_no_order_in_a_hash_table(rows):
    sales = some_sales(rows)
    dish = ["Item_ID", "Item_Name"]
    lines = metrics.per_order(sales, dish)
    people = lines.groupBy(*dish, "Customer_ID").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"))
    wanted = people.groupBy(*dish).agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") > 1).alias("repeat_customers"), F.sum("revenue").alias("revenue"))
    got = metrics.summarise(sales, dish)
    assert sorted(got.select(*wanted.columns).collect()) == sorted(wanted.collect()) and got.count() == 4
    assert dict(got.dtypes)["revenue"] == "decimal(38,2)"
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2


def test_dish_orders_are_counted_without_a_distinct_aggregate(rows):
    sales = some_sales(rows)
    got = metrics.menu_profit(sales)
    wanted = sales.groupBy("Item_ID").agg(F.count_distinct("Order_ID"), F.round(F.sum("Net_Revenue"), 2))
    assert sorted(got.select("Item_ID", "Orders", "Net_Revenue").collect()) == sorted(wanted.collect())
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2


def test_rollup_cells_are_added_up_over_sorted_lines(rows, tmp_path):
    sales = some_sales(rows)
    spoilt = rows("Wastage_Date date, Location_ID long, Item_ID long, Quantity_Wasted long, Cost_Impact decimal(18,2)", [(date(2024, 1, 1), 1, 1, 2, Decimal(3))])
    cells = rollup.build(sales, spoilt, sales.select("Item_ID", "Category_ID").distinct(), str(tmp_path / "cells"))
    place = ["Date", "Location_ID", "Channel", "Category_ID"]
    orders = sales.groupBy(*place, "Customer_ID", "Order_ID").agg(F.sum("Quantity").alias("units"), F.sum("Net_Revenue").alias("revenue"))
    assert sorted(cells.orders.select(*orders.columns).collect(), key=repr) == sorted(orders.collect(), key=repr)
    visits = sales.groupBy(*place, "Item_ID", "Order_ID").agg(F.sum("Quantity").alias("units"), F.max("Order_DateTime").alias("last_sale"))
    items = visits.groupBy(*place, "Item_ID").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("orders"), F.max("last_sale").alias("last_sale"))
    assert sorted(cells.items.select(*items.columns).collect(), key=repr) == sorted(items.collect(), key=repr)
    added = rollup._added(sales, [*place, "Customer_ID", "Order_ID"], "Item_ID", 1)
    assert "Aggregate" not in added._jdf.queryExecution().executedPlan().toString()


def test_grid_intervals_sort_no_weeks(rows):
    monday = date(2024, 1, 1)
    known = rows("Item_ID long, Location_ID long, Week date, Wasted long, Prepared long, Demand long", [
        *[(1, 1, monday + timedelta(days=7 * w), w if w % 2 else None, 2 * w if w % 2 else None, w if w % 3 else None) for w in (0, 1, 2, 3, 9, 20)],
        (1, None, monday, 1, 1, 1), (2, 1, monday + timedelta(days=7 * 5), 4, 4, None), (None, 1, None, 3, 3, 3),
    ])
    pairs = rows("Item_ID long, Location_ID long", [(1, 1), (1, 2), (3, 1), (None, 1)])
    spans = wastage.grid_intervals(known, pairs)
    low, high = monday, monday + timedelta(days=7 * 20)
    grid = facts.grid(pairs, F.lit(low), F.lit(high), "7 DAYS", "Week").join(known, [*PAIR, "Week"], "left")
    wanted = wastage.grid_features(grid)
    found = wastage.expand_intervals(spans).select(*wanted.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert "Window" not in spans._jdf.queryExecution().executedPlan().toString()
