"""Results stay whole when one order, dish, customer or location holds a third of all rows."""

from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import combinations

import pytest

from larder.operators import basket, cleaning, metrics


@pytest.fixture
def baskets(rows):
    hot = [(0, i) for i in range(150)]
    rest = [(1 + i // 4, (i * 7) % 40 if i % 4 else i % 3) for i in range(320)]
    return rows("order long, item long", sorted(set(hot + rest)))


@pytest.mark.parametrize("least", [1, 2, 5])
def test_pairs_match_brute_force(baskets, monkeypatch, least):
    monkeypatch.setattr(basket, "BLOCK", 16)
    held = {}
    for r in baskets.collect():
        held.setdefault(r["order"], set()).add(r["item"])
    expected = Counter(p for items in held.values() for p in combinations(sorted(items), 2))
    got = {(r["left"], r["right"]): r["count"] for r in basket.pair_counts(baskets, least).collect()}
    assert got == {p: n for p, n in expected.items() if n >= least}


def test_item_sets_keep_support(rows):
    sales = rows("Order_ID long, Item_ID long", [(o, i) for o in range(100) for i in ((1, 2) if o < 60 else (3, 4 + o))])
    got = basket.fp_rules(sales, min_support=0.1, min_lift=1.0).collect()
    assert {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in got} == {((1,), (2,)), ((2,), (1,))}
    assert all(r["support"] == pytest.approx(0.6) for r in got)


def test_rules_with_several_items_on_either_side(rows):
    sales = rows("Order_ID long, Item_ID long", [(o, i) for o in range(60) for i in (1, 2, 3)] + [(o, 9) for o in range(60, 100)] + [(o, 8) for o in range(60, 100)])
    got = {(tuple(sorted(r["antecedent"])), tuple(sorted(r["consequent"]))): r for r in basket.fp_rules(sales, min_support=0.3).collect()}
    sides = [(a, b) for n in (1, 2) for a in combinations((1, 2, 3), n) for m in (1, 2) for b in combinations((1, 2, 3), m) if not set(a) & set(b)]
    assert set(got) == {*sides, ((9,), (8,)), ((8,), (9,))}
    assert all(got[s]["confidence"] == 1.0 and got[s]["support"] == pytest.approx(0.6) and got[s]["lift"] == pytest.approx(1 / 0.6) for s in sides)


def test_summary_with_a_hot_customer(rows):
    d = Decimal
    data = []
    for n in range(900):
        hot = n % 3 == 0
        order = n // 3 if hot else 1000 + n
        data.append((order, 1 if hot else 2 + n % 50, n % 7, n % 5, datetime(2025, 1, 1) + timedelta(hours=n), n % 4 + 1, d(n), d(1), d(n - 1), d(0)))
    sales = rows("Order_ID long, Customer_ID long, Item_ID long, Location_ID long, Order_DateTime timestamp_ntz, Quantity long, Net_Revenue decimal(18,2), Cost_Total decimal(18,2), Contribution decimal(18,2), Discount_Applied decimal(18,2)", data)
    got = {r["Item_ID"]: r for r in metrics.summarise(sales, ["Item_ID"]).collect()}
    for item in range(7):
        own = [r for r in data if r[2] == item]
        visits = Counter(c for c, _ in {(r[1], r[0]) for r in own})
        r = got[item]
        assert (r["orders"], r["customers"], r["repeat_customers"]) == (len({x[0] for x in own}), len(visits), sum(v > 1 for v in visits.values()))
        assert r["revenue"] == sum(x[6] for x in own) and r["units"] == sum(x[5] for x in own)
    people = {r["Customer_ID"]: r for r in metrics.rfm(sales).collect()}
    places = Counter(r[3] for r in data if r[1] == 1)
    assert people[1]["Preferred_Location"] == min(p for p, n in places.items() if n == max(places.values()))
    assert people[1]["Frequency"] == len({r[0] for r in data if r[1] == 1})


def test_copies_of_one_key(rows, spark):
    from pyspark.sql import functions as F

    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    first = cleaning.dedup_first(df, "k", [F.col("v").desc()])
    assert first.count() == df.select("k").distinct().count()
    assert first.where("k = 1").first()["v"] == 8997
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def split_rules(found, total, least):
    """Every split of every set, by brute force."""
    out = {}
    for items, n in found.items():
        for size in range(1, len(items)):
            for right in combinations(sorted(items), size):
                left = tuple(sorted(set(items) - set(right)))
                if n >= least * found[left]:
                    out[left, right] = (n / found[left], n / found[left] / (found[right] / total), n / total)
    return out


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_grown_rules_are_all_splits(rows, least):
    held = [set(i for i in range(6) if (o * 7 + i * i) % (i + 2) < 2) for o in range(80)]
    found = {s: n for size in range(1, 7) for s in combinations(range(6), size) if (n := sum(set(s) <= h for h in held))}
    df = rows("items array<long>, freq long", [(list(reversed(s)), n) for s, n in found.items()])
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["confidence"], r["lift"], r["support"]) for r in basket.itemset_rules(df, len(held), least).collect()}
    expected = split_rules(found, len(held), least)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    assert basket.itemset_rules(df.limit(0), 5).collect() == []


def test_a_set_of_forty_items_does_not_explode(rows):
    """Two items may be concluded from the other 39, and each from the 38 without both; nothing else is sure enough to grow."""
    every = list(range(40))
    sets = [(every, 10), *[([i for i in every if i != k], 10 if k in (3, 30) else 1000) for k in every], ([i for i in every if i not in (3, 30)], 12), *[([k], 1000) for k in every], ([3, 30], 500)]
    got = basket.itemset_rules(rows("items array<long>, freq long", sets), 10_000, 0.8).collect()
    assert sorted((len(r["antecedent"]), tuple(r["consequent"])) for r in got) == [(38, (3,)), (38, (3, 30)), (38, (30,)), (39, (3,)), (39, (30,))]


def test_unsound_rows_take_no_part_in_the_first_row_of_a_key(rows):
    from pyspark.sql import functions as F

    data = [(1, 1, False), (1, 2, True), (1, 3, True), (None, 4, False), (None, 5, False), (2, 6, False), (None, 7, True), (None, 8, True)] + [(9, 100 + i, True) for i in range(500)]
    got = cleaning.first_of_sound(rows("k long, n long, ok boolean", data), "k", F.col("ok"), [F.col("n")]).collect()
    assert sorted(r["n"] for r in got) == [1, 2, 4, 5, 6, 7, 100]


def test_lines_are_read_once(spark):
    """Rows and rejections of one pass: every raw row is accepted, rejected or a later copy."""
    from pyspark.sql import functions as F

    raw = spark.createDataFrame(
        [("1", "1", "5", "2", "3.0", "0", 1), ("1", "1", "5", "9", "3.0", "0", 2), ("2", "1", "5", "1.5", "3.0", "0", 1), ("2", "1", "5", "1", "3.0", "0", 3), ("3", "1", "5", "many", "x", "0", 1),
         ("4", "7", "5", "1", "3.0", "0", 1), ("5", "1", "6", "1", "3.0", "9", 1), (None, "1", "5", "1", "3.0", "0", 1), ("6", "1", "5", "1e30", "3.0", "0", 1)],
        "Order_Item_ID string, Order_ID string, Item_ID string, Quantity string, Unit_Price string, Discount_Applied string, place int")
    done = cleaning.clean_lines(raw, spark.createDataFrame([(1,)], "Order_ID long"), spark.createDataFrame([(5,)], "Item_ID long"), [F.col("place")])
    assert sorted((r["Order_Item_ID"], r["Quantity"]) for r in done.rows.collect()) == [(1, 2), (2, 1)]
    assert sorted((str(r["record_identifier"]), r["rule"]) for r in done.rejections.collect()) == [
        ("2", "integer_quantity"), ("3", "finite_Quantity"), ("4", "known_line_references"), ("5", "valid_line_values"), ("6", "valid_line_values"), ("None", "valid_line_values")]
    plan = done.rejections._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Quantity") and plan.count("LogicalRDD") + plan.count("LocalRelation") == 3
