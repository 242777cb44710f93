"""Column expressions and window semantics that are easy to get wrong."""

import math
import random
from datetime import date, datetime

from pyspark.sql import functions as F

from larder.functions import calendar, scalar, windows
from larder.operators import cleaning


def one(df):
    return [r[0] for r in df.collect()]


def test_clip_keeps_null(rows):
    df = rows("v double", [(None,), (-1.0,), (2.0,)])
    assert one(df.select(scalar.clip(F.col("v"), 0.0, 1.0))) == [None, 0.0, 1.0]


def test_ratio_guards_zero(rows):
    df = rows("a double, b double", [(1.0, 0.0), (1.0, None), (1.0, 4.0)])
    assert one(df.select(scalar.ratio(F.col("a"), F.col("b")))) == [None, None, 0.25]
    assert one(df.select(scalar.ratio(F.col("a"), F.col("b"), 0.0))) == [0.0, 0.0, 0.25]


def test_finite_and_fractional(rows):
    df = rows("v string", [("1",), ("1.5",), ("Infinity",), ("x",), (None,), ("NaN",)])
    assert one(df.select(scalar.finite(F.col("v")))) == [True, True, False, False, False, False]
    assert one(df.select(scalar.fractional(F.col("v"))))[:2] == [False, True]
    assert one(df.select(scalar.clean_number(F.col("v")))) == [1.0, 1.5, None, None, None, None]


def test_band_is_right_closed(rows):
    df = rows("v double", [(5.0,), (5.1,), (10.0,), (10.1,), (None,)])
    assert one(df.select(scalar.band(F.col("v"), 10.0))) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", None]


def test_rounding_follows_the_binary_value(rows):
    rng = random.Random(1)
    values = [0.20375, 2.675, 1.005, 0.5, 1.5, 2.5, -2.5, 0.125, 0.375, 1e300, -1e17, 5e-324, 0.0, 2.0**52 + 1, 2.0**40 + 0.00012207, float("inf"), None]
    values += [(rng.randrange(-(10**7), 10**7) + 0.5) / 10 ** rng.choice((0, 1, 2, 4, 6)) for _ in range(4000)]
    values += [k / 2000 for k in range(2001)] + [rng.uniform(-1e4, 1e4) for _ in range(1000)] + [math.nextafter(k / 80, rng.choice((-9, 9))) for k in range(800)]
    for digits in (0, 2, 4):
        got = one(rows("v double", [(v,) for v in values]).select(scalar.round_exact(F.col("v"), digits)))
        assert got == [v if v is None or math.isinf(v) else round(v, digits) for v in values]


def test_weekday_starts_monday_and_weeks_are_iso(rows):
    df = rows("d date", [(date(2025, 1, 5),), (date(2025, 1, 6),)])
    built = calendar.calendar_features(df, "d").collect()
    assert [r["day_of_week"] for r in built] == [6, 0]
    assert [r["week_of_year"] for r in built] == [1, 2]
    assert [r["day_name"] for r in built] == ["Sunday", "Monday"]
    assert one(df.select(F.to_date(F.date_trunc("week", "d")))) == [date(2024, 12, 30), date(2025, 1, 6)]


def test_aware_times_move_to_the_restaurant_clock(rows):
    df = rows("v string", [("2025-05-31T19:30:00+00:00",), ("2025-05-31T23:59:00+05:00",)])
    local = calendar.local_time(F.col("v").try_cast("timestamp"))
    assert one(df.select(local)) == [datetime(2025, 6, 1, 0, 30), datetime(2025, 5, 31, 23, 59)]
    assert one(df.select(calendar.day_after(local))) == [datetime(2025, 6, 2), datetime(2025, 6, 1)]


def test_recency_counts_whole_days(rows):
    df = rows("a timestamp_ntz, b timestamp_ntz", [(datetime(2025, 1, 1, 12), datetime(2025, 1, 3, 11)), (datetime(2025, 1, 1, 12), datetime(2025, 1, 3, 12))])
    assert one(df.select(calendar.whole_days(F.col("a"), F.col("b")))) == [1, 2]


def test_prior_mean_needs_every_row(rows):
    df = rows("k int, n int, v double", [(1, i, float(i)) for i in range(1, 10)])
    got = df.select("n", windows.prior_mean("v", "k", "n", 7).alias("m")).orderBy("n").collect()
    assert [r["m"] for r in got] == [None] * 7 + [4.0, 5.0]


def test_zscore_null_and_zero_spread(rows):
    df = rows("k int, v double", [(1, 5.0), (2, 5.0), (2, 5.0)])
    assert sorted(one(df.select(windows.zscore("v", ["k"]).alias("z"))), key=str) == [0.0, 0.0, None]
    assert one(df.select(windows.zscore("v", ["k"], null_spread_as_one=True))) == [0.0, 0.0, 0.0]


def test_null_verdict_is_rejected(rows):
    df = rows("k int, v int", [(1, 5), (2, None), (3, -1)])
    rule = cleaning.Rule("positive", "must be positive", ~(F.col("v") > 0))
    assert one(cleaning.accepted(df, [rule]).select("k")) == [1]
    rejected = cleaning.quarantine(df, "T", "k", [rule]).collect()
    assert [r["record_identifier"] for r in rejected] == ["2", "3"]
    assert rejected[0].asDict() == {"record_identifier": "2", "source_table": "T", "rule": "positive", "reason": "must be positive", "action": "quarantined"}


def test_dedup_follows_the_given_order(rows):
    df = rows("k int, v int", [(1, 3), (1, 1), (2, 2)])
    got = cleaning.dedup_first(df, "k", [F.col("v")]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 2)]
