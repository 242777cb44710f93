"""Anomalies, error metrics and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import ordering, windows
from larder.functions.scalar import ratio
from larder.session import materialise


def iqr_outliers(lines: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows above the third quartile plus ``k`` times the interquartile range."""
    found = ordering.quantiles(lines, column, {"q1": 0.25, "q3": 0.75}).first()
    return lines.where(F.col(column) > F.lit(found["q3"] + k * (found["q3"] - found["q1"])))


def sales_anomalies(sales: DataFrame, z: float = 3.0, n: int = 100) -> DataFrame:
    """Location days whose units lie more than ``z`` deviations from the location's mean."""
    daily = sales.groupBy("Date", "Location_ID").agg(F.sum("Quantity").alias("quantity"), F.sum("Net_Revenue").alias("revenue"))
    scored = daily.withColumn("z_score", windows.zscore("quantity", ["Location_ID"]))
    size = F.abs(F.round("z_score", 9))
    return scored.where(size > z).orderBy(size.desc(), "Location_ID", "Date").limit(n)


def unusual_orders(sales: DataFrame, rate: float = 0.5, q: float = 0.999) -> DataFrame:
    """Orders discounted by more than ``rate`` or larger than the ``q`` quantile of units."""
    orders = sales.groupBy("Order_ID").agg(
        F.sum("Net_Revenue").alias("revenue"), F.sum("Discount_Applied").alias("discount"), F.sum("Quantity").alias("quantity")
    )
    orders = materialise(orders)
    cut = ordering.quantile_value(orders, "quantity", q, stored=True)
    share = ratio(F.col("discount"), F.col("revenue") + F.col("discount"))
    return orders.where(F.coalesce(share > rate, F.lit(False)) | (F.col("quantity") > F.lit(cut)))


def rating_bursts(ratings: DataFrame, day: str, z: float = 3.0, min_n: int = 5, sold: DataFrame | None = None, n: int = 100) -> DataFrame:
    """The ``n`` item days with the most unusual number of ratings, measured over the days that have any.

    With ``sold`` lines, only ratings of an item in an order that sold it count.
    """
    if sold is not None:
        ratings = ratings.join(sold.select("Order_ID", "Item_ID").distinct(), ["Order_ID", "Item_ID"], "left_semi")
    daily = ratings.groupBy("Item_ID", F.col(day).alias("Rating_Day")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("Stars").alias("average_stars"),
        F.avg((F.col("Stars") == 5).cast("double")).alias("five_star_rate"),
    )
    scored = daily.withColumn("count_z_score", windows.zscore("count", ["Item_ID"], null_spread_as_one=True))
    flagged = scored.where((F.col("count") >= min_n) & (F.round("count_z_score", 9) > z))
    return flagged.orderBy(F.round("count_z_score", 9).desc(), "Item_ID", "Rating_Day").limit(n)


def errors(df: DataFrame, actual: str, predictions: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Cases, MAE, RMSE and R2 of each named prediction column."""
    y = F.col(actual).cast("double")
    parts = []
    for name, column in predictions.items():
        p = F.col(column).cast("double")
        scored = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(
            F.count(F.lit(1)).alias("cases"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
            (1 - F.sum((y - p) * (y - p)) / F.nullif(F.count(F.lit(1)) * F.var_pop(y), F.lit(0.0))).alias("r2"),
        )
        parts.append(scored.select(*by, F.lit(name).alias("model"), "cases", "mae", "rmse", "r2"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero divisor gives zero."""
    y, p = F.col(label), F.col(predicted)
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return counts.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn, 0.0).alias("accuracy"), ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(tp, tp + fn, 0.0).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
    )


# 0.10, 0.15 ... 0.90.
THRESHOLDS = tuple(0.1 + 0.05 * i for i in range(17))


def threshold_scores(df: DataFrame, label: str, probability: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """F1 per threshold.

    Each row is counted once under the highest threshold it passes; the scores follow from
    running sums over at most one row per threshold.
    """
    steps = F.array(*[F.lit(x) for x in thresholds])
    passed = F.size(F.filter(steps, lambda x: F.col(probability) >= x))
    counted = df.groupBy(passed.alias("step")).agg(F.count_if(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("all"))
    ladder = df.sparkSession.range(1).select(F.posexplode(F.array(F.lit(0.0), *[F.lit(x) for x in thresholds])).alias("step", "threshold"))
    rows = ladder.join(counted, "step", "left").fillna(0, ["pos", "all"])
    above = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp, taken, every = F.sum("pos").over(above), F.sum("all").over(above), F.sum("pos").over(Window.partitionBy())
    scored = rows.select("step", "threshold", ratio(2 * tp, taken + every, 0.0).alias("f1"))
    return scored.where(F.col("step") > 0).drop("step")


def best_threshold(df: DataFrame, label: str, probability: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The threshold with the best F1, the smallest on ties."""
    return threshold_scores(df, label, probability, thresholds).orderBy(F.round("f1", 12).desc(), "threshold").limit(1)


def agreement_cases(aligned: DataFrame, left: str, right: str, tolerance: float = 50.0) -> DataFrame:
    """Difference, both errors and match status of paired predictions."""
    apart = F.abs(F.col(left) - F.col(right))
    near = F.col("Difference") <= tolerance
    return aligned.withColumns(
        {"Difference": apart, "Left_Error": F.abs(F.col(left) - F.col("Actual")), "Right_Error": F.abs(F.col(right) - F.col("Actual"))}
    ).withColumns(
        {
            "Match_Status": F.when(near, "Match").otherwise("Mismatch"),
            "Disagreement_Reason": F.when(near, f"Within fixed {tolerance:g}-unit tolerance").otherwise(f"Predictions differ by more than {tolerance:g} units"),
        }
    )


def agreement(aligned: DataFrame, left: str, right: str, tolerance: float = 50.0) -> DataFrame:
    """Share of cases within the tolerance, mean difference and both mean errors."""
    return agreement_cases(aligned, left, right, tolerance).agg(
        F.count(F.lit(1)).alias("case_count"), F.avg("Left_Error").alias("left_mae"), F.avg("Right_Error").alias("right_mae"),
        F.avg("Difference").alias("average_difference"),
        (100 * F.avg((F.col("Match_Status") == "Match").cast("double"))).alias("agreement_percentage"),
    )


def agreement_median(aligned: DataFrame, left: str, right: str) -> DataFrame:
    """Close match below the median difference."""
    cases = materialise(aligned.withColumn("Numerical_Difference", F.abs(F.col(left) - F.col(right)).cast("double")))
    middle = ordering.quantile_value(cases, "Numerical_Difference", 0.5, stored=True)
    status = F.when(F.col("Numerical_Difference") < F.lit(middle), "Close Match").otherwise("Divergent")
    return cases.withColumn("Match_Status", status)


def agreement_median_summary(cases: DataFrame, left: str, right: str) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("total_compared_records"),
        F.round(100 * F.avg((F.col("Match_Status") == "Close Match").cast("double")), 2).alias("overall_agreement_percentage"),
        F.round(F.avg("Numerical_Difference"), 2).alias("avg_numerical_difference"),
        F.round(F.avg(F.abs(F.col("Actual") - F.col(left))), 2).alias("left_avg_mae_vs_actual"),
        F.round(F.avg(F.abs(F.col("Actual") - F.col(right))), 2).alias("right_avg_mae_vs_actual"),
    )
