"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is run to its last row
without bringing rows to the driver. Two entries follow the published baseline run: the star join
with its check and seven reports, over the tables as given and over a key-preserving replica of
about five million lines.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time
from functools import cached_property

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder.binding import CHANNELS, Tables  # noqa: E402
from larder.operators import rollup  # noqa: E402
from larder.operators.filters import Filters  # noqa: E402
from larder.plans import catalogue, sales_queries  # noqa: E402
from larder.plans.star_reports import star_check, star_fact, star_reports  # noqa: E402
from larder.session import local_session, scratch_path  # noqa: E402
from larder.sources.raw import replicate  # noqa: E402

HEADLINE = (
    "agg_menu_profit", "agg_peaks", "agg_executive", "agg_rfm", "jn_integrated", "jn_asof_price", "cln_line_values", "dq_profile",
    "src_typed_csv", "rule_menu_class", "rule_slow_moving", "rule_price_windows", "rule_promo_windows", "rule_churn", "bsk_rules",
    "stat_sales_anomaly", "stat_quantile", "fc_features", "ml_wastage_sparse", "rule_what_if", "jn_basket_pairs", "dq_quality_report",
    "rule_recommendations", "rpt_sections", "fc_location_rf", "ml_rfm_kmeans",
)
REPLICA_LINES = 5_000_000


class Replica(Tables):
    """The same tables with orders and lines repeated under new keys."""

    def __init__(self, spark, folder, copies: int):
        super().__init__(spark, folder)
        self.copies = copies

    def _repeat(self, df, name, strides):
        path = scratch_path(self.spark, name)
        replicate(df, self.copies, strides).write.parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def orders(self):
        return self._repeat(Tables(self.spark, self.folder).orders, "orders", {"Order_ID": 10**9})

    @cached_property
    def lines(self):
        return self._repeat(Tables(self.spark, self.folder).lines, "lines", {"Order_Item_ID": 10**17, "Order_ID": 10**9})


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    begun = time.perf_counter()
    work()
    return round(time.perf_counter() - begun, 3)


def star_run(tables: Tables) -> None:
    star = star_fact(tables)
    star_check(tables, star).collect()
    for report in star_reports(star).values():
        drain(report)


def rollup_run(tables: Tables) -> dict[str, float]:
    """Writing the cells once, then filtered reports from them; the first call warms the files."""
    made: list = []
    seconds = {"rollup_build": timed(lambda: made.append(sales_queries.rolled_up(tables)))}
    menu = Filters(channel="5-LOW", channels=CHANNELS)
    for name, report in (("executive_from_rollup_warm", lambda: rollup.executive(made[0], sales_queries.SCOPE)), ("menu_from_rollup_warm", lambda: rollup.item_totals(made[0], menu))):
        drain(report())
        seconds[name] = timed(lambda report=report: drain(report()))
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    for name in HEADLINE[:2]:  # warm the JVM
        drain(catalogue.run(spark, folder, name))
    seconds = {name: timed(lambda name=name: drain(catalogue.run(spark, folder, name))) for name in HEADLINE}
    seconds["star_join_check_and_7_reports"] = timed(lambda: star_run(Tables(spark, folder)))
    seconds |= rollup_run(Tables(spark, folder))
    lines = Tables(spark, folder).lines.count()
    replica = Replica(spark, folder, math.ceil(REPLICA_LINES / lines))
    seconds["replica_generation"] = timed(lambda: (replica.orders, replica.lines))
    seconds["replica_star_join_check_and_7_reports"] = timed(lambda: star_run(replica))
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "lines": lines, "replica_lines": lines * replica.copies,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
