"""The sample warehouse tables seen as restaurant tables.

The tables given for tests and benches are a TPC-H-like star (orders, lineitem, part, customer,
supplier, nation) and an event log. ``Tables`` maps them onto the restaurant contract with plain
expressions, so that every operator runs over whole tables of any size. ``SQL`` holds the same
mapping as text for the SQL comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.windows import nth_per
from larder.operators import facts
from larder.session import materialise

# Defects planted by expression in the raw text tables (see Tables.raw_orders / raw_lines).
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REASONS = ("Overproduction", "Spoilage", "Preparation Error", "Customer Return", "Expired Ingredients")


def _money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def _days(start: str, n: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), n.cast("int"))


class Tables:
    """Lazily bound tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A reduced table that several parts of one query read: made and stored at the first call."""
        if name not in self._kept:
            self._kept[name] = materialise(build())
        return self._kept[name]

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- dimensions ---------------------------------------------------------------------
    @cached_property
    def menu(self) -> DataFrame:
        return self.source("part").select(
            F.col("p_partkey").alias("Item_ID"),
            F.col("p_name").alias("Item_Name"),
            F.substring("p_brand", 7, 9).cast("long").alias("Category_ID"),
            _money("p_retailprice").alias("Base_Price"),
            _money("p_retailprice").alias("Cost"),
            _days("1995-01-01", F.col("p_size") * 48).alias("Introduced_Date"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return (
            self.source("part")
            .select(F.substring("p_brand", 7, 9).cast("long").alias("Category_ID"), F.col("p_brand").alias("Category_Name"))
            .distinct()
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.source("customer").select(
            F.col("c_custkey").alias("Customer_ID"),
            F.col("c_name").alias("Customer_Name"),
            F.col("c_mktsegment").alias("City"),
            _days("1995-01-01", F.col("c_custkey") % 700).alias("Signup_Date"),
        )

    @cached_property
    def locations(self) -> DataFrame:
        regions = self.source("region")
        return (
            self.source("nation")
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").cast("long").alias("Location_ID"),
                F.col("n_name").alias("Location_Name"),
                F.col("r_name").alias("City"),
                _days("1995-01-01", F.col("n_nationkey") * 20).alias("Opening_Date"),
            )
        )

    @cached_property
    def promotions(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        kind = n % 4
        return self.source("nation").select(
            (n + 1).alias("Promotion_ID"),
            F.concat(F.lit("Campaign "), (n + 1).cast("string")).alias("Promotion_Name"),
            (n % 20 + 5).alias("Discount_Percent"),
            _days("1996-01-01", n * 60).alias("Start_Date"),
            _days("1996-01-20", n * 61).alias("End_Date"),
            F.when(kind == 0, n * 7 + 1).alias("Applicable_Item_ID"),
            F.when(kind == 1, n + 1).when(kind == 3, n).alias("Applicable_Category_ID"),
            F.when(kind == 3, n).alias("Location_ID"),
        )

    # -- facts ----------------------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
        slot = F.floor(F.date_diff(F.to_date(day), F.lit("1996-01-01").cast("date")) / 60)
        home = self.source("customer").select("c_custkey", "c_nationkey")
        return (
            self.source("orders")
            .join(home, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("Order_ID"),
                cust.alias("Customer_ID"),
                F.col("c_nationkey").cast("long").alias("Location_ID"),
                (day + F.make_dt_interval(hours=((key * 7 + cust) % 24).cast("int"))).alias("Order_DateTime"),
                F.col("o_orderpriority").alias("Channel"),
                F.when((key % 2 == 0) & slot.between(0, 24), slot + 1).cast("long").alias("Promotion_ID"),
                F.when(F.col("o_orderstatus") == "P", "Cancelled").otherwise("Completed").alias("Order_Status"),
            )
        )

    @cached_property
    def raw_lineitem(self) -> DataFrame:
        """Line items as they come: several lines may carry the same Order_Item_ID, none the same Line_ID.

        Order, line number, part, supplier and quantity together identify a line. The last three enter by
        their low bits, which tell apart the few lines that share the first two and leave room for 2^34 orders.
        """
        price, qty = _money("l_extendedprice"), F.col("l_quantity").cast("decimal(10,0)")
        return self.source("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("Order_Item_ID"),
            ((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + F.col("l_partkey") % 4096) * 256 + F.col("l_suppkey") % 256) * 64 + F.col("l_quantity").cast("long") % 64).alias("Line_ID"),
            F.col("l_orderkey").alias("Order_ID"),
            F.col("l_partkey").alias("Item_ID"),
            F.col("l_quantity").cast("long").alias("Quantity"),
            _money(F.round(price / qty, 2)).alias("Unit_Price"),
            _money(F.round(price * F.col("l_discount").cast("decimal(4,2)"), 2)).alias("Discount_Applied"),
            F.to_date("l_shipdate").alias("Ship_Date"),
            F.col("l_suppkey").alias("Supplier_ID"),
            F.col("l_linenumber").alias("Line_Number"),
            _money("l_extendedprice").alias("Extended"),
            F.col("l_returnflag").alias("Return_Flag"),
            F.round(F.col("l_tax") * 100).cast("long").alias("Tax_Percent"),
        )

    @staticmethod
    def line_order() -> list[Column]:
        return [F.col(c) for c in ("Ship_Date", "Item_ID", "Supplier_ID", "Quantity", "Extended", "Tax_Percent")]

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw_lineitem.select(
            F.col("Line_ID").alias("Order_Item_ID"), "Order_ID", "Item_ID", "Quantity", "Unit_Price", "Discount_Applied"
        )

    @cached_property
    def sales(self) -> DataFrame:
        return facts.build_sales(self.lines, self.orders, self.menu)

    @cached_property
    def prices(self) -> DataFrame:
        """The first unit price an item was shipped at in each year."""
        year = F.year("Ship_Date")
        firsts = nth_per(
            self.raw_lineitem.withColumn("Year", year),
            ["Item_ID", "Year"],
            [F.col(c) for c in ("Ship_Date", "Order_Item_ID", "Unit_Price", "Supplier_ID")],
        )
        return firsts.select(
            (F.col("Item_ID") * 10000 + F.col("Year")).alias("Pricing_ID"),
            "Item_ID",
            F.col("Unit_Price").alias("Price"),
            F.col("Ship_Date").alias("Effective_Date"),
        )

    @cached_property
    def _site(self) -> DataFrame:
        return self.source("supplier").select(
            F.col("s_suppkey").alias("Supplier_ID"), F.col("s_nationkey").cast("long").alias("Location_ID")
        )

    @cached_property
    def wastage(self) -> DataFrame:
        """Returned lines: sampled days, so an absent record is unknown rather than zero."""
        wasted = F.floor(F.col("Quantity") / 10).cast("long") + F.when(F.col("Quantity") > 1, 1).otherwise(0)
        cost = self.menu.select("Item_ID", "Cost")
        returned = self.raw_lineitem.where(F.col("Return_Flag") == "R")
        return (
            returned.join(self._site, "Supplier_ID")
            .join(cost, "Item_ID")
            .select(
                F.col("Line_ID").alias("Wastage_ID"),
                "Item_ID",
                "Location_ID",
                F.col("Ship_Date").alias("Wastage_Date"),
                wasted.alias("Quantity_Wasted"),
                _money(wasted * F.col("Cost")).alias("Cost_Impact"),
                F.element_at(F.array(*map(F.lit, REASONS)), (F.col("Line_Number") % 5 + 1).cast("int")).alias("Reason"),
                (F.col("Quantity") - wasted).alias("Demand_Quantity"),
                F.col("Quantity").alias("Prepared_Quantity"),
                (F.col("Quantity") - wasted).alias("Quantity_Consumed"),
            )
        )

    @cached_property
    def raw_ratings(self) -> DataFrame:
        """Feedback on accepted lines; one star value in six (the 6) is invalid."""
        accepted = self.raw_lineitem.where(F.col("Return_Flag") == "A")
        who = self.orders.select("Order_ID", "Customer_ID")
        return accepted.join(who, "Order_ID").select(
            F.col("Line_ID").alias("Rating_ID"),
            "Order_ID",
            "Item_ID",
            "Customer_ID",
            ((F.col("Quantity") + F.col("Item_ID")) % 6 + 1).alias("Stars"),
            F.col("Ship_Date").alias("Rating_Date"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        done = self.orders.where(F.col("Order_Status") == "Completed").select("Order_ID")
        return self.raw_ratings.where(F.col("Stars").between(1, 5)).join(done, "Order_ID", "left_semi")

    @cached_property
    def event_ratings(self) -> DataFrame:
        """Feedback from the event log, dense enough for bursts within a day."""
        return self.source("events").select(
            F.col("event_id").alias("Rating_ID"),
            F.col("user_id").alias("Item_ID"),
            F.to_date("ts").alias("Rating_Day"),
            (F.floor(F.col("value") / 50) + 1).cast("long").alias("Stars"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """One stock period per shipped line at the supplier's site; 1 % of ledgers do not balance."""
        return self.raw_lineitem.join(self._site, "Supplier_ID").select(
            F.col("Line_ID").alias("Inventory_ID"),
            "Location_ID",
            "Item_ID",
            (F.col("Quantity") + F.when(F.col("Tax_Percent") == 8, 1).otherwise(0)).alias("Stock_Quantity"),
            (F.col("Line_Number") * 3).cast("long").alias("Reorder_Level"),
            F.col("Quantity").alias("Opening_Stock"),
            F.col("Line_Number").cast("long").alias("Received_Quantity"),
            F.col("Line_Number").cast("long").alias("Consumed_Quantity"),
            F.lit(0).cast("long").alias("Wasted_Quantity"),
            F.col("Ship_Date").alias("Period_End"),
            F.col("Extended"),
        )

    # -- raw text with planted defects ---------------------------------------------------
    @cached_property
    def raw_orders(self) -> DataFrame:
        key = F.col("Order_ID")
        stamp = F.concat(F.translate(F.col("Order_DateTime").cast("string"), " ", "T"), F.lit("+05:00"))
        return self.orders.select(
            key.cast("string").alias("Order_ID"),
            F.when(key % 79 == 1, None).when(key % 79 == 2, "99999999").otherwise(F.col("Customer_ID").cast("string")).alias("Customer_ID"),
            F.col("Location_ID").cast("string").alias("Location_ID"),
            F.when(key % 83 == 2, None).when(key % 83 == 3, "2025-99-99").otherwise(stamp).alias("Order_DateTime"),
            F.when(key % 89 == 4, "Unknown channel").otherwise(F.col("Channel")).alias("Channel"),
            F.col("Promotion_ID").cast("string").alias("Promotion_ID"),
            F.when(key % 71 == 5, "Open").otherwise(F.col("Order_Status")).alias("Order_Status"),
        )

    @cached_property
    def raw_lines(self) -> DataFrame:
        key = F.col("Order_ID")
        qty, price, off = key % 97, key % 101, key % 103
        return self.raw_lineitem.select(
            F.col("Order_Item_ID").cast("string").alias("Order_Item_ID"),
            F.when(key % 109 == 7, "88888888").otherwise(key.cast("string")).alias("Order_ID"),
            F.when(key % 107 == 9, "99999999").otherwise(F.col("Item_ID").cast("string")).alias("Item_ID"),
            F.when(qty == 5, "1.5").when(qty == 6, "many").when(qty == 7, "-3").when(qty == 8, None)
            .otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
            F.when(price == 3, "Infinity").when(price == 4, "10.001").when(price == 5, "0.00")
            .otherwise(F.col("Unit_Price").cast("string")).alias("Unit_Price"),
            F.when(off == 2, "-1.00").when(off == 3, "999999999.00")
            .otherwise(F.col("Discount_Applied").cast("string")).alias("Discount_Applied"),
            "Ship_Date", "Supplier_ID", "Extended", "Tax_Percent",
        )

    @cached_property
    def raw_wastage(self) -> DataFrame:
        key = F.col("Wastage_ID")
        return self.wastage.select(
            key.alias("Wastage_ID"),
            F.when(key % 61 == 3, 99999999).otherwise(F.col("Item_ID")).alias("Item_ID"),
            F.when(key % 67 == 3, 999).otherwise(F.col("Location_ID")).alias("Location_ID"),
            F.when(key % 59 == 3, None).otherwise(F.col("Wastage_Date")).alias("Wastage_Date"),
            F.when(key % 53 == 3, -1).otherwise(F.col("Quantity_Wasted")).alias("Quantity_Wasted"),
            "Cost_Impact", "Reason", "Demand_Quantity", "Prepared_Quantity",
            F.when(key % 47 == 3, F.col("Prepared_Quantity") + 1).otherwise(F.col("Quantity_Consumed")).alias("Quantity_Consumed"),
        )

    @cached_property
    def raw_menu(self) -> DataFrame:
        key = F.col("Item_ID")
        return self.menu.select(
            "Item_ID", "Item_Name", "Category_ID",
            F.when(key % 31 == 2, -1).otherwise(F.col("Base_Price")).cast("decimal(18,2)").alias("Base_Price"),
            F.when(key % 37 == 2, -1).otherwise(F.col("Cost")).cast("decimal(18,2)").alias("Cost"),
            "Introduced_Date",
        )

    @cached_property
    def raw_prices(self) -> DataFrame:
        return self.prices.withColumn(
            "Price", F.when(F.col("Item_ID") % 41 == 2, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("Price"))
        )


SQL = {
    "menu": """SELECT p_partkey AS Item_ID, p_name AS Item_Name, CAST(substr(p_brand, 7) AS BIGINT) AS Category_ID,
        CAST(p_retailprice AS DECIMAL(18,2)) AS Base_Price, CAST(p_retailprice AS DECIMAL(18,2)) AS Cost,
        DATE '1995-01-01' + p_size * 48 AS Introduced_Date FROM part""",
    "categories": "SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS Category_ID, p_brand AS Category_Name FROM part",
    "customers": """SELECT c_custkey AS Customer_ID, c_name AS Customer_Name, c_mktsegment AS City,
        DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) AS Signup_Date FROM customer""",
    "locations": """SELECT CAST(n_nationkey AS BIGINT) AS Location_ID, n_name AS Location_Name, r_name AS City,
        DATE '1995-01-01' + n_nationkey * 20 AS Opening_Date FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "promotions": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS Promotion_ID, 'Campaign ' || (n_nationkey + 1) AS Promotion_Name,
        CAST(n_nationkey % 20 + 5 AS BIGINT) AS Discount_Percent, DATE '1996-01-01' + n_nationkey * 60 AS Start_Date,
        DATE '1996-01-20' + n_nationkey * 61 AS End_Date,
        CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey * 7 + 1 AS BIGINT) END AS Applicable_Item_ID,
        CAST(CASE WHEN n_nationkey % 4 = 1 THEN n_nationkey + 1 WHEN n_nationkey % 4 = 3 THEN n_nationkey END AS BIGINT)
            AS Applicable_Category_ID,
        CAST(CASE WHEN n_nationkey % 4 = 3 THEN n_nationkey END AS BIGINT) AS Location_ID FROM nation""",
    "clean_orders": """SELECT o_orderkey AS Order_ID, o_custkey AS Customer_ID, CAST(c_nationkey AS BIGINT) AS Location_ID,
        o_orderdate + to_hours(CAST((o_orderkey * 7 + o_custkey) % 24 AS INTEGER)) AS Order_DateTime,
        o_orderpriority AS Channel,
        CAST(CASE WHEN o_orderkey % 2 = 0 AND o_orderdate >= DATE '1996-01-01'
              AND date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) // 60 <= 24
             THEN date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) // 60 + 1 END AS BIGINT) AS Promotion_ID,
        CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' ELSE 'Completed' END AS Order_Status
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_lineitem": """SELECT l_orderkey * 8 + l_linenumber AS Order_Item_ID,
        (((l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096) * 256 + l_suppkey % 256) * 64 + CAST(l_quantity AS BIGINT) % 64 AS Line_ID, l_orderkey AS Order_ID, l_partkey AS Item_ID,
        CAST(l_quantity AS BIGINT) AS Quantity,
        CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
             // (2 * CAST(l_quantity AS BIGINT)) / 100.0 AS DECIMAL(18,2)) AS Unit_Price,
        CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))
             AS Discount_Applied,
        CAST(l_shipdate AS DATE) AS Ship_Date, l_suppkey AS Supplier_ID, l_linenumber AS Line_Number,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS Extended, l_returnflag AS Return_Flag,
        CAST(round(l_tax * 100) AS BIGINT) AS Tax_Percent FROM lineitem""",
    "lines": "SELECT Line_ID AS Order_Item_ID, Order_ID, Item_ID, Quantity, Unit_Price, Discount_Applied FROM raw_lineitem",
    "first_lines_raw": """SELECT Order_Item_ID, Order_ID, Item_ID, Quantity, Unit_Price, Discount_Applied FROM raw_lineitem
        QUALIFY row_number() OVER (PARTITION BY Order_Item_ID
            ORDER BY Ship_Date, Item_ID, Supplier_ID, Quantity, Extended, Tax_Percent) = 1""",
    "sales": """SELECT l.*, o.Customer_ID, o.Location_ID, o.Order_DateTime, o.Channel, o.Promotion_ID,
        CAST(o.Order_DateTime AS DATE) AS Date, m.Item_Name, m.Category_ID, m.Cost,
        CAST(l.Quantity * l.Unit_Price - l.Discount_Applied AS DECIMAL(18,2)) AS Net_Revenue,
        CAST(l.Quantity * m.Cost AS DECIMAL(18,2)) AS Cost_Total,
        CAST(l.Quantity * l.Unit_Price - l.Discount_Applied - l.Quantity * m.Cost AS DECIMAL(18,2)) AS Contribution
        FROM lines l JOIN clean_orders o ON l.Order_ID = o.Order_ID AND o.Order_Status = 'Completed'
        JOIN menu m ON l.Item_ID = m.Item_ID""",
    "prices": """SELECT Item_ID * 10000 + year(Ship_Date) AS Pricing_ID, Item_ID, Unit_Price AS Price, Ship_Date AS Effective_Date
        FROM raw_lineitem QUALIFY row_number() OVER (PARTITION BY Item_ID, year(Ship_Date)
            ORDER BY Ship_Date, Order_Item_ID, Unit_Price, Supplier_ID) = 1""",
    "site": "SELECT s_suppkey AS Supplier_ID, CAST(s_nationkey AS BIGINT) AS Location_ID FROM supplier",
    "wastage": """SELECT Line_ID AS Wastage_ID, w.Item_ID, Location_ID, Ship_Date AS Wastage_Date, Wasted AS Quantity_Wasted,
        CAST(Wasted * Cost AS DECIMAL(18,2)) AS Cost_Impact,
        ['Overproduction', 'Spoilage', 'Preparation Error', 'Customer Return', 'Expired Ingredients'][Line_Number % 5 + 1] AS Reason,
        Quantity - Wasted AS Demand_Quantity, Quantity AS Prepared_Quantity, Quantity - Wasted AS Quantity_Consumed
        FROM (SELECT *, Quantity // 10 + CASE WHEN Quantity > 1 THEN 1 ELSE 0 END AS Wasted FROM raw_lineitem
              WHERE Return_Flag = 'R') w
        JOIN site ON w.Supplier_ID = site.Supplier_ID JOIN menu ON w.Item_ID = menu.Item_ID""",
    "raw_ratings": """SELECT Line_ID AS Rating_ID, r.Order_ID, Item_ID, Customer_ID, (Quantity + Item_ID) % 6 + 1 AS Stars,
        Ship_Date AS Rating_Date
        FROM (SELECT * FROM raw_lineitem WHERE Return_Flag = 'A') r
        JOIN clean_orders o ON r.Order_ID = o.Order_ID""",
    "ratings": """SELECT * FROM raw_ratings WHERE Stars BETWEEN 1 AND 5
        AND Order_ID IN (SELECT Order_ID FROM clean_orders WHERE Order_Status = 'Completed')""",
    "event_ratings": """SELECT event_id AS Rating_ID, user_id AS Item_ID, CAST(ts AS DATE) AS Rating_Day,
        CAST(floor(value / 50) + 1 AS BIGINT) AS Stars FROM events""",
    "inventory": """SELECT Line_ID AS Inventory_ID, Location_ID, Item_ID,
        Quantity + CASE WHEN Tax_Percent = 8 THEN 1 ELSE 0 END AS Stock_Quantity, CAST(Line_Number * 3 AS BIGINT) AS Reorder_Level,
        Quantity AS Opening_Stock, CAST(Line_Number AS BIGINT) AS Received_Quantity, CAST(Line_Number AS BIGINT) AS Consumed_Quantity,
        0 AS Wasted_Quantity, Ship_Date AS Period_End, Extended
        FROM raw_lineitem r JOIN site ON r.Supplier_ID = site.Supplier_ID""",
    "raw_orders": """SELECT CAST(Order_ID AS VARCHAR) AS Order_ID,
        CASE WHEN Order_ID % 79 = 1 THEN NULL WHEN Order_ID % 79 = 2 THEN '99999999' ELSE CAST(Customer_ID AS VARCHAR) END AS Customer_ID,
        CAST(Location_ID AS VARCHAR) AS Location_ID,
        CASE WHEN Order_ID % 83 = 2 THEN NULL WHEN Order_ID % 83 = 3 THEN '2025-99-99'
             ELSE strftime(Order_DateTime, '%Y-%m-%dT%H:%M:%S') || '+05:00' END AS Order_DateTime,
        CASE WHEN Order_ID % 89 = 4 THEN 'Unknown channel' ELSE Channel END AS Channel,
        CAST(Promotion_ID AS VARCHAR) AS Promotion_ID,
        CASE WHEN Order_ID % 71 = 5 THEN 'Open' ELSE Order_Status END AS Order_Status FROM clean_orders""",
    "raw_lines": """SELECT CAST(Order_Item_ID AS VARCHAR) AS Order_Item_ID,
        CASE WHEN Order_ID % 109 = 7 THEN '88888888' ELSE CAST(Order_ID AS VARCHAR) END AS Order_ID,
        CASE WHEN Order_ID % 107 = 9 THEN '99999999' ELSE CAST(Item_ID AS VARCHAR) END AS Item_ID,
        CASE Order_ID % 97 WHEN 5 THEN '1.5' WHEN 6 THEN 'many' WHEN 7 THEN '-3' WHEN 8 THEN NULL ELSE CAST(Quantity AS VARCHAR) END AS Quantity,
        CASE Order_ID % 101 WHEN 3 THEN 'Infinity' WHEN 4 THEN '10.001' WHEN 5 THEN '0.00' ELSE CAST(Unit_Price AS VARCHAR) END AS Unit_Price,
        CASE Order_ID % 103 WHEN 2 THEN '-1.00' WHEN 3 THEN '999999999.00' ELSE CAST(Discount_Applied AS VARCHAR) END AS Discount_Applied,
        Ship_Date, Supplier_ID, Extended, Tax_Percent FROM raw_lineitem""",
    "raw_wastage": """SELECT Wastage_ID, CASE WHEN Wastage_ID % 61 = 3 THEN 99999999 ELSE Item_ID END AS Item_ID,
        CASE WHEN Wastage_ID % 67 = 3 THEN 999 ELSE Location_ID END AS Location_ID,
        CASE WHEN Wastage_ID % 59 = 3 THEN NULL ELSE Wastage_Date END AS Wastage_Date,
        CASE WHEN Wastage_ID % 53 = 3 THEN -1 ELSE Quantity_Wasted END AS Quantity_Wasted,
        Cost_Impact, Reason, Demand_Quantity, Prepared_Quantity,
        CASE WHEN Wastage_ID % 47 = 3 THEN Prepared_Quantity + 1 ELSE Quantity_Consumed END AS Quantity_Consumed FROM wastage""",
    "raw_menu": """SELECT Item_ID, Item_Name, Category_ID, CASE WHEN Item_ID % 31 = 2 THEN -1 ELSE Base_Price END AS Base_Price,
        CASE WHEN Item_ID % 37 = 2 THEN -1 ELSE Cost END AS Cost, Introduced_Date FROM menu""",
    "raw_prices": """SELECT Pricing_ID, Item_ID, CASE WHEN Item_ID % 41 = 2 THEN 0 ELSE Price END AS Price, Effective_Date FROM prices""",
}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """The comparison SQL: the named bound tables it mentions, then the statement itself."""
    known = {**SQL, **(extra or {})}
    needed: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(known[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    if not needed:
        return body
    named = "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed)
    rest = body.lstrip()
    return f"{named},\n{rest[5:]}" if rest.startswith("WITH ") else f"{named}\n{rest}"
