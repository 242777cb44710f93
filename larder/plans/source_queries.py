"""Sources, sinks, cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.binding import CHANNELS, Tables
from larder.functions.scalar import finite, fractional, known
from larder.operators import cleaning, facts, quality
from larder.plans.registry import query
from larder.plans.sales_queries import STAR, star
from larder.session import materialise, scratch_path
from larder.sources import contract, raw, sinks, snapshot

LINE_FIELDS = ["Order_Item_ID", "Order_ID", "Item_ID", "Quantity", "Unit_Price", "Discount_Applied"]


def positive_lines(t: Tables):
    """Lines with all ids above zero, as the contract requires."""
    return t.lines.select(
        (F.col("Order_Item_ID") + 9).alias("Order_Item_ID"), (F.col("Order_ID") + 1).alias("Order_ID"),
        (F.col("Item_ID") + 1).alias("Item_ID"), "Quantity", "Unit_Price", "Discount_Applied",
    )


def csv_folder(t: Tables, df, name: str) -> str:
    path = scratch_path(t.spark, name)
    df.write.option("header", True).csv(path)
    return path


POSITIVE = """SELECT Order_Item_ID + 9 AS Order_Item_ID, Order_ID + 1 AS Order_ID, Item_ID + 1 AS Item_ID, Quantity,
    CAST(Unit_Price AS DOUBLE) AS Unit_Price, CAST(Discount_Applied AS DOUBLE) AS Discount_Applied FROM lines"""


@query("src_typed_csv", POSITIVE)
def src_typed_csv(t):
    return raw.load_table(t.spark, "Order_Items", [csv_folder(t, positive_lines(t), "typed")])


@query("src_multifile", POSITIVE)
def src_multifile(t):
    lines = positive_lines(t)
    low = csv_folder(t, lines.where(F.col("Quantity") < 25), "low")
    high = csv_folder(t, lines.where(F.col("Quantity") >= 25), "high")
    return raw.load_table(t.spark, "Order_Items", [low, high])


@query("src_record_shape", """SELECT count(*) FILTER (Quantity = 13) AS malformed, count(*) AS records FROM lines""")
def src_record_shape(t):
    path = scratch_path(t.spark, "shape")
    fields = [F.col(c).cast("string") for c in LINE_FIELDS]
    short = F.col("Quantity") == 13
    t.lines.select(F.when(short, F.concat_ws(",", *fields[:4])).otherwise(F.concat_ws(",", *fields)).alias("value")).write.text(path)
    return raw.shape_counts(raw.read_text(t.spark, LINE_FIELDS, [path], header=False))


@query("src_infer_csv", "SELECT CAST(Location_ID AS INTEGER) AS Location_ID, Location_Name, City, CAST(Opening_Date AS VARCHAR) AS Opening_Date FROM locations")
def src_infer_csv(t):
    return raw.read_inferred(t.spark, csv_folder(t, t.locations, "infer"))


@query("src_legacy_convert", "SELECT Pricing_ID, CAST(Item_ID AS INTEGER) AS Item_ID, CAST(Price AS DOUBLE) AS Price, CAST(Effective_Date AS VARCHAR) AS Effective_Date FROM prices")
def src_legacy_convert(t):
    done = raw.csv_to_parquet(t.spark, csv_folder(t, t.prices, "legacy"), scratch_path(t.spark, "converted"))
    return done.withColumn("Pricing_ID", F.col("Pricing_ID").cast("long"))


#: Every clean view with a column of numbers to add up.
VIEW_SUMS = {
    "clean_orders": "Order_ID", "clean_customers": "Customer_ID", "clean_lines": "Quantity", "clean_menu": "Base_Price", "clean_categories": "Category_ID",
    "clean_locations": "Location_ID", "clean_promotions": "Discount_Percent", "clean_prices": "Price", "clean_ratings": "Stars", "clean_inventory": "Stock_Quantity",
    "clean_wastage": "Cost_Impact", "authoritative_sales": "Net_Revenue",
}
BOUND = {"clean_orders": "clean_orders", "authoritative_sales": "sales", **{f"clean_{n}": n for n in ("customers", "lines", "menu", "categories", "locations", "promotions", "prices", "ratings", "inventory", "wastage")}}


def clean_snapshot(t: Tables) -> str:
    """All clean tables and their manifest, written under the names of the contract."""
    frames = {
        "clean_orders": t.orders, "clean_customers": t.customers, "clean_lines": t.lines, "clean_menu": t.menu, "clean_categories": t.categories, "clean_locations": t.locations,
        "clean_promotions": t.promotions, "clean_prices": t.prices, "clean_ratings": t.ratings, "clean_inventory": t.inventory, "clean_wastage": t.wastage, "authoritative_sales": t.sales,
    }
    folder = scratch_path(t.spark, "snapshot")
    snapshot.write_clean({contract.CLEAN_TABLES[view]: df for view, df in frames.items()}, folder)
    snapshot.write_manifest(t.spark, folder, list(contract.CLEAN_TABLES.values()))
    return folder


def view_totals(select: str) -> str:
    return " UNION ALL ".join(select.format(view=view, table=BOUND[view], column=column) for view, column in VIEW_SUMS.items())


@query("src_parquet_views", f"""SELECT v.*, l.units FROM ({view_totals("SELECT '{view}' AS view, count(*) AS rows, CAST(sum({column}) AS DOUBLE) AS total FROM {table}")}) v,
    (SELECT CAST(sum(l.Quantity) AS BIGINT) AS units FROM clean_orders o JOIN lines l USING (Order_ID) JOIN menu USING (Item_ID) JOIN categories USING (Category_ID) JOIN customers USING (Customer_ID) JOIN locations USING (Location_ID)) l""")
def src_parquet_views(t):
    bound = snapshot.bind(t.spark, clean_snapshot(t))
    joined = """SELECT sum(l.Quantity) AS units FROM clean_orders o JOIN clean_lines l USING (Order_ID) JOIN clean_menu USING (Item_ID) JOIN clean_categories USING (Category_ID)
        JOIN clean_customers USING (Customer_ID) JOIN clean_locations ON o.Location_ID = clean_locations.Location_ID"""
    totals = t.spark.sql(view_totals("SELECT '{view}' AS view, CAST(sum({column}) AS DOUBLE) AS total FROM {view}"))
    return bound.select("view", "rows").join(totals, "view").withColumn("units", t.spark.sql(joined).scalar())


@query("src_table_shape", """SELECT 'orders' AS table_name, count(*) AS rows, 7 AS columns FROM clean_orders UNION ALL
    SELECT 'lines', count(*), 6 FROM lines UNION ALL SELECT 'menu', count(*), 6 FROM menu UNION ALL SELECT 'wastage', count(*), 10 FROM wastage""")
def src_table_shape(t):
    return raw.table_shapes({"orders": t.orders, "lines": t.lines, "menu": t.menu, "wastage": t.wastage})


WHOLE, CENTS = "'^[+-]?[0-9]+$'", "'^[+-]?[0-9]+([.][0-9]{1,2})?$'"


@query("src_type_violations", "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NOT NULL AND NOT regexp_matches({c}, {CENTS if c in ('Unit_Price', 'Discount_Applied') else WHOLE})) AS {c}" for c in LINE_FIELDS
) + " FROM raw_lines")
def src_type_violations(t):
    return raw.type_violations(t.raw_lines, contract.schema("Order_Items"))


@query("src_required_enum", """SELECT count(*) FILTER (Order_ID IS NULL OR Order_ID <= 0) AS Order_ID, count(*) FILTER (TRY_CAST(Customer_ID AS BIGINT) IS NULL OR TRY_CAST(Customer_ID AS BIGINT) <= 0) AS Customer_ID,
    count(*) FILTER (Channel IS NULL OR Channel = 'Unknown channel') AS enum_Channel, count(*) FILTER (Order_Status NOT IN ('Completed', 'Cancelled')) AS enum_Order_Status
    FROM (SELECT * REPLACE (CAST(Order_ID AS BIGINT) AS Order_ID) FROM raw_orders)""")
def src_required_enum(t):
    typed = t.raw_orders.withColumns({c: F.col(c).try_cast("long") for c in ("Order_ID", "Customer_ID")})
    return raw.contract_violations(typed, ["Order_ID", "Customer_ID"], {"Channel": CHANNELS, "Order_Status": contract.STATUSES})


@query("src_snapshot_manifest", """SELECT 'order_items_validated' AS table_name, 'same' AS verdict, (SELECT count(*) FROM lines) AS rows, 1 AS folders UNION ALL SELECT 'menu_items_validated', 'same', (SELECT count(*) FROM menu), 1
    UNION ALL SELECT 'sales_validated', 'same', (SELECT count(*) FROM sales), (SELECT count(DISTINCT Location_ID) FROM sales)""")
def src_snapshot_manifest(t):
    folder = scratch_path(t.spark, "snapshot")
    flat = {"order_items_validated": t.lines, "menu_items_validated": t.menu}
    names = [*flat, "sales_validated"]
    snapshot.write_clean(flat, folder)
    snapshot.write_partitioned(t.sales, f"{folder}/sales_validated")
    snapshot.write_manifest(t.spark, folder, names)
    snapshot.verify_manifest(t.spark, folder, names)
    rows = t.spark.read.json(f"{folder}/manifest").groupBy("table_name").agg(F.max("rows").alias("rows"))
    place = F.regexp_extract("file", "^(.*/)?", 1)
    verdicts = snapshot.manifest_differences(t.spark, folder, names).groupBy("table_name", "verdict").agg(F.count_distinct(place).alias("folders"))
    return verdicts.join(rows, "table_name")


#: Fields and types of the summarised tables.
SUMMARY_FIELDS = {
    "orders": "Order_ID:long,Customer_ID:long,Location_ID:long,Order_DateTime:timestamp_ntz,Channel:string,Promotion_ID:long,Order_Status:string",
    "lines": "Order_Item_ID:long,Order_ID:long,Item_ID:long,Quantity:long,Unit_Price:decimal(18,2),Discount_Applied:decimal(18,2)",
    "menu": "Item_ID:long,Item_Name:string,Category_ID:long,Base_Price:decimal(18,2),Cost:decimal(18,2),Introduced_Date:date",
}


@query("src_ingest_summary", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows, {len(fields.replace('18,2', '').split(','))} AS columns, '{fields}' AS fields, '{contract.RAW_VERSION}' AS schema_version FROM {'clean_orders' if name == 'orders' else name}"
    for name, fields in SUMMARY_FIELDS.items()))
def src_ingest_summary(t):
    summary = raw.ingest_summary({"orders": t.orders, "lines": t.lines, "menu": t.menu})
    parsed = F.from_json("schema", "struct<fields:array<struct<name:string,type:string>>>")
    fields = F.array_join(F.transform(parsed["fields"], lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",")
    return summary.withColumn("fields", fields).drop("schema", "input_files")


@query("snk_partitioned", "SELECT CAST(Location_ID AS INTEGER) AS Location_ID, count(*) AS rows FROM sales GROUP BY 1")
def snk_partitioned(t):
    return snapshot.write_partitioned(t.sales, scratch_path(t.spark, "by-location"))


@query("snk_parquet", "SELECT Wastage_ID, CAST(Wastage_Date AS VARCHAR) AS Wastage_Date, CAST(Cost_Impact AS DOUBLE) AS Cost_Impact, Reason FROM wastage")
def snk_parquet(t):
    folder = scratch_path(t.spark, "clean")
    snapshot.write_clean({"wastage": t.wastage}, folder)
    return t.spark.read.parquet(f"{folder}/wastage").select("Wastage_ID", "Wastage_Date", "Cost_Impact", "Reason")


@query("snk_report", """SELECT CAST(Location_ID AS VARCHAR) AS Location_ID, CAST(count(*) AS VARCHAR) AS lines FROM sales GROUP BY 1""")
def snk_report(t):
    path = scratch_path(t.spark, "report")
    sinks.write_report(t.sales.groupBy("Location_ID").agg(F.count(F.lit(1)).alias("lines")), path)
    return t.spark.read.option("header", True).csv(path)


@query("snk_safe_export", """SELECT c_custkey AS Customer_ID, CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS Balance FROM customer""")
def snk_safe_export(t):
    accounts = t.source("customer").select(
        F.col("c_custkey").alias("Customer_ID"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("Balance")
    )
    return sinks.neutralise(accounts)


@query("src_scale_replicate", """SELECT b AS batch, count(*) AS lines, count(DISTINCT l.Order_ID) AS orders, CAST(sum(Quantity) AS BIGINT) AS units
    FROM lines l JOIN clean_orders o ON l.Order_ID = o.Order_ID, (SELECT unnest(range(5)) AS b) GROUP BY 1""")
def src_scale_replicate(t):
    step = 1_000_000_000
    orders = raw.replicate(t.orders, 5, {"Order_ID": step})
    lines = raw.replicate(t.lines, 5, {"Order_Item_ID": step * 8, "Order_ID": step})
    joined = lines.join(orders.select("Order_ID"), "Order_ID")
    return joined.groupBy(F.floor(F.col("Order_ID") / step).alias("batch")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("Order_ID").alias("orders"), F.sum("Quantity").alias("units")
    )


# -- cleaning ----------------------------------------------------------------------------------------

ORDER_BY = "Ship_Date, Item_ID, Supplier_ID, Quantity, Extended, Tax_Percent"


def number(c: str) -> str:
    return f"TRY_CAST({c} AS DOUBLE)"


def not_finite(c: str) -> str:
    return f"NOT coalesce(isfinite({number(c)}), false)"


CLEAN = {
    "ok_menu": """SELECT * FROM raw_menu WHERE Cost >= 0 AND Item_ID IN (SELECT Item_ID FROM raw_prices WHERE Price > 0)""",
    "parsed_orders": """SELECT CAST(Order_ID AS BIGINT) AS Order_ID, TRY_CAST(Customer_ID AS BIGINT) AS Customer_ID, CAST(Location_ID AS BIGINT) AS Location_ID,
        TRY_CAST(substr(Order_DateTime, 1, 19) AS TIMESTAMP) AS Order_DateTime, Channel, Order_Status FROM raw_orders WHERE Channel <> 'Unknown channel'""",
    "ok_orders": """SELECT * FROM parsed_orders WHERE Customer_ID IN (SELECT Customer_ID FROM customers) AND Location_ID IN (SELECT Location_ID FROM locations)
        AND Order_DateTime IS NOT NULL""",
    "line_shape": f"""SELECT *, CASE WHEN {not_finite('Quantity')} THEN 'finite_Quantity' WHEN {not_finite('Unit_Price')} THEN 'finite_Unit_Price'
        WHEN {not_finite('Discount_Applied')} THEN 'finite_Discount_Applied' WHEN {number('Quantity')} % 1 <> 0 THEN 'integer_quantity' END AS rule FROM raw_lines""",
    "first_lines": f"""SELECT *, Order_Item_ID IS NOT NULL AND Quantity > 0 AND Unit_Price > 0 AND Discount_Applied >= 0 AND Discount_Applied <= Quantity * Unit_Price AS valid,
        Item_ID IN (SELECT Item_ID FROM ok_menu) AND Order_ID IN (SELECT Order_ID FROM ok_orders) AS resolved FROM (
        SELECT CAST(Order_Item_ID AS BIGINT) AS Order_Item_ID, CAST(Order_ID AS BIGINT) AS Order_ID, CAST(Item_ID AS BIGINT) AS Item_ID,
        CAST({number('Quantity')} AS BIGINT) AS Quantity, CAST(Unit_Price AS DECIMAL(18,4)) AS Unit_Price, CAST(Discount_Applied AS DECIMAL(18,4)) AS Discount_Applied,
        Ship_Date, Supplier_ID, Extended, Tax_Percent FROM line_shape WHERE rule IS NULL)
        QUALIFY row_number() OVER (PARTITION BY Order_Item_ID ORDER BY {ORDER_BY}) = 1""",
    "waste_known": """SELECT *, Item_ID IN (SELECT Item_ID FROM ok_menu) AND Location_ID IN (SELECT Location_ID FROM locations) AS resolved,
        coalesce(Wastage_Date IS NOT NULL AND Quantity_Wasted >= 0 AND Cost_Impact >= 0 AND Demand_Quantity >= 0 AND Prepared_Quantity >= 0 AND Quantity_Consumed >= 0
        AND Quantity_Wasted <= Prepared_Quantity, false) AS valid FROM raw_wastage WHERE NOT Quantity_Consumed + Quantity_Wasted > Prepared_Quantity""",
}


def ok_menu(t):
    return cleaning.clean_menu(t.raw_menu, t.raw_prices, [F.col("Item_Name")]).rows


def ok_orders(t):
    return cleaning.clean_orders(t.raw_orders, t.customers, t.locations, CHANNELS, [F.col("Order_DateTime"), F.col("Customer_ID")])


def ok_lines(t):
    return cleaning.clean_lines(t.raw_lines, ok_orders(t).rows, ok_menu(t), t.line_order())


def ok_wastage(t):
    return cleaning.clean_wastage(t.raw_wastage, ok_menu(t), t.locations, [F.col("Wastage_Date"), F.col("Item_ID"), F.col("Location_ID")])


@query("cln_quarantine", """SELECT Order_Item_ID AS record_identifier, 'Order_Items' AS source_table, rule, CASE WHEN rule = 'integer_quantity' THEN 'Quantity must be whole portions'
    ELSE 'Nonfinite financial or quantity value' END AS reason, 'quarantined' AS action FROM line_shape WHERE rule IS NOT NULL
    UNION ALL SELECT CAST(Order_Item_ID AS VARCHAR), 'Order_Items', 'valid_line_values', 'Missing reference or invalid quantity, price, or discount', 'quarantined' FROM first_lines WHERE NOT valid
    UNION ALL SELECT CAST(Order_Item_ID AS VARCHAR), 'Order_Items', 'known_line_references', 'Unknown order or valid item', 'quarantined' FROM first_lines WHERE valid AND NOT resolved""", CLEAN)
def cln_quarantine(t):
    return ok_lines(t).rejections


@query("cln_finite", "SELECT Order_Item_ID, " + ", ".join(f"CAST(coalesce(isfinite({number(c)}), false) AS INTEGER) AS {c}" for c in LINE_FIELDS[3:]) + " FROM raw_lines")
def cln_finite(t):
    return t.raw_lines.select("Order_Item_ID", *[finite(F.col(c)).alias(c) for c in LINE_FIELDS[3:]])


@query("cln_integer_qty", "SELECT Order_Item_ID, Quantity FROM raw_lines WHERE coalesce(TRY_CAST(Quantity AS DOUBLE) % 1 <> 0, true)")
def cln_integer_qty(t):
    return t.raw_lines.where(fractional(F.col("Quantity"))).select("Order_Item_ID", "Quantity")


@query("cln_enum", "SELECT Order_ID, Channel FROM raw_orders WHERE Channel = 'Unknown channel'")
def cln_enum(t):
    return t.raw_orders.where(~known(F.col("Channel"), CHANNELS)).select("Order_ID", "Channel")


@query("cln_dedup_first", "SELECT Order_Item_ID, Item_ID, Quantity, CAST(Unit_Price AS DOUBLE) AS Unit_Price FROM first_lines_raw")
def cln_dedup_first(t):
    return cleaning.dedup_first(t.raw_lineitem, "Order_Item_ID", t.line_order()).select("Order_Item_ID", "Item_ID", "Quantity", "Unit_Price")


@query("cln_order_fields", """SELECT CAST(Order_ID AS VARCHAR) AS record_identifier, 'required_order_fields' AS rule FROM parsed_orders WHERE Customer_ID IS NULL OR Order_DateTime IS NULL
    UNION ALL SELECT Order_ID, 'known_channel' FROM raw_orders WHERE Channel = 'Unknown channel'
    UNION ALL SELECT CAST(Order_ID AS VARCHAR), 'known_order_references' FROM parsed_orders WHERE Customer_ID IS NOT NULL AND Order_DateTime IS NOT NULL AND Customer_ID NOT IN (SELECT Customer_ID FROM customers)""", CLEAN)
def cln_order_fields(t):
    return ok_orders(t).rejections.select("record_identifier", "rule")


@query("cln_fk_orders", """SELECT Order_ID, Customer_ID, strftime(Order_DateTime, '%Y-%m-%d %H:%M:%S') AS Order_DateTime, Channel, Order_Status FROM ok_orders""", CLEAN)
def cln_fk_orders(t):
    return ok_orders(t).rows.select("Order_ID", "Customer_ID", "Order_DateTime", "Channel", "Order_Status")


@query("cln_fk_lines", "SELECT Order_Item_ID, Order_ID, Item_ID FROM lines WHERE Item_ID NOT IN (SELECT Item_ID FROM ok_menu)", CLEAN)
def cln_fk_lines(t):
    return cleaning.fk_reject(t.lines, "Item_ID", ok_menu(t)).rejections.select("Order_Item_ID", "Order_ID", "Item_ID")


@query("cln_fk_ratings", "SELECT Rating_ID, Item_ID FROM raw_ratings WHERE Item_ID NOT IN (SELECT Item_ID FROM ok_menu)", CLEAN)
def cln_fk_ratings(t):
    return cleaning.fk_reject(t.raw_ratings, "Item_ID", ok_menu(t)).rejections.select("Rating_ID", "Item_ID")


@query("cln_fk_wastage", "SELECT CAST(Wastage_ID AS VARCHAR) AS record_identifier FROM waste_known WHERE NOT resolved", CLEAN)
def cln_fk_wastage(t):
    found = ok_wastage(t).rejections
    return found.where(F.col("rule") == "known_wastage_references").select("record_identifier")


@query("cln_line_values", """SELECT Order_Item_ID, Order_ID, Item_ID, Quantity, CAST(Unit_Price AS DOUBLE) AS Unit_Price, CAST(Discount_Applied AS DOUBLE) AS Discount_Applied
    FROM first_lines WHERE valid AND resolved""", CLEAN)
def cln_line_values(t):
    return ok_lines(t).rows.select(*LINE_FIELDS)


@query("cln_menu", "SELECT Item_ID, CAST(Cost AS DOUBLE) AS Cost, CAST(Base_Price > 0 AS INTEGER) AS Base_Price_Valid FROM ok_menu", CLEAN)
def cln_menu(t):
    return ok_menu(t).select("Item_ID", "Cost", "Base_Price_Valid")


@query("cln_prices", "SELECT Pricing_ID, CAST(Price AS DOUBLE) AS Price FROM raw_prices WHERE Price > 0 AND Item_ID IN (SELECT Item_ID FROM ok_menu)", CLEAN)
def cln_prices(t):
    return cleaning.clean_prices(t.raw_prices, ok_menu(t), [F.col("Effective_Date")]).rows.select("Pricing_ID", "Price")


@query("cln_promotions", """SELECT Promotion_ID, Applicable_Item_ID, Applicable_Category_ID FROM promotions WHERE
    (Applicable_Item_ID IS NULL OR Applicable_Item_ID IN (SELECT Item_ID FROM ok_menu)) AND (Applicable_Category_ID IS NULL OR Applicable_Category_ID IN (SELECT Category_ID FROM ok_menu))""", CLEAN)
def cln_promotions(t):
    return cleaning.clean_promotions(t.promotions, ok_menu(t)).select("Promotion_ID", "Applicable_Item_ID", "Applicable_Category_ID")


@query("cln_inventory", """SELECT Inventory_ID, Item_ID, Location_ID, Stock_Quantity FROM (SELECT * FROM inventory
    QUALIFY row_number() OVER (PARTITION BY Inventory_ID ORDER BY Period_End, Item_ID, Location_ID, Extended, Stock_Quantity) = 1) WHERE Item_ID IN (SELECT Item_ID FROM ok_menu)""", CLEAN)
def cln_inventory(t):
    order = [F.col(c) for c in ("Period_End", "Item_ID", "Location_ID", "Extended", "Stock_Quantity")]
    return cleaning.clean_inventory(t.inventory, ok_menu(t), t.locations, order).select("Inventory_ID", "Item_ID", "Location_ID", "Stock_Quantity")


@query("cln_ratings", """SELECT Rating_ID, Order_ID, Item_ID, Stars FROM raw_ratings WHERE Stars BETWEEN 1 AND 5
    AND Order_ID IN (SELECT Order_ID FROM ok_orders WHERE Order_Status = 'Completed') AND Item_ID IN (SELECT Item_ID FROM ok_menu)""", CLEAN)
def cln_ratings(t):
    rows = cleaning.clean_ratings(t.raw_ratings, ok_orders(t).rows, ok_menu(t), [F.col("Rating_Date")]).rows
    return rows.select("Rating_ID", "Order_ID", "Item_ID", "Stars")


@query("cln_wastage", "SELECT Wastage_ID, Item_ID, Location_ID, Quantity_Wasted FROM waste_known WHERE resolved AND valid", CLEAN)
def cln_wastage(t):
    return ok_wastage(t).rows.select("Wastage_ID", "Item_ID", "Location_ID", "Quantity_Wasted")


# -- quality -----------------------------------------------------------------------------------------


def count_where(name: str, table: str, condition: str) -> str:
    return f"SELECT '{name}' AS condition, count(*) FILTER ({condition}) AS records FROM {table}"


def count_extra(name: str, table: str, key: str) -> str:
    return f"SELECT '{name}' AS condition, count(*) - count(DISTINCT {key}) AS records FROM {table}"


def unless(condition: str) -> str:
    return f"NOT coalesce({condition}, false)"


def missing(key: str, dim: str) -> str:
    return f"{key} IS NULL OR {key} NOT IN (SELECT {key} FROM {dim} WHERE {key} IS NOT NULL)"


Q, P, D = number("Quantity"), number("Unit_Price"), number("Discount_Applied")
PROFILE_TABLES = {"typed_lines": "SELECT * REPLACE (CAST(Item_ID AS BIGINT) AS Item_ID) FROM raw_lines"}


@query("dq_profile", " UNION ALL ".join([
    count_extra("duplicate_order_headers", "raw_orders", "Order_ID"), count_extra("duplicate_customers", "customers", "Customer_ID"),
    count_where("missing_customer_names", "customers", "Customer_Name IS NULL"), count_where("missing_order_dates", "raw_orders", "Order_DateTime IS NULL"),
    count_where("missing_order_ids", "raw_orders", "Order_ID IS NULL"), count_where("invalid_order_statuses", "raw_orders", "Order_Status NOT IN ('Completed', 'Cancelled')"),
    count_where("cancelled_orders", "raw_orders", "Order_Status = 'Cancelled'"), count_extra("duplicate_order_lines", "typed_lines", "Order_Item_ID"),
    count_where("invalid_line_quantities", "typed_lines", unless(f"{Q} > 0")), count_where("invalid_line_prices", "typed_lines", unless(f"{P} > 0")),
    count_where("invalid_line_discounts", "typed_lines", f"{unless(f'{D} >= 0')} OR coalesce({D} > {Q} * {P}, false)"),
    count_where("line_unknown_order_ids", "typed_lines", missing("Order_ID", "raw_orders")), count_where("line_unknown_item_ids", "typed_lines", missing("Item_ID", "raw_menu")),
    count_where("invalid_base_prices", "raw_menu", unless("Base_Price > 0")), count_where("invalid_history_prices", "raw_prices", unless("Price > 0")),
    count_where("invalid_rating_stars", "raw_ratings", unless("Stars BETWEEN 1 AND 5")),
    count_where("rating_unknown_order_ids", "raw_ratings", "CAST(Order_ID AS VARCHAR) NOT IN (SELECT Order_ID FROM raw_orders)"),
    count_where("rating_unknown_item_ids", "raw_ratings", missing("Item_ID", "raw_menu")),
    count_where("invalid_wastage_quantities", "raw_wastage", unless("Quantity_Wasted >= 0")), count_where("invalid_wastage_costs", "raw_wastage", unless("Cost_Impact >= 0")),
    count_where("wastage_unknown_item_ids", "raw_wastage", missing("Item_ID", "raw_menu")), count_where("wastage_unknown_location_ids", "raw_wastage", missing("Location_ID", "locations")),
]), PROFILE_TABLES)
def dq_profile(t):
    ratings = t.raw_ratings.withColumn("Order_ID", F.col("Order_ID").cast("string"))
    lines = t.raw_lines.withColumn("Item_ID", F.col("Item_ID").cast("long"))
    return quality.dq_profile(t.raw_orders, lines, t.raw_menu, t.raw_prices, t.customers, t.locations, ratings, t.raw_wastage)


@query("dq_profile_basic", " UNION ALL ".join([
    count_where("negative_quantities", "raw_lines", f"{Q} < 0"), count_extra("duplicate_orders", "raw_orders", "Order_ID"),
    count_where("missing_order_dates", "raw_orders", "Order_DateTime IS NULL"),
]))
def dq_profile_basic(t):
    return quality.dq_basic(t.raw_lines, t.raw_orders)


@query("dq_quality_report", """SELECT 'raw_orders' AS stage, count(*) AS rows FROM raw_orders UNION ALL SELECT 'raw_lines', count(*) FROM raw_lines
    UNION ALL SELECT 'valid_orders', count(*) FROM ok_orders UNION ALL SELECT 'completed_orders', count(*) FROM ok_orders WHERE Order_Status = 'Completed'
    UNION ALL SELECT 'valid_lines', count(*) FROM first_lines WHERE valid AND resolved UNION ALL SELECT 'clean_completed_lines', count(*) FROM first_lines
        WHERE valid AND resolved AND Order_ID IN (SELECT Order_ID FROM ok_orders WHERE Order_Status = 'Completed')
    UNION ALL SELECT 'valid_wastage', count(*) FROM waste_known WHERE resolved AND valid""", CLEAN)
def dq_quality_report(t):
    # One narrow row per order and per dish; every raw table is judged once.
    orders, dishes = materialise(ok_orders(t).rows.select("Order_ID", "Order_Status")), materialise(ok_menu(t).select("Item_ID", "Category_ID"))
    lines = cleaning.clean_lines(t.raw_lines, orders, dishes, t.line_order()).rows
    done = facts.completed(orders).select("Order_ID", F.lit(True).alias("_done"))
    sold = lines.select("Order_ID").join(done, "Order_ID", "left")
    spoilt = cleaning.clean_wastage(t.raw_wastage, dishes, t.locations, [F.col("Wastage_Date"), F.col("Item_ID"), F.col("Location_ID")]).rows
    every = F.lit(True)
    return quality.quality_report({"raw_orders": t.raw_orders, "raw_lines": t.raw_lines, "valid_wastage": spoilt}, [
        (orders, {"valid_orders": every, "completed_orders": F.col("Order_Status") == "Completed"}),
        (sold, {"valid_lines": every, "clean_completed_lines": F.coalesce("_done", F.lit(False))}),
    ])


@query("dq_reconcile", """WITH a AS (SELECT * FROM tagged JOIN asof_sales USING (Order_Item_ID))
    SELECT 'rows' AS measure, CAST((SELECT count(*) FROM a) AS DOUBLE) AS amount, CAST((SELECT count(*) FROM sales) AS DOUBLE) AS authority
    UNION ALL SELECT 'distinct_lines', count(DISTINCT Order_Item_ID), NULL FROM a
    UNION ALL SELECT 'net_revenue', sum(Net_Revenue), sum(Net_Revenue) FROM sales UNION ALL SELECT 'cost', sum(Cost_Total), sum(Cost_Total) FROM sales
    UNION ALL SELECT 'contribution', sum(Contribution), sum(Contribution) FROM sales
    UNION ALL SELECT 'missing_price', count(*) FILTER (Effective_Price IS NULL), NULL FROM asof_sales
    UNION ALL SELECT 'price_mismatch', count(*) FILTER (abs(Effective_Price - Unit_Price) > 0.01), NULL FROM asof_sales
    UNION ALL SELECT 'missing_promotion', count(*) FILTER (Promotion_ID IS NOT NULL AND Promotion_Name IS NULL), NULL FROM tagged
    UNION ALL SELECT 'missing_dimension', count(*) FILTER (Category_Name IS NULL OR Location_Name IS NULL), NULL
        FROM tagged""", STAR)
def dq_reconcile(t):
    everything = star(t, promotions=t.promotions, ratings=t.ratings, inventory=t.inventory, wastage=t.wastage, prices=t.prices)
    return quality.reconcile(everything, t.sales)


@query("dq_ledger_balance", " UNION ALL ".join([
    count_where("stock_balance", "inventory", "Opening_Stock + Received_Quantity - Consumed_Quantity - Wasted_Quantity <> Stock_Quantity"),
    count_where("preparation_balance", "raw_wastage", "Item_ID IN (SELECT Item_ID FROM menu) AND Quantity_Consumed + Quantity_Wasted <> Prepared_Quantity"),
    count_where("wastage_cost", "raw_wastage JOIN menu USING (Item_ID)", "abs(round(Cost * Quantity_Wasted, 2) - Cost_Impact) > 0.01"),
]))
def dq_ledger_balance(t):
    return quality.ledger_violations(t.inventory, t.raw_wastage, t.menu)


@query("dq_temporal", " UNION ALL ".join([
    count_where("order_before_signup", "clean_orders o JOIN customers c ON o.Customer_ID = c.Customer_ID", "CAST(Order_DateTime AS DATE) < Signup_Date"),
    count_where("order_before_opening", "clean_orders o JOIN locations c ON o.Location_ID = c.Location_ID", "CAST(Order_DateTime AS DATE) < Opening_Date"),
    count_where("line_before_introduction", "lines l JOIN clean_orders o ON l.Order_ID = o.Order_ID JOIN menu m ON l.Item_ID = m.Item_ID", "CAST(Order_DateTime AS DATE) < Introduced_Date"),
    count_where("rating_before_order", "ratings r JOIN clean_orders o ON r.Order_ID = o.Order_ID", "Rating_Date < CAST(Order_DateTime AS DATE)"),
    count_where("tag_outside_campaign", "clean_orders o JOIN promotions p ON o.Promotion_ID = p.Promotion_ID", "CAST(Order_DateTime AS DATE) NOT BETWEEN Start_Date AND End_Date"),
]))
def dq_temporal(t):
    return quality.temporal_violations(t.orders, t.lines, t.ratings, t.customers, t.locations, t.menu, t.promotions)


def share(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 8)"


def some(c: str) -> str:
    return f"sum(CASE WHEN {c} THEN Quantity ELSE 0 END)"


@query("dq_scenario_checks", f"""WITH b AS (SELECT Item_ID, sum(Quantity) AS units, sum(Contribution) AS contribution, {some('isodow(Date) >= 6')} AS we, {some('isodow(Date) < 6')} AS wd,
    {some('month(Date) <= 6')} AS h1, {some('month(Date) > 6')} AS h2, {some('Discount_Applied > 0')} AS pr, {some('Discount_Applied = 0')} AS pl FROM sales GROUP BY 1),
    mo AS (SELECT Item_ID, max(q) AS tm FROM (SELECT Item_ID, month(Date) AS m, sum(Quantity) AS q FROM sales GROUP BY 1, 2) GROUP BY 1),
    pc AS (SELECT Item_ID, max(q) AS tl, min(q) AS ll FROM (SELECT Item_ID, Location_ID, sum(Quantity) AS q FROM sales GROUP BY 1, 2) GROUP BY 1),
    wa AS (SELECT Item_ID, sum(Quantity_Wasted) AS w FROM wastage GROUP BY 1),
    ra AS (SELECT Item_ID, max(n) AS burst, sum(n) AS n, sum(s) AS s FROM (SELECT Item_ID, Rating_Date, count(*) AS n, sum(Stars) AS s FROM ratings GROUP BY 1, 2) GROUP BY 1)
    SELECT Item_ID, CAST(units AS BIGINT) AS units, CAST(contribution AS DOUBLE) AS contribution, CAST(w AS BIGINT) AS wasted, burst AS largest_burst, {share('w', 'units')} AS waste_ratio,
    {share('tm', 'units')} AS top_month_share, {share('tl', 'll')} AS location_skew, {share('we', 'wd')} AS weekend_ratio, {share('h1', 'h2')} AS half_year_ratio, {share('pr', 'pl')} AS promotion_ratio,
    {share('s', 'n')} AS average_stars, CAST(units > 5 * (SELECT quantile_cont(units, 0.5) FROM b) AND contribution < 0 AS INTEGER) AS popular_loss,
    CAST(units < (SELECT quantile_cont(units, 0.5) FROM b) / 10 AND contribution > 0 AS INTEGER) AS hidden_profit
    FROM b JOIN mo USING (Item_ID) JOIN pc USING (Item_ID) LEFT JOIN wa USING (Item_ID) LEFT JOIN ra USING (Item_ID)""")
def dq_scenario_checks(t):
    return quality.scenario_metrics(t.sales, t.wastage, t.ratings)
