"""The raw table contract: fields, types, required ids and allowed values."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Dataset versions, fields and types of the eleven tables, allowed values.
RAW_VERSION = "phase1-v1"
CLEAN_VERSION = "phase1-v1-clean-v3"
CHANNELS = ("Dine-in", "Takeaway", "Website", "App", "Third-Party Delivery")
STATUSES = ("Completed", "Cancelled")
REASONS = ("Overproduction", "Spoilage", "Preparation Error", "Customer Return", "Expired Ingredients")
FIELDS = {
    "Customers": "Customer_ID bigint, Customer_Name string, City string, Signup_Date date, Preferred_Channel string",
    "Menu_Categories": "Category_ID bigint, Category_Name string",
    "Menu_Items": "Item_ID bigint, Item_Name string, Category_ID bigint, Base_Price decimal(18,2), Cost decimal(18,2), "
    "Description string, Is_Available bigint, Introduced_Date date",
    "Restaurants": "Location_ID bigint, Location_Name string, City string, Address string, Opening_Date date",
    "Promotions": "Promotion_ID bigint, Promotion_Name string, Discount_Percent bigint, Start_Date date, End_Date date, "
    "Applicable_Category_ID bigint, Applicable_Item_ID bigint",
    "Orders": "Order_ID bigint, Customer_ID bigint, Location_ID bigint, Order_DateTime timestamp, Channel string, "
    "Promotion_ID bigint, Order_Status string",
    "Order_Items": "Order_Item_ID bigint, Order_ID bigint, Item_ID bigint, Quantity bigint, Unit_Price decimal(18,2), "
    "Discount_Applied decimal(18,2)",
    "Pricing_History": "Pricing_ID bigint, Item_ID bigint, Price decimal(18,2), Effective_Date date",
    "Ratings": "Rating_ID bigint, Order_ID bigint, Item_ID bigint, Customer_ID bigint, Stars bigint, Rating_Date timestamp",
    "Inventory": "Inventory_ID bigint, Location_ID bigint, Item_ID bigint, Stock_Quantity bigint, Reorder_Level bigint, "
    "Last_Restocked_Date date, Opening_Stock bigint, Received_Quantity bigint, Consumed_Quantity bigint, "
    "Wasted_Quantity bigint, Period_Start date, Period_End date",
    "Wastage": "Wastage_ID bigint, Item_ID bigint, Location_ID bigint, Wastage_Date date, Quantity_Wasted bigint, "
    "Cost_Impact decimal(18,2), Reason string, Demand_Quantity bigint, Prepared_Quantity bigint, Quantity_Consumed bigint",
}
ALLOWED = {
    "Customers": {"Preferred_Channel": CHANNELS},
    "Menu_Items": {"Is_Available": (0, 1)},
    "Orders": {"Channel": CHANNELS, "Order_Status": STATUSES},
    "Wastage": {"Reason": REASONS},
}
OPTIONAL_IDS = {"Orders": {"Promotion_ID"}}
# The text form of each type; instants carry the restaurants' offset.
PATTERNS = {
    "bigint": r"^[+-]?\d+$",
    "decimal(18,2)": r"^[+-]?\d+(\.\d{1,2})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?[+]05:00$",
}
# The clean snapshot: view name and table name.
CLEAN_TABLES = {
    "clean_orders": "orders_validated",
    "clean_customers": "customers_validated",
    "clean_lines": "order_items_validated",
    "clean_menu": "menu_items_validated",
    "clean_categories": "menu_categories_validated",
    "clean_locations": "restaurant_locations_validated",
    "clean_promotions": "promotions_validated",
    "clean_prices": "pricing_history_validated",
    "clean_ratings": "ratings",
    "clean_inventory": "inventory_validated",
    "clean_wastage": "wastage",
    "authoritative_sales": "sales",
}


def schema(table: str) -> StructType:
    if table not in FIELDS:
        raise ValueError(f"unknown table: {table}")
    return StructType.fromDDL(FIELDS[table])


def text_schema(names) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def primary_key(table: str) -> str:
    return schema(table).fieldNames()[0]


def required_ids(table: str) -> list[str]:
    optional = OPTIONAL_IDS.get(table, set())
    return [n for n in schema(table).fieldNames() if n.endswith("_ID") and n not in optional]
