"""Declared schemas of the retail tables (no inference anywhere).

Ids are LongType: at the target scale product and sale ids exceed 2^31.
Timestamps without a zone are TIMESTAMP_NTZ so that results do not depend on
the session time zone; heartbeats and update times keep the zone-aware type
of the source model only where the source has a zone.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
TOTAL = T.DecimalType(20, 10)
PRICE6 = T.DecimalType(20, 6)

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("base_price", MONEY, False),
    T.StructField("category_id", T.LongType(), False),
    T.StructField("supplier_id", T.LongType(), False),
    T.StructField("available", T.BooleanType(), False),
    T.StructField("last_update_time", T.TimestampNTZType(), True),
])

CATEGORIES = T.StructType([
    T.StructField("category_id", T.LongType(), False),
    T.StructField("category_name", T.StringType(), False),
    T.StructField("parent_id", T.LongType(), True),
])

SUPPLIERS = T.StructType([
    T.StructField("supplier_id", T.LongType(), False),
    T.StructField("supplier_name", T.StringType(), False),
])

SALES = T.StructType([
    T.StructField("sale_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("sale_price", T.DecimalType(18, 4), False),
    T.StructField("sale_date", T.TimestampNTZType(), False),
    T.StructField("price", T.DecimalType(12, 2), False),
])

INVENTORY = T.StructType([
    T.StructField("inventory_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("stock", T.IntegerType(), False),
    T.StructField("warehouse_id", T.LongType(), False),
    T.StructField("restock_date", T.TimestampNTZType(), True),
])

PROMOTIONS = T.StructType([
    T.StructField("promotion_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("promotion_discount", MONEY, False),
    T.StructField("start_date", T.TimestampNTZType(), False),
    T.StructField("end_date", T.TimestampNTZType(), False),
    T.StructField("active", T.BooleanType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

SHOPPING_CART = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("category_id", T.LongType(), False),
    T.StructField("price", MONEY, False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

HEARTBEATS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), True),
])

REFRESH_LOG = T.StructType([
    T.StructField("view_name", T.StringType(), False),
    T.StructField("last_refresh", T.TimestampNTZType(), True),
    T.StructField("refresh_duration", T.DoubleType(), True),
])

QUERY_LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("latency_ms", T.DoubleType(), True),
    T.StructField("product_id", T.LongType(), True),
])

# Primary keys, NOT NULL columns and foreign keys of the source model.
PRIMARY_KEYS = {
    "products": ["product_id"],
    "categories": ["category_id"],
    "suppliers": ["supplier_id"],
    "sales": ["sale_id"],
    "inventory": ["inventory_id"],
    "promotions": ["promotion_id"],
    "heartbeats": ["id"],
    "materialized_view_refresh_log": ["view_name"],
}

FOREIGN_KEYS = [
    ("inventory", "product_id", "products", "product_id"),
    ("promotions", "product_id", "products", "product_id"),
    ("sales", "product_id", "products", "product_id"),
]

SCHEMAS = {
    "products": PRODUCTS,
    "categories": CATEGORIES,
    "suppliers": SUPPLIERS,
    "sales": SALES,
    "inventory": INVENTORY,
    "promotions": PROMOTIONS,
    "shopping_cart": SHOPPING_CART,
    "heartbeats": HEARTBEATS,
    "materialized_view_refresh_log": REFRESH_LOG,
}


def not_null_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
