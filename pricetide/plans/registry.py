"""Named queries: ``(spark, sf_dir) -> DataFrame`` over the derived retail tables.

Each key has its DuckDB twin in :mod:`pricetide.plans.oracle` unless the result
depends on seeded randomness or on a stream's progress only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.functions import factors
from pricetide.functions.rand import random_row, sample_n, uniform_sql
from pricetide.operators import cart as cartops
from pricetide.operators import change_rows, changes
from pricetide.operators import hierarchy
from pricetide.operators import metrics
from pricetide.operators import pricing
from pricetide.operators.ordering import global_position, range_bounds, range_of
from pricetide.plans.oracle import CART, CATEGORY_TOTALS, CART_CTE_NAMES, TOTALS_CTE_NAMES, rename
from pricetide.plans.oracle import CHANGE_FEEDS, PRICING, pricing_over
from pricetide.plans.oracle import OTHER_OFFSET_FIXTURE, carted, totaled, with_tables
from pricetide.plans.oracle import oracle, priced
from pricetide.session import scratch_path, written
from pricetide.sources import datagen, io
from pricetide.sources import testdata
from pricetide.sources.testdata import retail_tables
from pricetide.streaming import live
from pricetide.streaming import maintain as mt
from pricetide.streaming import qps as qps_stream
from pricetide.streaming.trailing import LiveMetrics

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# progress reports of the last maintained-view stream run (read by bench.py for the micro-batch lag)
LAST_STREAM_PROGRESS: list[dict] = []


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            oracle(name, sql)
        return fn
    return deco


def _items(t):
    return pricing.inventory_item(t.products, t.sales, t.promotions, t.inventory)


# --------------------------------------------------------------------------- D1 and parts

@query("inventory_item", priced("SELECT product_id, live_price, last_update_time FROM inventory_item"))
def q_inventory_item(spark, d):
    return _items(retail_tables(spark, d))


@query("recent_prices", priced("SELECT product_id, avg_price FROM recent_prices"))
def q_recent_prices(spark, d):
    return pricing.recent_prices(retail_tables(spark, d).sales)


@query("promotion_effect", priced("SELECT product_id, promotion_discount FROM promotion_effect"))
def q_promotion_effect(spark, d):
    t = retail_tables(spark, d)
    return pricing.promotion_effect(t.promotions, t.products)


@query("popularity_score", priced(
    "SELECT product_id, category_id, popularity_rank, sale_count FROM popularity_score"))
def q_popularity_score(spark, d):
    t = retail_tables(spark, d)
    return pricing.popularity_score(t.sales, t.products)


@query("inventory_status", priced("SELECT product_id, total_stock, stock_rank FROM inventory_status"))
def q_inventory_status(spark, d):
    return pricing.inventory_status(retail_tables(spark, d).inventory)


@query("stock_bands", priced("""
SELECT product_id, total_stock,
       CAST(CASE WHEN stock_rank <= 3 THEN 1.1 WHEN stock_rank BETWEEN 4 AND 10 THEN 1.05 ELSE 1 END AS DOUBLE)
         AS stock_adjustment
FROM inventory_status"""))
def q_stock_bands(spark, d):
    return pricing.stock_bands(retail_tables(spark, d).inventory)


@query("high_demand", priced("SELECT product_id, avg_sale_price, total_sales FROM high_demand"))
def q_high_demand(spark, d):
    t = retail_tables(spark, d)
    return pricing.high_demand(t.products, t.sales)


@query("item_factors", priced("""
SELECT product_id, base_price, popularity_adjustment, avg_price, promotion_discount, stock_adjustment,
       demand_multiplier, additional_discount, last_update_time
FROM item_factors"""))
def q_item_factors(spark, d):
    t = retail_tables(spark, d)
    return pricing.item_factors(t.products, t.sales, t.promotions, t.inventory)


@query("price_point", priced("SELECT product_id, live_price AS price FROM inventory_item WHERE product_id = 1"))
def q_price_point(spark, d):
    return pricing.price_of(_items(retail_tables(spark, d)), 1)


# --------------------------------------------------------------------------- D4-D12


# Sample drill-down state of the cart page: one region and one nation opened.
EXPANDED = (1, 103)


def _cart(t, dedupe_stock=False):
    return cartops.dynamic_cart(t.shopping_cart, t.products, t.categories, _items(t), t.inventory,
                                dedupe_stock=dedupe_stock)


def _totals(t):
    return hierarchy.category_totals(t.categories, _cart(t), other_offset=OTHER_OFFSET_FIXTURE)


@query("dynamic_cart", carted(
    "SELECT product_id, product_name, category_id, category_name, price, available_stock FROM dynamic_cart"))
def q_dynamic_cart(spark, d):
    return _cart(retail_tables(spark, d))


@query("dynamic_cart_dedupe", carted("""
SELECT sc.product_id, sc.product_name, c.category_id, c.category_name, ii.live_price AS price,
       CAST(COALESCE((SELECT SUM(stock) FROM inventory i WHERE i.product_id = sc.product_id), 0) AS BIGINT)
         AS available_stock
FROM (SELECT DISTINCT product_id, product_name FROM shopping_cart) sc
JOIN products p ON sc.product_id = p.product_id
JOIN categories c ON p.category_id = c.category_id
JOIN inventory_item ii ON p.product_id = ii.product_id"""))
def q_dynamic_cart_dedupe(spark, d):
    return _cart(retail_tables(spark, d), dedupe_stock=True)


@query("sort_cart", carted(
    "SELECT product_id, product_name, category_id, category_name, price, available_stock "
    "FROM dynamic_cart ORDER BY price DESC NULLS LAST, product_id"))
def q_sort_cart(spark, d):
    return cartops.sort_cart(_cart(retail_tables(spark, d)))


@query("cart_total", carted("""
SELECT CAST(COALESCE(ROUND(CAST(SUM(price) AS DECIMAL(38,10)), 2), 0) AS DECIMAL(38,2)) AS cart_total
FROM dynamic_cart"""))
def q_cart_total(spark, d):
    return cartops.cart_total(_cart(retail_tables(spark, d)))


@query("cart_summary", carted("""
SELECT item_count, total,
       replace(replace('Your cart holds $count$ items for a total of $$total$.', '$count$',
               CAST(item_count AS VARCHAR)), '$total$', CAST(total AS VARCHAR)) AS answer
FROM (SELECT COUNT(*) AS item_count, CAST(COALESCE(SUM(price), 0) AS DECIMAL(38,2)) AS total
      FROM dynamic_cart) s"""))
def q_cart_summary(spark, d):
    return cartops.cart_summary(_cart(retail_tables(spark, d)))


@query("cart_stock", with_tables("""
SELECT DISTINCT sc.product_id, i.warehouse_id, i.stock
FROM (SELECT DISTINCT product_id FROM shopping_cart) sc JOIN inventory i ON sc.product_id = i.product_id"""))
def q_cart_stock(spark, d):
    t = retail_tables(spark, d)
    return cartops.cart_stock(t.shopping_cart, t.inventory)


_CT_COLS = "category_id, parent_id, has_subcategory, category_name, total, item_count"


@query("category_totals", totaled(f"SELECT {_CT_COLS} FROM category_totals"))
def q_category_totals(spark, d):
    return _totals(retail_tables(spark, d))


@query("category_totals_closure", totaled(f"SELECT {_CT_COLS} FROM category_totals"))
def q_category_totals_closure(spark, d):
    return _totals(retail_tables(spark, d))


@query("ancestor_closure", with_tables("""
WITH RECURSIVE anc(category_id, ancestor_id, depth) AS (
  SELECT category_id, category_id, 0 FROM categories
  UNION ALL
  SELECT a.category_id, c.parent_id, a.depth + 1 FROM anc a JOIN categories c ON a.ancestor_id = c.category_id
  WHERE c.parent_id IS NOT NULL
)
SELECT category_id, ancestor_id, depth FROM anc"""))
def q_ancestor_closure(spark, d):
    return hierarchy.ancestor_closure(retail_tables(spark, d).categories)


@query("has_subcategories", with_tables("""
SELECT category_id, category_id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) AS has_subcategory
FROM categories"""))
def q_has_subcategories(spark, d):
    return hierarchy.has_children(retail_tables(spark, d).categories)


def _subtotals_sql(expanded):
    shown = " OR ".join(["parent_id IS NULL", *(f"parent_id = {i}" for i in expanded)])
    return totaled(f"""
SELECT category_id, parent_id, has_subcategory, category_name, item_count, round(total, 2)::DECIMAL(38,2) AS subtotal,
       round(sum(total) FILTER (parent_id IS NULL) OVER (), 2)::DECIMAL(38,2) AS categories_total
FROM category_totals QUALIFY {shown} ORDER BY coalesce(parent_id, category_id), category_id""")


@query("category_subtotals", _subtotals_sql(()))
def q_category_subtotals(spark, d):
    return cartops.sort_tree(cartops.category_subtotals(_totals(retail_tables(spark, d))))


@query("category_subtotals_expanded", _subtotals_sql(EXPANDED))
def q_category_subtotals_expanded(spark, d):
    return cartops.sort_tree(cartops.category_subtotals(_totals(retail_tables(spark, d)), EXPANDED))


@query("flat_subtotals", totaled(
    "SELECT category_name, item_count, total AS subtotal FROM category_totals ORDER BY category_name"))
def q_flat_subtotals(spark, d):
    return cartops.flat_subtotals(_totals(retail_tables(spark, d)))


@query("category_list", with_tables(
    "SELECT DISTINCT category_id, category_name FROM categories ORDER BY category_name"))
def q_category_list(spark, d):
    return cartops.category_list(retail_tables(spark, d).categories)


@query("reconcile_cart", totaled("""
SELECT ct.cart_total, COALESCE(rt.categories_total, CAST(0 AS DECIMAL(38,2))) AS categories_total,
       CAST(ct.cart_total - COALESCE(rt.categories_total, 0) AS DECIMAL(38,2)) AS delta
FROM (SELECT CAST(COALESCE(ROUND(CAST(SUM(price) AS DECIMAL(38,10)), 2), 0) AS DECIMAL(38,2)) AS cart_total
      FROM dynamic_cart) ct,
     (SELECT CAST(ROUND(CAST(SUM(total) AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS categories_total
      FROM category_totals WHERE parent_id IS NULL) rt"""))
def q_reconcile_cart(spark, d):
    t = retail_tables(spark, d)
    return cartops.reconcile_cart(_cart(t), _totals(t))


def _snapshot_sql(expanded):
    shown = " OR ".join(["parent_id IS NULL", *(f"parent_id = {i}" for i in expanded)])

    def doc(*columns):
        return "to_json({" + ", ".join(f"'{c}': {c}" for c in columns) + "})::VARCHAR"

    return totaled(f"""
WITH sums AS (
  SELECT (SELECT coalesce(round(sum(price)::DECIMAL(38,10), 2), 0)::DECIMAL(38,2) FROM dynamic_cart) AS cart_total,
         (SELECT coalesce(round(sum(total), 2), 0)::DECIMAL(38,2) FROM category_totals WHERE parent_id IS NULL)
           AS categories_total),
shown AS (SELECT *, round(total, 2)::DECIMAL(38,2) AS subtotal FROM category_totals, sums WHERE {shown})
SELECT 'item' AS kind, row_number() OVER (ORDER BY price DESC NULLS LAST, product_id, product_name) AS position,
       product_id AS id,
       {doc("product_id", "product_name", "category_id", "category_name", "price", "available_stock")} AS doc
FROM dynamic_cart
UNION ALL
SELECT 'category', NULL, category_id, {doc("category_id", "parent_id", "has_subcategory", "category_name", "item_count",
                                           "subtotal", "categories_total")} FROM shown
UNION ALL
SELECT 'total', NULL, NULL, {doc("cart_total", "categories_total")} FROM sums""")


@query("cart_snapshot", _snapshot_sql(EXPANDED))
def q_cart_snapshot(spark, d):
    t = retail_tables(spark, d)
    return cartops.cart_snapshot(_cart(t), t.categories, EXPANDED, other_offset=OTHER_OFFSET_FIXTURE)


# --------------------------------------------------------------------------- S1-S22


@query("latest_by_key", with_tables("""
SELECT sale_id, product_id, sale_price, sale_date, price FROM sales
QUALIFY row_number() OVER (PARTITION BY product_id
                           ORDER BY sale_date DESC, sale_id DESC, sale_price DESC, price DESC) = 1"""))
def q_latest_by_key(spark, d):
    return io.latest_by_key(retail_tables(spark, d).sales, ["product_id"], ["sale_date"])


@query("overrides", with_tables("""
SELECT product_id,
       CASE WHEN product_id = 1 THEN 'Fresh Red Delicious Apple' ELSE product_name END AS product_name,
       CASE WHEN product_id = 1 THEN CAST(0.75 AS DECIMAL(10,2)) ELSE base_price END AS base_price,
       category_id, supplier_id, available, last_update_time
FROM products"""))
def q_overrides(spark, d):
    return io.apply_overrides(retail_tables(spark, d).products, io.overrides_frame(spark, "retail"))


@query("with_vertical", with_tables("SELECT *, 'retail' AS vertical FROM products"))
def q_with_vertical(spark, d):
    return io.with_vertical(retail_tables(spark, d).products, "retail")


# A second vertical over the same ids, with other prices, sales, promotions, stock and cart lines.
_SECURITIES = """
products_s AS (SELECT * REPLACE (CAST(base_price * 2 AS DECIMAL(10,2)) AS base_price) FROM products),
sales_s AS (SELECT * FROM sales WHERE sale_price >= 20000),
promotions_s AS (SELECT * REPLACE (NOT active AS active) FROM promotions),
inventory_s AS (SELECT * FROM inventory WHERE warehouse_id <= 3),
shopping_cart_s AS (SELECT * FROM shopping_cart WHERE price >= 910),
categories_s AS (SELECT * REPLACE (concat_ws(' ', 'Fund', category_name) AS category_name) FROM categories)"""
_SECURITIES_NAMES = {n: f"{n}_s" for n in ("products", "sales", "promotions", "inventory", "shopping_cart",
                                           "categories", "inventory_item")}
_PRICING_S = pricing_over("products_s", "sales_s", "promotions_s", "inventory_s", suffix="_s")
_TOTALS_S = rename(f"{CART},{CATEGORY_TOTALS}", _SECURITIES_NAMES, CART_CTE_NAMES + TOTALS_CTE_NAMES, "_s")


def _both(cte: str, cols: str) -> str:
    return f"SELECT 'retail' AS vertical, {cols} FROM {cte} UNION ALL SELECT 'securities', {cols} FROM {cte}_s"


def _verticals(spark, d):
    """The tables of both verticals, written by vertical and read back."""
    t = retail_tables(spark, d)
    own = {n: getattr(t, n) for n in ("products", "sales", "promotions", "inventory", "shopping_cart", "categories")}
    other = {
        "products": own["products"].withColumn("base_price", (F.col("base_price") * 2).cast("decimal(10,2)")),
        "sales": own["sales"].where("sale_price >= 20000"),
        "promotions": own["promotions"].withColumn("active", ~F.col("active")),
        "inventory": own["inventory"].where("warehouse_id <= 3"),
        "shopping_cart": own["shopping_cart"].where("price >= 910"),
        "categories": own["categories"].withColumn("category_name", F.concat_ws(" ", F.lit("Fund"), "category_name")),
    }
    root = scratch_path(spark, f"verticals-{uuid.uuid4().hex}")
    io.write_verticals(own, root, vertical="retail")
    io.write_verticals(other, root, vertical="securities")
    return io.read_verticals(spark, root, list(own))


def _vertical_items(v):
    return pricing.inventory_item(v["products"], v["sales"], v["promotions"], v["inventory"], by=[io.VERTICAL])


def _vertical_cart(v):
    return cartops.dynamic_cart(v["shopping_cart"], v["products"], v["categories"], _vertical_items(v), v["inventory"],
                                by=[io.VERTICAL])


@query("vertical_items", with_tables(_both("inventory_item", "product_id, live_price, last_update_time"),
                                     PRICING, _SECURITIES, _PRICING_S))
def q_vertical_items(spark, d):
    """One job prices two verticals that share their ids."""
    return _vertical_items(_verticals(spark, d))


@query("vertical_high_demand", with_tables(_both("high_demand", "product_id, avg_sale_price, total_sales"),
                                           PRICING, _SECURITIES, _PRICING_S))
def q_vertical_high_demand(spark, d):
    v = _verticals(spark, d)
    return pricing.high_demand(v["products"], v["sales"], by=[io.VERTICAL])


@query("vertical_category_totals", with_tables(
    _both("category_totals", "category_id, parent_id, has_subcategory, category_name, total, item_count"),
    PRICING, CART, CATEGORY_TOTALS, _SECURITIES, _PRICING_S, _TOTALS_S))
def q_vertical_category_totals(spark, d):
    """Both verticals' carts rolled up, each along its own tree."""
    v = _verticals(spark, d)
    return hierarchy.category_totals(v["categories"], _vertical_cart(v), other_offset=OTHER_OFFSET_FIXTURE, by=[io.VERTICAL])


@query("vertical_reconcile", with_tables("""
SELECT vertical, sum(price)::DECIMAL(38,2) AS cart_total, sum(price)::DECIMAL(38,2) AS categories_total,
       0::DECIMAL(38,2) AS delta
FROM (SELECT 'retail' AS vertical, round(sum(price), 2) AS price FROM dynamic_cart
      UNION ALL SELECT 'securities', round(sum(price), 2) FROM dynamic_cart_s)
WHERE price IS NOT NULL GROUP BY vertical""", PRICING, CART, CATEGORY_TOTALS, _SECURITIES, _PRICING_S, _TOTALS_S))
def q_vertical_reconcile(spark, d):
    v = _verticals(spark, d)
    view = written(_vertical_cart(v), "cart")
    totals = hierarchy.category_totals(v["categories"], view, other_offset=OTHER_OFFSET_FIXTURE, by=[io.VERTICAL])
    return cartops.reconcile_cart(view, totals, by=[io.VERTICAL])


@query("audit_pk", with_tables(
    "SELECT sale_id, COUNT(*) AS n FROM sales GROUP BY sale_id HAVING COUNT(*) > 1"))
def q_audit_pk(spark, d):
    return io.audit_pk(retail_tables(spark, d).sales, ["sale_id"])


def _fk_sql():
    parts = []
    for child, fk, parent, pk in schemas.FOREIGN_KEYS:
        parts.append(f"""SELECT '{child}' AS table_name, '{fk}' AS column_name, c.{fk} AS value, COUNT(*) AS n
FROM {child} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})
GROUP BY c.{fk}""")
    return with_tables("\nUNION ALL\n".join(parts))


def _audited_tables(t):
    return {"products": t.products, "sales": t.sales, "inventory": t.inventory,
            "promotions": t.promotions, "shopping_cart": t.shopping_cart, "categories": t.categories}


@query("audit_fk", _fk_sql())
def q_audit_fk(spark, d):
    tabs = _audited_tables(retail_tables(spark, d))
    out = None
    for child, fk, parent, pk in schemas.FOREIGN_KEYS:
        a = io.audit_fk(tabs[child], fk, tabs[parent], pk, child)
        out = a if out is None else out.unionByName(a)
    return out


@query("audit_fk_orphans", with_tables("""
SELECT 'sales' AS table_name, 'product_id' AS column_name, product_id AS value, count(*) AS n FROM sales
WHERE product_id NOT IN (SELECT product_id FROM products WHERE available) GROUP BY product_id"""))
def q_audit_fk_orphans(spark, d):
    """The same audit where it finds something: sales of products that are not available."""
    t = retail_tables(spark, d)
    return io.audit_fk(t.sales, "product_id", t.products.where("available"), "product_id", "sales")


@query("exclude_ids", with_tables("""
SELECT product_id, category_id FROM products WHERE category_id IS NOT NULL AND category_id NOT IN (101, 1002, 1013)"""))
def q_exclude_ids(spark, d):
    return changes.exclude_ids(retail_tables(spark, d).products.select("product_id", "category_id"),
                               "category_id", [101, 1002, 1013])


@query("insert_new", with_tables("""
SELECT product_id, stock FROM (SELECT product_id, max(stock) AS stock FROM inventory GROUP BY product_id)
UNION ALL SELECT product_id, 0 FROM products WHERE product_id NOT IN (SELECT product_id FROM inventory)"""))
def q_insert_new(spark, d):
    """Products without stock get a row, the others keep theirs."""
    t = retail_tables(spark, d)
    held = t.inventory.groupBy("product_id").agg(F.max("stock").alias("stock"))
    return changes.insert_new(held, t.products.select("product_id", F.lit(0).alias("stock")), ["product_id"])


_NN_TABLES = ("products", "sales", "inventory", "promotions", "shopping_cart", "categories")


def _nn_sql():
    parts = []
    for name in _NN_TABLES:
        for c in schemas.not_null_columns(schemas.SCHEMAS[name]):
            if name == "inventory" and c == "inventory_id":
                continue
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
                         f"COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {name}")
    return with_tables("\nUNION ALL\n".join(parts))


@query("audit_not_null", _nn_sql())
def q_audit_not_null(spark, d):
    tabs = _audited_tables(retail_tables(spark, d))
    out = None
    for name in _NN_TABLES:
        cols = [c for c in schemas.not_null_columns(schemas.SCHEMAS[name]) if c in tabs[name].columns]
        a = io.audit_not_null(tabs[name], cols, name)
        out = a if out is None else out.unionByName(a)
    return out


@query("defaults", with_tables("""
SELECT p.product_id, COALESCE(s.total_stock, 0) AS total_stock
FROM products p LEFT JOIN (SELECT product_id, CAST(SUM(stock) AS BIGINT) AS total_stock
                           FROM inventory GROUP BY product_id) s ON p.product_id = s.product_id"""))
def q_defaults(spark, d):
    t = retail_tables(spark, d)
    joined = t.products.select("product_id").join(pricing.inventory_totals(t.inventory), "product_id", "left")
    return io.with_defaults(joined, {"total_stock": 0})


@query("to_document", priced("""
SELECT product_id,
       CAST(to_json({'product_id': product_id, 'live_price': live_price,
                     'last_update_time': strftime(last_update_time, '%Y-%m-%d %H:%M:%S.%f')}) AS VARCHAR) AS doc
FROM inventory_item"""))
def q_to_document(spark, d):
    return io.to_document(_items(retail_tables(spark, d)), key="product_id")


_KEPT = """kept AS (
  SELECT * FROM products WHERE product_id = 1
  UNION ALL
  SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER (ORDER BY product_id) AS pos
                               FROM products WHERE product_id <> 1) r WHERE pos % 2 = 1
)"""


@query("downsample_products", with_tables("SELECT * FROM kept", _KEPT))
def q_downsample_products(spark, d):
    return datagen.downsample_products(retail_tables(spark, d).products)


@query("downsample_promotions", with_tables(
    "SELECT * FROM promotions WHERE product_id IN (SELECT product_id FROM kept)", _KEPT))
def q_downsample_promotions(spark, d):
    t = retail_tables(spark, d)
    return datagen.downsample_promotions(t.promotions, datagen.downsample_products(t.products))


@query("downsample_inventory", with_tables("""
SELECT inventory_id, product_id, CAST(FLOOR((stock + 1) / 2) AS INTEGER) AS stock, warehouse_id, restock_date
FROM inventory WHERE product_id IN (SELECT product_id FROM kept)""", _KEPT))
def q_downsample_inventory(spark, d):
    t = retail_tables(spark, d)
    return datagen.downsample_inventory(t.inventory, datagen.downsample_products(t.products))


@query("downsample_sales", with_tables("""
SELECT * FROM sales WHERE product_id IN (SELECT product_id FROM kept)
  AND (product_id = 1 OR sale_id % 2 = 0)""", _KEPT))
def q_downsample_sales(spark, d):
    t = retail_tables(spark, d)
    return datagen.downsample_sales(t.sales, datagen.downsample_products(t.products))


_GEN_AS_OF = "TIMESTAMP '2024-01-01 00:00:00'"


def _u(tag):
    return uniform_sql(42, "p.product_id", "r.rnd", tag=tag)


def _cents_sql(tag, units):
    return f"CAST(CAST(floor({_u(tag)} * {units * 100}) AS BIGINT) * 0.01 AS DECIMAL(10,2))"


def _shift_sql(tag, days, sign="-"):
    return f"{_GEN_AS_OF} {sign} to_seconds(CAST(floor({_u(tag)} * {days * 86400}) AS BIGINT))"


def _rounds_sql(rounds, per_round, tag):
    keep = "" if per_round is None else \
        f"WHERE {_u(tag)} * (SELECT COUNT(*) FROM products) < {float(per_round)}"
    return f"FROM products p CROSS JOIN range(1, {rounds + 1}) r(rnd) {keep}"


@query("gen_sales", with_tables(f"""
SELECT p.product_id * 1000000 + r.rnd AS sale_id, p.product_id, {_cents_sql('sp', 800)} AS sale_price,
       {_shift_sql('sd', 365)} AS sale_date, {_cents_sql('p', 1000)} AS price
{_rounds_sql(100, None, 'sales')}"""))
def q_gen_sales(spark, d):
    return datagen.gen_sales(retail_tables(spark, d).products, rounds=100, per_round=None)


@query("gen_promotions", with_tables(f"""
SELECT p.product_id * 1000000 + r.rnd AS promotion_id, p.product_id, {_cents_sql('d', 50)} AS promotion_discount,
       {_shift_sql('s', 30)} AS start_date, {_shift_sql('e', 30, '+')} AS end_date, {_u('a')} < 0.3 AS active,
       {_shift_sql('u', 30)} AS updated_at
{_rounds_sql(5, None, 'promo')}"""))
def q_gen_promotions(spark, d):
    return datagen.gen_promotions(retail_tables(spark, d).products, rounds=5, per_round=None)


@query("gen_inventory", with_tables(f"""
SELECT p.product_id * 1000000 + r.rnd AS inventory_id, p.product_id,
       CAST(floor({_u('st')} * 1001) AS INTEGER) AS stock, CAST(2 + floor({_u('w')} * 5) AS BIGINT) AS warehouse_id,
       {_shift_sql('r', 30)} AS restock_date
{_rounds_sql(5, None, 'inv')}"""))
def q_gen_inventory(spark, d):
    return datagen.gen_inventory(retail_tables(spark, d).products, rounds=5, per_round=None)


# --------------------------------------------------------------------------- M1, C1-C8


AS_OF = "2024-02-01 00:00:00"
_AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
_PRODUCT_COLS = "product_id, product_name, base_price, category_id, supplier_id, available, last_update_time"


@query("apply_changes", with_tables(f"""
WITH latest AS (
  SELECT * FROM product_changes
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC, op DESC) = 1
)
SELECT {_PRODUCT_COLS} FROM products WHERE product_id NOT IN (SELECT product_id FROM product_changes)
UNION ALL
SELECT {_PRODUCT_COLS} FROM latest WHERE op <> 'D'""", CHANGE_FEEDS))
def q_apply_changes(spark, d):
    t = retail_tables(spark, d)
    return changes.apply_changes(t.products, testdata.product_changes(spark, d), ["product_id"])


@query("apply_changes_bag", with_tables("""
SELECT product_id, product_name, category_id, price, ts, CAST(SUM(w) AS BIGINT) AS multiplicity
FROM (SELECT 1 AS w, product_id, product_name, category_id, price, ts FROM shopping_cart
      UNION ALL SELECT w, product_id, product_name, category_id, price, ts FROM cart_changes) u
GROUP BY product_id, product_name, category_id, price, ts HAVING SUM(w) > 0""", CHANGE_FEEDS))
def q_apply_changes_bag(spark, d):
    t = retail_tables(spark, d)
    return changes.apply_changes_bag(t.shopping_cart, testdata.cart_changes(spark, d, t.products))


@query("upsert_log", with_tables("""
SELECT source AS view_name, ts AS last_refresh, latency_ms / 1000.0 AS refresh_duration FROM query_log
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) = 1"""))
def q_upsert_log(spark, d):
    ql = retail_tables(spark, d).query_log
    base = ql.groupBy(F.col("source").alias("view_name")).agg(
        F.min("ts").alias("last_refresh"), F.lit(0.0).alias("refresh_duration"))
    rows = ql.select(F.col("source").alias("view_name"), F.col("ts").alias("last_refresh"),
                     (F.col("latency_ms") / 1000.0).alias("refresh_duration"), "seq")
    return changes.upsert_log(base, rows, seq="seq")


def _toggle_sql(pid_sql):
    return with_tables(f"""
WITH target AS (SELECT {pid_sql} AS pid)
SELECT promotion_id, product_id, promotion_discount, start_date, end_date,
       CASE WHEN product_id = (SELECT pid FROM target) THEN NOT active ELSE active END AS active,
       CASE WHEN product_id = (SELECT pid FROM target) THEN {_AS_OF_SQL} ELSE updated_at END AS updated_at
FROM promotions
UNION ALL
SELECT (SELECT MAX(promotion_id) FROM promotions) + 1, pid, CAST(10 AS DECIMAL(10,2)), {_AS_OF_SQL},
       {_AS_OF_SQL} + INTERVAL 30 DAY, TRUE, {_AS_OF_SQL}
FROM target WHERE NOT EXISTS (SELECT 1 FROM promotions WHERE product_id = pid)""")


@query("toggle_promotion", _toggle_sql("CAST(1 AS BIGINT)"))
def q_toggle_promotion(spark, d):
    t = retail_tables(spark, d)
    return changes.toggle_promotion(t.products, t.promotions, 1, AS_OF)


_NO_PROMO_SQL = "(SELECT MIN(product_id) FROM products WHERE product_id NOT IN (SELECT product_id FROM promotions))"


@query("toggle_promotion_new", _toggle_sql(_NO_PROMO_SQL))
def q_toggle_promotion_new(spark, d):
    t = retail_tables(spark, d)
    # one scalar: the smallest product without any promotion
    pid = (t.products.join(t.promotions.select("product_id"), "product_id", "left_anti")
           .agg(F.min("product_id")).first()[0])
    return changes.toggle_promotion(t.products, t.promotions, pid, AS_OF)


_NEW_PRODUCT = dict(name="Organic Fuji Apple", category_id=101, price="1.99", stock=15)
_ADDED = f"""
new_id AS (SELECT MAX(product_id) + 1 AS id FROM products),
products2 AS (
  SELECT * FROM products UNION ALL
  SELECT (SELECT id FROM new_id), 'Organic Fuji Apple', CAST(1.99 AS DECIMAL(10,2)), CAST(101 AS BIGINT),
         CAST(1 AS BIGINT), TRUE, {_AS_OF_SQL}
),
sales2 AS (
  SELECT * FROM sales UNION ALL
  SELECT (SELECT MAX(sale_id) FROM sales) + 1, (SELECT id FROM new_id), CAST(1.99 AS DECIMAL(18,4)),
         {_AS_OF_SQL}, CAST(1.99 AS DECIMAL(12,2))
),
inventory2 AS (
  SELECT * FROM inventory UNION ALL
  SELECT (SELECT MAX(inventory_id) FROM inventory) + 1, (SELECT id FROM new_id), 15, CAST(1 AS BIGINT),
         {_AS_OF_SQL} + INTERVAL 30 DAY
)"""


@query("add_product", with_tables(
    "SELECT product_id, live_price, last_update_time FROM inventory_item",
    _ADDED, pricing_over(products="products2", sales="sales2", inventory="inventory2")))
def q_add_product(spark, d):
    t = retail_tables(spark, d)
    tabs = {"products": t.products, "sales": t.sales, "inventory": t.inventory,
            "shopping_cart": t.shopping_cart}
    new = changes.add_product(tabs, as_of=AS_OF, **_NEW_PRODUCT)
    return pricing.inventory_item(new["products"], new["sales"], t.promotions, new["inventory"])


_CART_ADD = f"""
added AS (
  SELECT product_id, product_name, category_id, base_price AS price, {_AS_OF_SQL} AS ts FROM products
  WHERE product_id = 1 AND NOT EXISTS (SELECT 1 FROM shopping_cart WHERE product_id = 1)
  UNION ALL
  SELECT product_id, product_name, category_id, base_price, {_AS_OF_SQL} FROM products
  WHERE product_id = (SELECT MIN(product_id) FROM products WHERE product_id <> 1)
),
targets AS (SELECT DISTINCT product_id, 15 AS stock FROM added)"""

_REPLENISHED = f"""
SELECT i.inventory_id, i.product_id, COALESCE(t.stock, i.stock) AS stock, i.warehouse_id,
       CASE WHEN t.stock IS NULL THEN i.restock_date ELSE {_AS_OF_SQL} + INTERVAL 30 DAY END AS restock_date
FROM inventory i LEFT JOIN targets t ON i.product_id = t.product_id
UNION ALL
SELECT (SELECT MAX(inventory_id) FROM inventory) + row_number() OVER (ORDER BY product_id), product_id,
       CAST(stock AS INTEGER), CAST(1 AS BIGINT), {_AS_OF_SQL} + INTERVAL 30 DAY
FROM targets WHERE product_id NOT IN (SELECT product_id FROM inventory)"""


@query("add_to_cart", with_tables(
    "SELECT * FROM shopping_cart UNION ALL SELECT * FROM added", _CART_ADD))
def q_add_to_cart(spark, d):
    t = retail_tables(spark, d)
    cart, _ = changes.add_to_cart(t.shopping_cart, t.products, t.inventory, as_of=AS_OF, stock=15,
                                  smallest=True)
    return cart


@query("add_to_cart_inventory", with_tables(_REPLENISHED, _CART_ADD))
def q_add_to_cart_inventory(spark, d):
    t = retail_tables(spark, d)
    _, inv = changes.add_to_cart(t.shopping_cart, t.products, t.inventory, as_of=AS_OF, stock=15,
                                 smallest=True)
    return inv


@query("replenish", with_tables(_REPLENISHED, """
targets AS (SELECT DISTINCT product_id, CAST(5 + product_id % 21 AS INTEGER) AS stock FROM shopping_cart)"""))
def q_replenish(spark, d):
    t = retail_tables(spark, d)
    tg = t.shopping_cart.select("product_id").distinct().select(
        "product_id", (F.lit(5) + F.col("product_id") % 21).cast("int").alias("stock"))
    return changes.replenish(t.inventory, tg, AS_OF)


@query("cart_delete", with_tables("""
SELECT * FROM shopping_cart
WHERE ts <> (SELECT ts FROM shopping_cart WHERE product_id <> 1 ORDER BY ts, product_id LIMIT 1)"""))
def q_cart_delete(spark, d):
    return changes.cart_delete(retail_tables(spark, d).shopping_cart, smallest=True)


_JITTER_DELTA = "((product_id + stock) % 5 + 1) * CASE WHEN (product_id + stock) % 2 = 0 THEN 1 ELSE -1 END"


_JITTER_SQL = with_tables(f"""
WITH RECURSIVE pairs AS (
  SELECT product_id, stock, {_JITTER_DELTA} AS d,
         row_number() OVER (PARTITION BY product_id ORDER BY stock) AS k
  FROM (SELECT DISTINCT i.product_id, i.stock
        FROM (SELECT DISTINCT product_id FROM shopping_cart) c JOIN inventory i ON c.product_id = i.product_id) x
),
steps(inventory_id, k, s) AS (
  SELECT inventory_id, 0, stock FROM inventory WHERE product_id IN (SELECT product_id FROM pairs)
  UNION ALL
  SELECT st.inventory_id, st.k + 1, GREATEST(0, st.s + p.d)
  FROM steps st JOIN inventory i ON i.inventory_id = st.inventory_id
  JOIN pairs p ON p.product_id = i.product_id AND p.k = st.k + 1
),
final AS (SELECT inventory_id, arg_max(s, k) AS s FROM steps GROUP BY inventory_id)
SELECT i.inventory_id, i.product_id, CAST(COALESCE(f.s, i.stock) AS INTEGER) AS stock, i.warehouse_id, i.restock_date
FROM inventory i LEFT JOIN final f ON i.inventory_id = f.inventory_id""")


def _jitter_delta():
    return (((F.col("product_id") + F.col("stock")) % 5 + 1)
            * F.when((F.col("product_id") + F.col("stock")) % 2 == 0, 1).otherwise(-1))


@query("stock_jitter", _JITTER_SQL)
def q_stock_jitter(spark, d):
    t = retail_tables(spark, d)
    return changes.stock_jitter(t.shopping_cart, t.inventory, delta=_jitter_delta())


_TOUCH_SQL = with_tables(f"""
SELECT product_id, product_name, base_price, category_id, supplier_id, available,
       CASE WHEN product_id = 1 THEN {_AS_OF_SQL} ELSE last_update_time END AS last_update_time
FROM products""")


@query("touch", _TOUCH_SQL)
def q_touch(spark, d):
    return changes.touch(retail_tables(spark, d).products, [1], AS_OF)


# --------------------------------------------------------------------------- C2-C8 as change rows, folded into their tables

@query("toggle_promotion_rows", _toggle_sql("CAST(1 AS BIGINT)"))
def q_toggle_promotion_rows(spark, d):
    t = retail_tables(spark, d)
    return change_rows.folded(t.promotions, change_rows.toggle_promotion(t.products, t.promotions, 1, AS_OF))


@query("replenish_rows", with_tables(_REPLENISHED, """
targets AS (SELECT DISTINCT product_id, CAST(5 + product_id % 21 AS INTEGER) AS stock FROM shopping_cart)"""))
def q_replenish_rows(spark, d):
    t = retail_tables(spark, d)
    wanted = t.shopping_cart.select("product_id").distinct().withColumn("stock", F.lit(5) + F.col("product_id") % 21)
    return change_rows.folded(t.inventory, change_rows.replenish(t.inventory, wanted, AS_OF))


@query("add_to_cart_rows", with_tables("SELECT * FROM shopping_cart UNION ALL SELECT * FROM added", _CART_ADD))
def q_add_to_cart_rows(spark, d):
    t = retail_tables(spark, d)
    rows = change_rows.add_to_cart(t.shopping_cart, t.products, t.inventory, as_of=AS_OF, stock=15, smallest=True)
    return change_rows.folded(t.shopping_cart, rows["shopping_cart"])


@query("cart_delete_rows", with_tables("""
SELECT * FROM shopping_cart
WHERE ts <> (SELECT ts FROM shopping_cart WHERE product_id <> 1 ORDER BY ts, product_id LIMIT 1)"""))
def q_cart_delete_rows(spark, d):
    cart = retail_tables(spark, d).shopping_cart
    return change_rows.folded(cart, change_rows.cart_delete(cart, smallest=True))


@query("stock_jitter_rows", _JITTER_SQL)
def q_stock_jitter_rows(spark, d):
    t = retail_tables(spark, d)
    return change_rows.folded(t.inventory, change_rows.stock_jitter(t.shopping_cart, t.inventory, _jitter_delta()))


@query("touch_rows", _TOUCH_SQL)
def q_touch_rows(spark, d):
    products = retail_tables(spark, d).products
    return change_rows.folded(products, change_rows.touch(products, [1], AS_OF))


@query("add_product_rows", with_tables("SELECT * FROM products2", _ADDED))
def q_add_product_rows(spark, d):
    t = retail_tables(spark, d)
    tabs = {"products": t.products, "sales": t.sales, "inventory": t.inventory, "shopping_cart": t.shopping_cart}
    return change_rows.folded(t.products, change_rows.add_product(tabs, as_of=AS_OF, **_NEW_PRODUCT)["products"])


# --------------------------------------------------------------------------- M4-M19, W6-W11, A20-A21, D10


@query("latency_stats", with_tables("""
SELECT source, COUNT(*) AS n, MAX(latency_ms) AS max_ms,
       CAST(SUM(CAST(latency_ms AS DECIMAL(38,2))) AS DOUBLE) / COUNT(*) AS mean_ms,
       CASE WHEN COUNT(*) >= 100 THEN list_sort(list(latency_ms))[(COUNT(*) * 99) // 100 + 1]
            ELSE MAX(latency_ms) END AS p99_ms
FROM query_log GROUP BY source"""))
def q_latency_stats(spark, d):
    return metrics.latency_stats(retail_tables(spark, d).query_log, decimals=2)


@query("latency_stats_last100", with_tables("""
WITH last AS (SELECT * FROM query_log
              QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) <= 100)
SELECT source, COUNT(*) AS n, MAX(latency_ms) AS max_ms,
       CAST(SUM(CAST(latency_ms AS DECIMAL(38,2))) AS DOUBLE) / COUNT(*) AS mean_ms,
       CASE WHEN COUNT(*) >= 100 THEN list_sort(list(latency_ms))[(COUNT(*) * 99) // 100 + 1]
            ELSE MAX(latency_ms) END AS p99_ms
FROM last GROUP BY source"""))
def q_latency_stats_last100(spark, d):
    return metrics.latency_stats(retail_tables(spark, d).query_log, cap=100, decimals=2)


@query("latency_median", with_tables("""
SELECT source, COUNT(*) AS n,
       (list_sort(list(latency_ms))[(COUNT(*) + 1) // 2] + list_sort(list(latency_ms))[COUNT(*) // 2 + 1]) / 2
         AS median
FROM query_log GROUP BY source"""))
def q_latency_median(spark, d):
    return metrics.median_by(retail_tables(spark, d).query_log, ["source"], "latency_ms")


@query("rolling_qps", with_tables("""
SELECT seq, ts, source, latency_ms, product_id, n_window, n_window / 1.0 AS qps
FROM (SELECT *, COUNT(*) OVER (PARTITION BY source ORDER BY ts
                               RANGE BETWEEN INTERVAL 1 SECOND PRECEDING AND CURRENT ROW) AS n_window
      FROM query_log) q"""))
def q_rolling_qps(spark, d):
    return metrics.rolling_qps(retail_tables(spark, d).query_log)


@query("rolling_qps_minute", with_tables("""
SELECT seq, ts, source, latency_ms, product_id, n_window, n_window / 60.0 AS qps
FROM (SELECT *, COUNT(*) OVER (PARTITION BY source ORDER BY ts
                               RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n_window
      FROM query_log) q"""))
def q_rolling_qps_minute(spark, d):
    # a wider window, so that windows really hold several queries at this event rate
    return metrics.rolling_qps(retail_tables(spark, d).query_log, window_s=60.0)


@query("last_100", with_tables(
    "SELECT * FROM query_log QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) <= 100"))
def q_last_100(spark, d):
    return metrics.last_n(retail_tables(spark, d).query_log, ["source"], ["ts", "seq"], 100)


@query("history_window", with_tables(
    "SELECT * FROM query_log WHERE ts >= (SELECT MAX(ts) FROM query_log) - INTERVAL 3 MINUTE"))
def q_history_window(spark, d):
    return metrics.history_window(retail_tables(spark, d).query_log)


@query("history_window_day", with_tables(
    "SELECT * FROM query_log WHERE ts >= (SELECT MAX(ts) FROM query_log) - INTERVAL 1 DAY"))
def q_history_window_day(spark, d):
    return metrics.history_window(retail_tables(spark, d).query_log, span="1 day")


def _priced_log(t):
    # a reading that took over 100 ms timed out and returned no price
    return t.query_log.withColumn("price", F.when(F.col("latency_ms") <= 100, F.col("latency_ms")))


_PRICED_LOG = "priced_log AS (SELECT *, CASE WHEN latency_ms <= 100 THEN latency_ms END AS price FROM query_log)"


@query("price_carry_forward", with_tables("""
SELECT seq, ts, source, latency_ms, product_id, price,
       last_value(price IGNORE NULLS) OVER (PARTITION BY source ORDER BY ts, seq
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_price
FROM priced_log""", _PRICED_LOG))
def q_price_carry_forward(spark, d):
    return metrics.carry_forward(_priced_log(retail_tables(spark, d)), ["source"], "ts", "price",
                                 "carried_price", tie=["seq"])


@query("price_changed", with_tables("""
SELECT seq, ts, source, latency_ms, product_id, price,
       price IS DISTINCT FROM lag(price) OVER (PARTITION BY source ORDER BY ts, seq) AS changed
FROM (SELECT *, CAST(FLOOR(latency_ms / 50) AS BIGINT) AS price FROM query_log) q"""))
def q_price_changed(spark, d):
    log = retail_tables(spark, d).query_log.withColumn("price", F.floor(F.col("latency_ms") / 50).cast("bigint"))
    return metrics.price_changed(log)


@query("held_qps", with_tables("""
WITH q AS (
  SELECT seq, ts, source, COUNT(*) OVER (PARTITION BY source ORDER BY ts
                                         RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) - 1 AS qps
  FROM query_log)
SELECT seq, ts, source, qps,
       COALESCE(last_value(CASE WHEN qps > 0 THEN qps END IGNORE NULLS)
                  OVER (PARTITION BY source ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                qps) AS held_qps
FROM q"""))
def q_held_qps(spark, d):
    q = metrics.rolling_qps(retail_tables(spark, d).query_log, window_s=60.0)
    series = q.select("seq", "ts", "source", (F.col("n_window") - 1).alias("qps"))
    return metrics.held_qps(series)


@query("skip_warmup", with_tables(
    "SELECT * FROM query_log QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts, seq) > 1"))
def q_skip_warmup(spark, d):
    return metrics.skip_warmup(retail_tables(spark, d).query_log)


def _refresh_log(t):
    ql = t.query_log
    return ql.select(F.col("source").alias("view_name"), F.col("ts").alias("last_refresh"),
                     (F.col("latency_ms") / 1000.0).alias("refresh_duration"))


@query("refresh_age", with_tables(f"""
SELECT view_name,
       (epoch_us({_AS_OF_SQL}) - epoch_us(last_refresh)) / 1e6 AS age_s,
       refresh_duration,
       (epoch_us({_AS_OF_SQL}) - epoch_us(last_refresh)) / 1e6 + refresh_duration AS data_age_s
FROM (SELECT source AS view_name, ts AS last_refresh, latency_ms / 1000.0 AS refresh_duration FROM query_log
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, latency_ms DESC) = 1) r"""))
def q_refresh_age(spark, d):
    return metrics.refresh_age(_refresh_log(retail_tables(spark, d)), AS_OF)


@query("heartbeat_lag", with_tables(f"""
WITH s AS (SELECT id AS source_id, ts AS source_ts FROM heartbeats ORDER BY id DESC, ts DESC LIMIT 1),
     r AS (SELECT id AS replica_id, ts AS replica_ts FROM replica_heartbeats ORDER BY ts DESC, id DESC LIMIT 1)
SELECT source_id, replica_id, source_ts, replica_ts,
       CASE WHEN source_id > replica_id THEN GREATEST(0.0,
            (epoch_us(source_ts) - epoch_us(replica_ts)) / 1e6 + (epoch_us({_AS_OF_SQL}) - epoch_us(source_ts)) / 1e6)
            ELSE 0.0 END AS lag_s
FROM s, r"""))
def q_heartbeat_lag(spark, d):
    t = retail_tables(spark, d)
    return metrics.heartbeat_lag(t.heartbeats, t.replica_heartbeats, AS_OF)


@query("reaction_time", with_tables("""
SELECT q.seq, q.source, q.ts, q.product_id, (epoch_us(q.ts) - epoch_us(p.last_update_time)) / 1e3 AS end_to_end_ms
FROM query_log q JOIN products p ON q.product_id = p.product_id"""))
def q_reaction_time(spark, d):
    t = retail_tables(spark, d)
    return metrics.reaction_time(t.query_log, t.products)


_LATEST_READING = """latest AS (
  SELECT source, ts AS last_ts, latency_ms, (SELECT MAX(ts) FROM query_log) AS now_ts FROM query_log
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) = 1
)"""


def _latest_reading(t):
    ql = t.query_log
    now = ql.agg(F.max("ts").alias("now_ts"))
    last = ql.groupBy("source").agg(F.max_by(F.struct("ts", "latency_ms"), F.struct("ts", "seq")).alias("_l"))
    return last.select("source", F.col("_l.ts").alias("last_ts"), F.col("_l.latency_ms").alias("latency_ms")) \
        .crossJoin(F.broadcast(now))


@query("gate_stale", with_tables("""
SELECT source, last_ts, CASE WHEN (epoch_us(now_ts) - epoch_us(last_ts)) / 1e6 <= 1500.0 THEN latency_ms END
       AS latency_ms, now_ts
FROM latest""", _LATEST_READING))
def q_gate_stale(spark, d):
    # 25 minutes instead of two seconds: the event log is sparse, and some sources are older
    return metrics.gate_stale(_latest_reading(retail_tables(spark, d)), F.col("now_ts"), "last_ts",
                              ["latency_ms"], limit_s=1500.0)


@query("lag_band", with_tables("""
SELECT source, lag_s, CASE WHEN lag_s IS NULL THEN 'Unknown' WHEN lag_s < 1 THEN 'Low'
                           WHEN lag_s < 5 THEN 'Medium' ELSE 'High' END AS lag_band
FROM (SELECT source, (epoch_us(now_ts) - epoch_us(last_ts)) / 1e6 AS lag_s FROM latest) l""", _LATEST_READING))
def q_lag_band(spark, d):
    lr = _latest_reading(retail_tables(spark, d))
    lag = lr.select("source", factors.seconds_between(F.col("now_ts"), F.col("last_ts")).alias("lag_s"))
    return metrics.with_lag_band(lag, "lag_s")


@query("extrapolate_age", with_tables(f"""
WITH e AS (
  SELECT q.source, q.ts, (epoch_us(q.ts) - epoch_us(p.last_update_time)) / 1e3 AS end_to_end_ms
  FROM query_log q JOIN products p ON q.product_id = p.product_id
  QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY q.ts DESC, q.seq DESC) = 1)
SELECT source, CASE WHEN source < 'd' THEN end_to_end_ms END AS age, end_to_end_ms AS last_age, ts AS last_ts,
       coalesce(age, end_to_end_ms + (epoch_us({_AS_OF_SQL}) - epoch_us(ts)) / 1e3) AS age_ms
FROM e"""))
def q_extrapolate_age(spark, d):
    t = retail_tables(spark, d)
    rt = metrics.reaction_time(t.query_log, t.products)
    last = rt.groupBy("source").agg(F.max_by(F.struct("ts", "end_to_end_ms"), F.struct("ts", "seq")).alias("_l"))
    df = last.select("source", F.when(F.col("source") < "d", F.col("_l.end_to_end_ms")).alias("age"),
                     F.col("_l.end_to_end_ms").alias("last_age"), F.col("_l.ts").alias("last_ts"))
    return metrics.extrapolate_age(df, AS_OF, "age", "last_age", "last_ts")


def _samples(t):
    return t.query_log.select(F.col("source").alias("service"), "ts", "seq",
                              F.col("latency_ms").alias("cpu_pct"), (F.col("latency_ms") / 2).alias("memory_pct"))


def _res_sql(m):
    return f"""SELECT service, arg_max({m}, (ts, seq)) AS {m}_last, MAX({m}) AS {m}_max,
       CAST(SUM(CAST({m} AS DECIMAL(38,3))) AS DOUBLE) / COUNT({m}) AS {m}_mean,
       CASE WHEN COUNT({m}) >= 100 THEN list_sort(list({m}))[(COUNT({m}) * 99) // 100 + 1] ELSE MAX({m}) END AS {m}_p99
FROM samples GROUP BY service"""


_RESOURCES = f"""
WITH samples AS (SELECT source AS service, ts, seq, latency_ms AS cpu_pct, latency_ms / 2 AS memory_pct FROM query_log),
c AS ({_res_sql('cpu_pct')}), m AS ({_res_sql('memory_pct')})"""


@query("resource_stats", with_tables(f"{_RESOURCES} SELECT * FROM c JOIN m USING (service)"))
def q_resource_stats(spark, d):
    return metrics.resource_stats(_samples(retail_tables(spark, d)), order=["ts", "seq"], decimals=3)


_RES_COLS = [f"{m}_{s}" for m in ("cpu_pct", "memory_pct") for s in ("last", "max", "mean", "p99")]


@query("resource_stats_gated", with_tables(f"""{_RESOURCES},
seen AS (SELECT service, max(ts) AS last_ts, (SELECT max(ts) FROM samples) AS now FROM samples GROUP BY service)
SELECT service, last_ts, {", ".join(f"if(epoch_us(now) - epoch_us(last_ts) <= 1500e6, {c}, NULL) AS {c}" for c in _RES_COLS)}
FROM c JOIN m USING (service) JOIN seen USING (service)"""))
def q_resource_stats_gated(spark, d):
    samples = _samples(retail_tables(spark, d))
    now = samples.agg(F.max("ts")).first()[0]
    return metrics.resource_stats(samples, order=["ts", "seq"], decimals=3, as_of=now, limit_s=1500.0)


@query("memory_gb", with_tables("""
SELECT source AS service, ts, seq, latency_ms AS cpu_pct, latency_ms / 2 AS memory_pct,
       latency_ms / 2 / 100.0 * n AS memory_gb
FROM query_log LEFT JOIN (SELECT event AS source, n FROM (VALUES ('view', 4.0::DOUBLE), ('click', 8.0)) v(event, n)) USING (source)"""))
def q_memory_gb(spark, d):
    limits = spark.createDataFrame([("view", 4.0), ("click", 8.0)], "service string, limit_gb double")
    return metrics.to_gb(_samples(retail_tables(spark, d)), limits)


@query("any_failed", with_tables("""
SELECT count(*) > 0 AS any_failed FROM query_log WHERE source IN ('error', 'click') AND latency_ms > 99"""))
def q_any_failed(spark, d):
    status = retail_tables(spark, d).query_log.select("source", (F.col("latency_ms") > 99).alias("failed"))
    wanted = spark.createDataFrame([("error",), ("click",)], "source string")
    return metrics.any_failed(status, wanted)


@query("hydrated", carted("SELECT bool_and(price IS NOT NULL) AS hydrated FROM dynamic_cart"))
def q_hydrated(spark, d):
    c = _cart(retail_tables(spark, d))
    return metrics.is_hydrated(c.select(F.col("price").isNotNull().alias("hydrated")))


@query("hydrated_not", carted("SELECT bool_and(price < 1000) AS hydrated FROM dynamic_cart"))
def q_hydrated_not(spark, d):
    c = _cart(retail_tables(spark, d))
    return metrics.is_hydrated(c.select((F.col("price") < 1000).alias("hydrated")))


def _stat_sql(value, scale, prefix):
    """max, mean and p99 (the max below 100 values) of a column, as three output columns."""
    return f"""max({value}) AS {prefix}max, sum({value}::DECIMAL(38,{scale}))::DOUBLE / count({value}) AS {prefix}mean,
       if(count({value}) < 100, max({value}), list_sort(list({value}))[count({value}) * 99 // 100 + 1]) AS {prefix}p99"""


# Ages at which the sparse event log has fresh and stale sources, and a window with more than 100 readings.
_SNAP = {"batch_source": "click", "live_source": "view", "window_s": 172800.0, "limit_s": 1500.0}


_SNAPSHOT_SQL = f"""
WITH base AS (SELECT * FROM query_log QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts, seq) > 1),
reads AS (
  SELECT base.*, (epoch_us(ts) - epoch_us(last_update_time)) / 1e3 AS ms, live_price,
         row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS back
  FROM base JOIN inventory_item USING (product_id)),
windowed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS back FROM base
  QUALIFY ts >= max(ts) OVER (PARTITION BY source) - INTERVAL 172800 SECOND),
lat AS (
  SELECT source, max(ts) AS last_ts, arg_max(latency_ms, (ts, seq)) AS latency_ms, count(*) AS n,
         {_stat_sql('latency_ms', 2, 'l_')} FROM windowed WHERE back <= 100 GROUP BY source),
qps AS (SELECT source, count(*) / 172800.0 AS qps FROM windowed GROUP BY source),
e2e AS (SELECT source, arg_max(ms, (ts, seq)) AS end_to_end_ms, {_stat_sql('ms', 3, 'e2e_')} FROM reads
        WHERE back <= 100 GROUP BY source),
prices AS (SELECT source, arg_max(live_price, (ts, seq)) AS price FROM reads WHERE live_price IS NOT NULL GROUP BY source),
runs AS (
  SELECT source, arg_max(latency_ms / 1000.0, (ts, latency_ms)) AS refresh_duration, max(ts) AS refreshed,
         {_stat_sql('latency_ms / 1000.0', 5, 'refresh_')} FROM query_log WHERE source = 'click' GROUP BY source),
lag AS (
  SELECT 'view' AS source, if(max(h.id) > arg_max(r.id, r.ts), (epoch_us(now) - epoch_us(max(r.ts))) / 1e6, 0.0) AS lag_s
  FROM heartbeats h, replica_heartbeats r, (SELECT max(ts) AS now FROM query_log) GROUP BY now),
joined AS (
  SELECT *, max(last_ts) OVER () AS now FROM lat LEFT JOIN qps USING (source) LEFT JOIN e2e USING (source)
  LEFT JOIN prices USING (source) LEFT JOIN runs USING (source) LEFT JOIN lag USING (source))
SELECT source, last_ts, {", ".join(f"if(epoch_us(now) - epoch_us(last_ts) <= 1500e6, {v}, NULL) AS {n}" for n, v in (
    ("latency_ms", "latency_ms"), ("n", "n"), ("max_ms", "l_max"), ("mean_ms", "l_mean"), ("p99_ms", "l_p99"),
    ("qps", "qps"), ("end_to_end_ms", "end_to_end_ms"), ("e2e_max", "e2e_max"), ("e2e_mean", "e2e_mean"),
    ("e2e_p99", "e2e_p99"), ("price", "price"),
    ("refresh_age_s", "(epoch_us(now) - epoch_us(refreshed)) / 1e6"), ("refresh_duration", "refresh_duration"),
    ("refresh_max", "refresh_max"), ("refresh_mean", "refresh_mean"), ("refresh_p99", "refresh_p99"),
    ("lag_s", "lag_s")))}
FROM joined"""


@query("metrics_snapshot", priced(_SNAPSHOT_SQL))
def q_metrics_snapshot(spark, d):
    t = retail_tables(spark, d)
    now = t.query_log.agg(F.max("ts")).first()[0]
    return metrics.metrics_snapshot(t.query_log, _items(t), _refresh_log(t), t.heartbeats, t.replica_heartbeats, now,
                                    decimals=2, **_SNAP)


@query("compare_sources", with_tables("""
SELECT COALESCE(v.product_id, b.product_id, l.product_id) AS product_id,
       v.live_price AS view_price, b.live_price_ds AS batch_price, l.live_price_new AS live_price,
       b.live_price_ds - v.live_price AS batch_diff, l.live_price_new - v.live_price AS live_diff
FROM inventory_item v
FULL JOIN (SELECT product_id, live_price AS live_price_ds FROM inventory_item_ds) b ON v.product_id = b.product_id
FULL JOIN (SELECT product_id, live_price AS live_price_new FROM inventory_item_new) l
  ON COALESCE(v.product_id, b.product_id) = l.product_id""",
    PRICING, _KEPT,
    """kept_promotions AS (SELECT * FROM promotions WHERE product_id IN (SELECT product_id FROM kept)),
kept_inventory AS (SELECT inventory_id, product_id, CAST(FLOOR((stock + 1) / 2) AS INTEGER) AS stock, warehouse_id,
                          restock_date FROM inventory WHERE product_id IN (SELECT product_id FROM kept)),
kept_sales AS (SELECT * FROM sales WHERE product_id IN (SELECT product_id FROM kept)
               AND (product_id = 1 OR sale_id % 2 = 0))""",
    pricing_over("kept", "kept_sales", "kept_promotions", "kept_inventory", suffix="_ds"),
    _ADDED, pricing_over(products="products2", sales="sales2", inventory="inventory2", suffix="_new")))
def q_compare_sources(spark, d):
    t = retail_tables(spark, d)
    view = _items(t)
    ds = datagen.downsample({"products": t.products, "sales": t.sales, "promotions": t.promotions,
                             "inventory": t.inventory})
    batch = pricing.inventory_item(ds["products"], ds["sales"], ds["promotions"], ds["inventory"])
    new = changes.add_product({"products": t.products, "sales": t.sales, "inventory": t.inventory,
                               "shopping_cart": t.shopping_cart}, as_of=AS_OF, **_NEW_PRODUCT)
    live = pricing.inventory_item(new["products"], new["sales"], t.promotions, new["inventory"])
    return metrics.compare_sources(view, batch, live)


def _as_of_sql(role, source):
    return f"""ASOF LEFT JOIN (SELECT ts AS at, arg_max(latency_ms, seq) AS v FROM query_log WHERE source = '{source}' GROUP BY ts) {role}
  ON h.ts >= {role}.at"""


@query("compare_sources_latency", with_tables(f"""
SELECT h.id, h.ts, vw.v AS view_latency_ms, bt.v AS batch_latency_ms, lv.v AS live_latency_ms,
       date_diff('microsecond', vw.at, h.ts) / 1e6 AS view_age_s, date_diff('microsecond', bt.at, h.ts) / 1e6 AS batch_age_s,
       date_diff('microsecond', lv.at, h.ts) / 1e6 AS live_age_s,
       bt.v - vw.v AS batch_diff_ms, lv.v - vw.v AS live_diff_ms
FROM heartbeats h {_as_of_sql("vw", "view")} {_as_of_sql("bt", "purchase")} {_as_of_sql("lv", "click")}"""))
def q_compare_sources_latency(spark, d):
    """D10, latency half: what each of three logs read last at every heartbeat."""
    t = retail_tables(spark, d)
    return metrics.compare_latency(t.heartbeats, t.query_log, "view", "purchase", "click")


@query("register_views", with_tables("""
SELECT c.category_name, COUNT(*) AS n, SUM(p.base_price)::DECIMAL(20,2) AS base_price
FROM products p JOIN categories c ON c.category_id = p.category_id GROUP BY c.category_name"""))
def q_register_views(spark, d):
    """Plain SQL over the tables by name."""
    t = retail_tables(spark, d)
    io.register_views({"products": t.products, "categories": t.categories})
    return spark.sql("SELECT c.category_name, COUNT(*) AS n, SUM(p.base_price) AS base_price "
                     "FROM products p JOIN categories c ON c.category_id = p.category_id GROUP BY c.category_name")


_STATISTICS_COLS = ("sale_id", "product_id", "price", "sale_price")


@query("column_statistics", with_tables(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, MIN({c})::VARCHAR AS minimum, MAX({c})::VARCHAR AS maximum, "
    f"COUNT(*) - COUNT({c}) AS nulls FROM sales" for c in _STATISTICS_COLS)))
def q_column_statistics(spark, d):
    """What ANALYZE finds out about the whole sales table."""
    name = f"sales_{uuid.uuid4().hex}"
    retail_tables(spark, d).sales.write.option("path", scratch_path(spark, name)).saveAsTable(name)
    try:
        io.analyze(spark, name, _STATISTICS_COLS)
        return io.column_statistics(spark, name, _STATISTICS_COLS)
    finally:
        spark.sql(f"DROP TABLE {name}")


# --------------------------------------------------------------------------- D2, D3, M2, M3, M5


# --------------------------------------------------------------------------- loading, change images, picks

_PROMO_COLS = "promotion_id, product_id, promotion_discount, start_date, end_date, active, updated_at"


@query("csv_round_trip", with_tables(f"SELECT {_PROMO_COLS} FROM promotions"))
def q_csv_round_trip(spark, d):
    """The promotions written as CSV with a header and read back with declared types."""
    path = _scratch(spark, "csv")
    (retail_tables(spark, d).promotions.write.option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return io.read_table(spark, "promotions", path)


@query("csv_chunks_ingested", with_tables("SELECT sale_id, product_id, sale_price, sale_date, price FROM sales"))
def q_csv_chunks_ingested(spark, d):
    """Sales as CSV chunk files, ingested as a stream into a typed table."""
    root = _scratch(spark, "chunks")
    (retail_tables(spark, d).sales.write.option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{root}/csv"))
    io.ingest_chunks(spark, "sales", f"{root}/csv", f"{root}/out", f"{root}/ckpt",
                     max_files_per_trigger=1000).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("change_images", with_tables("""
SELECT -1 AS w, product_id, base_price, available FROM products WHERE product_id % 3 < 2
UNION ALL
SELECT 1, product_id, CASE WHEN product_id % 3 = 0 THEN (base_price + 1)::DECIMAL(10,2) ELSE base_price END, available
FROM products WHERE product_id % 3 <> 1"""))
def q_change_images(spark, d):
    """Before and after images (a third updates, deletes, inserts) as signed rows."""
    row = F.struct("product_id", "base_price", "available")
    raised = F.struct("product_id", (F.col("base_price") + 1).cast("decimal(10,2)").alias("base_price"), "available")
    kind = F.col("product_id") % 3
    images = retail_tables(spark, d).products.select(
        F.when(kind == 0, "U").when(kind == 1, "D").otherwise("I").alias("op"), F.col("product_id").alias("seq"),
        F.when(kind < 2, row).alias("before"), F.when(kind == 0, raised).when(kind == 2, row).alias("after"))
    return changes.weighted(images)


@query("parse_ids", with_tables("""
SELECT seq, unnest(list_transform(list_filter(list_transform(
         string_split(concat(product_id, ' , x', seq, ',', seq, ',,', latency_ms), ','), lambda x: trim(x)),
         lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::BIGINT)) AS id
FROM query_log"""))
def q_parse_ids(spark, d):
    log = retail_tables(spark, d).query_log
    text = F.concat(F.col("product_id").cast("string"), F.lit(" , x"), F.col("seq").cast("string"), F.lit(","),
                    F.col("seq").cast("string"), F.lit(",,"), F.col("latency_ms").cast("string"))
    return log.select("seq", F.explode(factors.parse_ids(text)).alias("id"))


@query("random_row", with_tables(f"""
SELECT product_id, product_name FROM products ORDER BY {uniform_sql(7, "product_id", tag="pick")}, product_id LIMIT 1"""))
def q_random_row(spark, d):
    return random_row(retail_tables(spark, d).products.select("product_id", "product_name"), 7, ["product_id"])


@query("sample_n", with_tables(f"""
SELECT product_id, product_name FROM products ORDER BY {uniform_sql(7, "product_id", tag="sample")}, product_id LIMIT 50"""))
def q_sample_n(spark, d):
    return sample_n(retail_tables(spark, d).products.select("product_id", "product_name"), 50, 7, ["product_id"])


@query("popularity_band", priced("""
SELECT product_id, popularity_rank, CASE WHEN popularity_rank > 10 THEN 0.9::DOUBLE WHEN popularity_rank > 3 THEN 1.1
       ELSE 1.2 END AS band FROM popularity_score"""))
def q_popularity_band(spark, d):
    """Bands of an explicit rank (the price itself uses thresholds)."""
    t = retail_tables(spark, d)
    ranked = pricing.popularity_score(t.sales, t.products)
    return ranked.select("product_id", "popularity_rank",
                         factors.band("popularity_rank", factors.POPULARITY_BANDS, factors.POPULARITY_OTHERWISE).alias("band"))


@query("append", with_tables("""
SELECT sale_id, product_id FROM sales UNION ALL SELECT sale_id, product_id FROM sales WHERE product_id % 2 = 0"""))
def q_append(spark, d):
    sales = retail_tables(spark, d).sales.select("sale_id", "product_id")
    return io.append(sales, sales.where("product_id % 2 = 0"))


def _scratch(spark, what):
    return scratch_path(spark, f"{what}-{uuid.uuid4().hex}")


def _refreshed(spark, d):
    t = retail_tables(spark, d)
    root = _scratch(spark, "refresh")
    mt.refresh_inventory_item(spark, {"products": t.products, "sales": t.sales, "promotions": t.promotions,
                                      "inventory": t.inventory}, root, as_of=AS_OF)
    return mt.refreshed(spark, root)


@query("refresh_inventory_item", priced("SELECT product_id, live_price, last_update_time FROM inventory_item"))
def q_refresh_inventory_item(spark, d):
    return _refreshed(spark, d)


@query("price_point_refreshed", priced(
    "SELECT product_id, live_price AS price FROM inventory_item WHERE product_id = 1"))
def q_price_point_refreshed(spark, d):
    """E1 against the batch path: refresh the serving copy, then a point lookup on it."""
    return pricing.price_of(_refreshed(spark, d), 1)


@query("stream_refresh_loop", priced("SELECT product_id, live_price, last_update_time FROM inventory_item"))
def q_refresh_loop(spark, d):
    """A loop of refreshes, the first of them before any promotion is there; what a later one has stored."""
    t = retail_tables(spark, d)
    root, calls = _scratch(spark, "refresh-loop"), []

    def tables():
        calls.append(1)
        return {"products": t.products, "sales": t.sales, "inventory": t.inventory,
                "promotions": t.promotions if len(calls) > 1 else t.promotions.where("false")}

    loop = mt.refresh_loop(spark, tables, root, interval="1 second")
    try:
        while not mt.refresh_log(spark, root).where("copy > 0").head(1):
            if loop.awaitTermination(1):            # raises what the loop failed with
                raise RuntimeError("the refresh loop ended")
    finally:
        loop.stop()
    return mt.refreshed(spark, root)


def _streamed(spark, d, feed, snapshot):
    """A maintainer that has loaded ``snapshot`` and folded ``feed``, a tenth of it delivered twice, in several batches."""
    root = _scratch(spark, "stream")
    feed.write.parquet(f"{root}/feed")
    sent = spark.read.schema(feed.schema).parquet(f"{root}/feed")
    # read from what was written, not computed again; as many files as the feed's, so none is larger
    again = sent.where(F.pmod(F.xxhash64("change_id"), F.lit(10)) == 0)
    again.repartition(max(1, len(sent.inputFiles()))).write.mode("append").parquet(f"{root}/feed")
    files = len(spark.read.parquet(f"{root}/feed").inputFiles())
    keeper = mt.Maintainer(spark, f"{root}/kept")
    keeper.load(snapshot)
    q = keeper.start(f"{root}/feed", max_files_per_trigger=files // 4 + 1)
    q.awaitTermination()
    LAST_STREAM_PROGRESS[:] = [dict(p) for p in q.recentProgress]
    return keeper


def _snapshot(t, *names):
    return {n: getattr(t, n) for n in ("products", "sales", "promotions", "inventory", *names)}


def _stream_with_cart(spark, d):
    """Product changes and cart changes over the snapshot."""
    t = retail_tables(spark, d)
    # the bounds, the counts of ranges and the rows are read from the lines, not joined three times
    lines = written(testdata.cart_change_lines(spark, d, t.products), "cart-changes")
    feed = mt.encode_rows(testdata.product_changes(spark, d), "products", t.products.columns).unionByName(
        mt.encode_signed(global_position(lines, ["order_id", "line"]),
                         "shopping_cart", t.shopping_cart.columns, "position"))
    return t, _streamed(spark, d, feed, _snapshot(t, "shopping_cart"))


_STREAMED = f"""
products_cur AS (
  SELECT {_PRODUCT_COLS} FROM products WHERE product_id NOT IN (SELECT product_id FROM product_changes)
  UNION ALL
  SELECT {_PRODUCT_COLS} FROM (SELECT * FROM product_changes
                               QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC, op DESC) = 1) l
  WHERE op <> 'D'
),
cart_bag AS (
  SELECT product_id, product_name, category_id, price, ts, SUM(w) AS m
  FROM (SELECT 1 AS w, product_id, product_name, category_id, price, ts FROM shopping_cart
        UNION ALL SELECT w, product_id, product_name, category_id, price, ts FROM cart_changes) u
  GROUP BY product_id, product_name, category_id, price, ts HAVING SUM(w) > 0
),
cart_cur AS (SELECT product_id, product_name, category_id, price, ts FROM cart_bag b, range(CAST(b.m AS BIGINT)) r)"""


def _streamed_sql(body):
    return with_tables(
        body, CHANGE_FEEDS, _STREAMED,
        pricing_over(products="products_cur", suffix="_s"),
        rename(CART, {"shopping_cart": "cart_cur", "products": "products_cur",
                      "inventory_item": "inventory_item_s"}, CART_CTE_NAMES, "_s"),
        rename(CATEGORY_TOTALS, {"dynamic_cart": "dynamic_cart_s"}, TOTALS_CTE_NAMES, "_s"))


@query("stream_inventory_item", _streamed_sql(
    "SELECT product_id, live_price, last_update_time FROM inventory_item_s"))
def q_stream_inventory_item(spark, d):
    t = retail_tables(spark, d)
    feed = mt.encode_rows(testdata.product_changes(spark, d), "products", t.products.columns)
    return _streamed(spark, d, feed, _snapshot(t)).inventory_item()


@query("stream_cart", _streamed_sql(
    "SELECT product_id, product_name, category_id, category_name, price, available_stock FROM dynamic_cart_s"))
def q_stream_cart(spark, d):
    t, keeper = _stream_with_cart(spark, d)
    return keeper.dynamic_cart(t.categories)


@query("stream_category_totals", _streamed_sql(f"SELECT {_CT_COLS} FROM category_totals_s"))
def q_stream_category_totals(spark, d):
    t, keeper = _stream_with_cart(spark, d)
    return keeper.category_totals(t.categories, OTHER_OFFSET_FIXTURE)


def _images(before, after):
    """Row images of changes: what was, signed -1, and what is, signed +1."""
    return before.withColumn("w", F.lit(-1)).unionByName(after.withColumn("w", F.lit(1)))


_PRICES = "SELECT product_id, live_price, last_update_time FROM inventory_item"


@query("stream_promotion_change", with_tables(f"{_PRICES}_c", """
promotions_now AS (
  SELECT promotion_id, product_id, promotion_discount, start_date, end_date,
         CASE WHEN product_id % 7 = 0 THEN NOT active ELSE active END AS active, updated_at FROM promotions)""",
    pricing_over(promotions="promotions_now", suffix="_c")))
def q_stream_promotion_change(spark, d):
    """M2: promotions of every seventh product toggled."""
    t = retail_tables(spark, d)
    old = t.promotions.where("product_id % 7 = 0")
    feed = mt.encode_signed(global_position(_images(old, old.withColumn("active", ~F.col("active"))), ["promotion_id", "w"]),
                            "promotions", t.promotions.columns, "position")
    return _streamed(spark, d, feed, _snapshot(t)).inventory_item()


@query("stream_stock_change", with_tables(f"{_PRICES}_c", """
inventory_now AS (
  SELECT inventory_id, product_id, CASE WHEN product_id % 5 = 0 THEN stock + 200 ELSE stock END AS stock,
         warehouse_id, restock_date FROM inventory WHERE product_id % 5 <> 1)""",
    pricing_over(inventory="inventory_now", suffix="_c")))
def q_stream_stock_change(spark, d):
    """M2: stock of every fifth product raised, of every other fifth removed."""
    t = retail_tables(spark, d)
    old = t.inventory.where("product_id % 5 < 2")
    new = old.where("product_id % 5 = 0").withColumn("stock", F.col("stock") + 200)
    return _streamed(spark, d, mt.encode_signed(_images(old, new), "inventory", t.inventory.columns, "inventory_id"),
                     _snapshot(t)).inventory_item()


@query("stream_sales_change", with_tables(f"{_PRICES}_c", """
sales_now AS (
  SELECT * FROM sales WHERE sale_id % 4 <> 0
  UNION ALL SELECT sale_id, product_id, sale_price, sale_date + INTERVAL 60 DAY, price FROM sales WHERE product_id % 9 = 0)""",
    pricing_over(sales="sales_now", suffix="_c")))
def q_stream_sales_change(spark, d):
    """M2: a quarter of the sales withdrawn, those of every ninth product repeated 60 days later."""
    t = retail_tables(spark, d)
    later = t.sales.where("product_id % 9 = 0").withColumn("sale_date", F.timestamp_add("DAY", F.lit(60), F.col("sale_date")))
    feed = mt.encode_signed(global_position(_images(t.sales.where("sale_id % 4 = 0"), later), ["sale_id", "w"]), "sales",
                            t.sales.columns, "position")
    return _streamed(spark, d, feed, _snapshot(t)).inventory_item()


# --------------------------------------------------------------------------- live views

def _log(rows, table, log, columns, order, before=None, after=None):
    """Change rows of a log, positions 1, 2, .. in the order of a key; before and after are conditions (None: always)."""
    image = lambda when, prefix: F.when(when, F.struct(*[F.col(prefix + c).alias(c) for c in columns]))
    rows = written(rows, f"{log}-changes")        # the bounds, the counts of ranges and the rows are read from it, not computed three times
    changed = [c for c in rows.columns if c.startswith("new_")]
    full = rows.select("*", *[F.col(c).alias(f"new_{c}") for c in columns if f"new_{c}" not in changed])
    placed = global_position(full, order)
    has = [F.lit(True) if x is None else F.expr(x) for x in (before, after)]
    op = F.when(~has[0], "I").when(~has[1], "D").otherwise("U")
    return live.changes(placed.select("position", op.alias("op"), image(has[0], "").alias("before"),
                                      image(has[1], "new_").alias("after")), table, log)


def _live_feed(spark, d, t):
    """Changes of all tables: restocking, promotions that end, withdrawn sales, product events, cart lines, a moved part of the tree."""
    stock = t.inventory.where("stock < 30").withColumn("new_stock", (F.col("stock") * 4 + 1).cast("int"))
    ended = t.promotions.where("active AND promotion_discount >= 8").withColumn("new_active", F.lit(False))
    products = testdata.product_changes(spark, d).withColumnRenamed("seq", "position")
    columns = [c for c in t.products.columns if c in products.columns]
    whole = F.struct(*columns)
    products = live.changes(products.select("position", "op", F.when(F.col("op") == "D", whole).alias("before"),
                                            F.when(F.col("op") != "D", whole).alias("after")), "products", "events")
    cart = testdata.cart_change_lines(spark, d, t.products)
    moved = t.categories.where("parent_id BETWEEN 1 AND 5 AND length(category_name) = 5").withColumn(
        "new_parent_id", F.lit(1).cast(t.categories.schema["parent_id"].dataType))
    feeds = live.together(
        lambda: _log(stock, "inventory", "stock", t.inventory.columns, ["inventory_id"]),
        lambda: _log(ended, "promotions", "promotions", t.promotions.columns, ["promotion_id"]),
        lambda: _log(t.sales.where("sale_price < 5000"), "sales", "sales", t.sales.columns, ["sale_id"], after="false"),
        lambda: products,
        lambda: _log(cart, "shopping_cart", "cart", t.shopping_cart.columns, ["order_id", "line"], before="w < 0", after="w > 0"),
        lambda: _log(moved, "categories", "tree", t.categories.columns, ["category_id"]))
    out = feeds[0]
    for more in feeds[1:]:
        out = out.unionByName(more)
    return out


def _followed(spark, feed, snapshot, positions=None, batches=2):
    """Live views that have loaded a snapshot and followed ``feed``, part of it delivered twice, in some micro-batches."""
    root = _scratch(spark, "live")
    feed.write.parquet(f"{root}/feed")
    sent = spark.read.schema(feed.schema).parquet(f"{root}/feed")
    # a tenth of the changes in a tenth of the files: no file, and no task that writes one, is larger than the feed's
    again = sent.where(F.pmod(F.xxhash64("log", "position"), F.lit(10)) == 0)
    again.repartition(max(1, len(sent.inputFiles()) // 10)).write.mode("append").parquet(f"{root}/feed")
    files = len(spark.read.parquet(f"{root}/feed").inputFiles())
    views = live.LiveViews(spark, f"{root}/kept")
    views.load(snapshot, positions)
    q = views.start(f"{root}/feed", max_files_per_trigger=-(-files // batches))
    q.awaitTermination()
    LAST_LIVE_PROGRESS[:] = [dict(p) for p in q.recentProgress]
    return views


#: Views that have followed the whole feed, per application and folder: the keys that read them share the run.
_FOLLOWED: dict[tuple[str, str], live.LiveViews] = {}
LAST_LIVE_PROGRESS: list[dict] = []


def _live_views(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLLOWED:
        t = retail_tables(spark, d)
        _FOLLOWED[key] = _followed(spark, _live_feed(spark, d, t), {n: getattr(t, n) for n in live.IMAGES})
    return _FOLLOWED[key]


_LIVE_TABLES = {"products": "products_cur", "sales": "sales_now", "promotions": "promotions_now", "inventory": "inventory_now"}
_LIVE_CART = {"shopping_cart": "cart_cur", "products": "products_cur", "inventory_item": "inventory_item_c",
              "categories": "categories_now", "inventory": "inventory_now"}


def _live_sql(body):
    return with_tables(
        body, CHANGE_FEEDS, _STREAMED, """
inventory_now AS (
  SELECT inventory_id, product_id, CASE WHEN stock < 30 THEN stock * 4 + 1 ELSE stock END AS stock, warehouse_id, restock_date
  FROM inventory),
promotions_now AS (
  SELECT promotion_id, product_id, promotion_discount, start_date, end_date,
         active AND promotion_discount < 8 AS active, updated_at FROM promotions),
sales_now AS (SELECT * FROM sales WHERE NOT sale_price < 5000),
categories_now AS (
  SELECT category_id, category_name,
         CASE WHEN parent_id BETWEEN 1 AND 5 AND length(category_name) = 5 THEN 1 ELSE parent_id END AS parent_id FROM categories)""",
        PRICING, CART, CATEGORY_TOTALS, pricing_over(**_LIVE_TABLES, suffix="_c"),
        rename(CART, _LIVE_CART, CART_CTE_NAMES, "_c"),
        rename(CATEGORY_TOTALS, {"dynamic_cart": "dynamic_cart_c", "categories": "categories_now"}, TOTALS_CTE_NAMES, "_c"))


@query("stream_price_deltas", _live_sql("""
SELECT product_id, old.live_price AS old_price, new.live_price AS new_price
FROM inventory_item old FULL JOIN inventory_item_c new USING (product_id)
WHERE old.live_price IS DISTINCT FROM new.live_price"""))
def q_stream_price_deltas(spark, d):
    """M2: every price that the feed changes, as the stream logged it."""
    views = _live_views(spark, d)
    return views.price_deltas(0, views.version())


@query("stream_category_deltas", _live_sql(f"""
SELECT category_id, (coalesce(new.total, 0) - coalesce(old.total, 0))::DECIMAL(38,10) AS total,
       (coalesce(new.item_count, 0) - coalesce(old.item_count, 0))::BIGINT AS item_count
FROM (SELECT * FROM category_totals WHERE category_id < {OTHER_OFFSET_FIXTURE}) old
FULL JOIN (SELECT * FROM category_totals_c WHERE category_id < {OTHER_OFFSET_FIXTURE}) new USING (category_id)
WHERE coalesce(new.total, 0) <> coalesce(old.total, 0) OR coalesce(new.item_count, 0) <> coalesce(old.item_count, 0)"""))
def q_stream_category_deltas(spark, d):
    """M3: what cart, price and tree changes add to the sums of categories."""
    views = _live_views(spark, d)
    return views.category_deltas(0, views.version())


@query("stream_live_prices", _live_sql("SELECT product_id, live_price, last_update_time FROM inventory_item_c"))
def q_stream_live_prices(spark, d):
    return _live_views(spark, d).reader().inventory_item()


@query("stream_live_totals", _live_sql(f"SELECT {_CT_COLS} FROM category_totals_c"))
def q_stream_live_totals(spark, d):
    return _live_views(spark, d).reader().category_totals(OTHER_OFFSET_FIXTURE)


@query("stream_live_cart", _live_sql(
    "SELECT product_id, product_name, category_id, category_name, price, available_stock FROM dynamic_cart_c"))
def q_stream_live_cart(spark, d):
    return _live_views(spark, d).reader().dynamic_cart()


@query("stream_live_recent_prices", _live_sql("SELECT product_id, avg_price FROM recent_prices_c"))
def q_stream_live_recent_prices(spark, d):
    """The ten newest of each product after sales were withdrawn."""
    return _live_views(spark, d).reader().recent_prices()


@query("stream_live_reconcile", _live_sql("""
SELECT round(sum(price), 2)::DECIMAL(38,2) AS cart_total,
       (SELECT round(sum(total), 2) FROM category_totals_c WHERE parent_id IS NULL)::DECIMAL(38,2) AS categories_total,
       (round(sum(price), 2) - (SELECT round(sum(total), 2) FROM category_totals_c WHERE parent_id IS NULL))::DECIMAL(38,2) AS delta
FROM dynamic_cart_c"""))
def q_stream_live_reconcile(spark, d):
    """Cart and categories of one version."""
    reader = _live_views(spark, d).reader()
    return cartops.reconcile_cart(reader.dynamic_cart(), reader.category_totals(OTHER_OFFSET_FIXTURE))


@query("stream_value_returns", with_tables("""
SELECT product_id, SUM(stock + 1)::BIGINT AS total_stock FROM inventory GROUP BY product_id"""))
def q_stream_value_returns(spark, d):
    """Every stock goes up by one, back, and up again: three changes, two of them alike."""
    t = retail_tables(spark, d)
    steps = t.inventory.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    up = F.pmod(F.col("step"), F.lit(2))
    feed = _log(steps.withColumn("new_stock", (F.col("stock") + 1 - up).cast("int")).withColumn("stock", (F.col("stock") + up).cast("int")),
                "inventory", "stock", t.inventory.columns, ["inventory_id", "step"])
    return _followed(spark, feed, {"inventory": t.inventory}).reader().stock()


@query("stream_cut_over", priced("SELECT product_id, live_price, last_update_time FROM inventory_item"))
def q_stream_cut_over(spark, d):
    """Snapshots taken in the middle of the logs of sales and stock, then the whole logs."""
    t = retail_tables(spark, d)
    sales = global_position(t.sales, ["sale_id"])
    stock = global_position(t.inventory, ["inventory_id"])
    half = {n: rows.count() // k for n, rows, k in (("sales", t.sales, 2), ("inventory", t.inventory, 3))}
    feed = _log(t.sales, "sales", "sales", t.sales.columns, ["sale_id"], before="false").unionByName(
        _log(t.inventory, "inventory", "stock", t.inventory.columns, ["inventory_id"], before="false"))
    snapshot = {"products": t.products, "promotions": t.promotions,
                "sales": sales.where(F.col("position") <= half["sales"]).drop("position"),
                "inventory": stock.where(F.col("position") <= half["inventory"]).drop("position")}
    positions = {("sales", "sales"): half["sales"], ("stock", "inventory"): half["inventory"]}
    return _followed(spark, feed, snapshot, positions).reader().inventory_item()


@query("stream_qps", with_tables("""
SELECT source, date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end,
       COUNT(*) AS n, COUNT(*) / 60.0 AS qps
FROM query_log GROUP BY source, date_trunc('minute', ts)"""))
def q_stream_qps(spark, d):
    """The log in four parts that each span the whole time: most rows of the later parts are late, and count."""
    root = _scratch(spark, "qps")
    log = retail_tables(spark, d).query_log
    for part in range(4):
        log.where(F.pmod("seq", F.lit(4)) == 3 - part).write.mode("append").parquet(f"{root}/log")
        qps_stream.stream_qps(spark, f"{root}/log", f"{root}/out").awaitTermination()
    return qps_stream.read_qps(spark, f"{root}/out")


def _followed_log(spark, t, window_s):
    """The log in four parts by time, in each of which rows come up to two days late and out of order; a restart a part."""
    root = _scratch(spark, "trailing")
    late = F.timestamp_add("SECOND", F.pmod(F.xxhash64("seq"), F.lit(170_000)).cast("int"), F.col("ts"))
    came = t.query_log.withColumn("_came", late)
    bounds = range_bounds(came, "_came", 4)
    views = LiveMetrics(spark, f"{root}/out", window_s=window_s, bucket_s=43_200.0, delay="2 days")   # a sparse log
    for part in range(len(bounds) + 1):
        (came.where(range_of("_came", bounds) == part).drop("_came").orderBy(F.xxhash64("seq", F.lit(part)))
         .write.mode("append").parquet(f"{root}/log"))
        for stream in views.start(f"{root}/log"):
            stream.awaitTermination()
    return views


@query("stream_trailing_qps", with_tables("""
SELECT source, seq, n_window, n_window / 60.0 AS qps
FROM (SELECT *, COUNT(*) OVER (PARTITION BY source ORDER BY ts
                               RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n_window
      FROM query_log) q"""))
def q_stream_trailing_qps(spark, d):
    """W6 live: counts of the trailing window, from a stream with late rows."""
    return _followed_log(spark, retail_tables(spark, d), 60.0).trailing()


@query("stream_metrics_snapshot", priced(_SNAPSHOT_SQL))
def q_stream_metrics_snapshot(spark, d):
    """M15 live: the snapshot from the kept newest readings and counts."""
    t = retail_tables(spark, d)
    options = {k: v for k, v in _SNAP.items() if k != "window_s"}
    now = t.query_log.agg(F.max("ts")).first()[0]
    return _followed_log(spark, t, _SNAP["window_s"]).snapshot(
        _items(t), _refresh_log(t), t.heartbeats, t.replica_heartbeats, now, decimals=2, **options)
