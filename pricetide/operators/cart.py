"""The live cart and what is read from it.

The reference groups the cart without a cart id, after a left join to the
inventory that fans out (cart rows x warehouse rows). Here the fan-out is never
built: stock is summed per product and cart rows are counted per
(product, name) before the join, and ``available_stock = stock x multiplicity``
is exactly the reference's SUM over the fanned-out rows. Both sides are
pre-aggregated with partial aggregates, so a product that fills a third of the
cart costs one row per map task.

``by`` names key columns of all tables (such as ``vertical``), as in :mod:`pricing`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import hierarchy
from pricetide.operators.ordering import global_position
from pricetide.session import written
from pricetide.sources.io import json_doc

TOTAL_TYPE = "decimal(38,10)"   # numeric(20,10) of the reference, with head room


def dynamic_cart(cart: DataFrame, products: DataFrame, categories: DataFrame,
                 items: DataFrame, inventory: DataFrame | None, *, dedupe_stock: bool = False,
                 stock: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(product_id, product_name, category_id, category_name, price, available_stock).

    Unknown products, products outside the category table and products without
    a live price (no sale) vanish, as with the reference's inner joins.
    ``dedupe_stock=True`` counts a product's stock once however often it is in
    the cart (the reference multiplies it). ``stock`` may pass ready per-product
    totals (product_id, total_stock) instead of the inventory rows.
    """
    # a counted bag (a ``multiplicity`` column, as kept by the stream) or plain rows
    units = F.sum("multiplicity") if "multiplicity" in cart.columns else F.count(F.lit(1))
    key = [*by, "product_id"]
    grouped = cart.groupBy(*key, "product_name").agg(units.alias("_mult"))
    stock = (stock.select(*key, F.col("total_stock").alias("_stock")) if stock is not None
             else inventory.groupBy(*key).agg(F.sum("stock").alias("_stock")))
    mult = F.lit(1) if dedupe_stock else F.col("_mult")
    return (grouped
            .join(products.select(*key, "category_id"), key)
            .join(categories.select(*by, "category_id", "category_name"), [*by, "category_id"])
            .join(items.select(*key, F.col("live_price").alias("price")), key)
            .join(stock, key, "left")
            .select(*key, "product_name", "category_id", "category_name", "price",
                    F.coalesce(F.col("_stock") * mult, F.lit(0)).cast("bigint").alias("available_stock")))


def sort_cart(cart_view: DataFrame) -> DataFrame:
    """Cart lines, most expensive first."""
    return cart_view.orderBy(F.col("price").desc_nulls_last(), "product_id")


def cart_total(cart_view: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: ROUND(SUM(price)::numeric, 2), 0 for an empty cart; with ``by`` one row per value that has lines."""
    return cart_view.groupBy(*by).agg(
        F.coalesce(F.round(F.sum("price").cast(TOTAL_TYPE), 2), F.lit(0).cast(TOTAL_TYPE))
        .cast("decimal(38,2)").alias("cart_total"))


# Fixed value: placeholders of the live answer text.
COUNT_TOKEN = "$count$"
TOTAL_TOKEN = "$total$"
DEFAULT_ANSWER = "Your cart holds $count$ items for a total of $$total$."


def cart_summary(cart_view: DataFrame, template: str = DEFAULT_ANSWER) -> DataFrame:
    """Item count and total of the cart, and the answer text filled from them."""
    agg = cart_view.agg(F.count(F.lit(1)).alias("item_count"),
                        F.coalesce(F.sum("price"), F.lit(0)).cast("decimal(38,2)").alias("total"))
    text = F.replace(F.replace(F.lit(template), F.lit(COUNT_TOKEN), F.col("item_count").cast("string")),
                     F.lit(TOTAL_TOKEN), F.col("total").cast("string"))
    return agg.select("item_count", "total", text.alias("answer"))


def visible_categories(totals: DataFrame, expanded: Sequence[int] = ()) -> DataFrame:
    """Roots, plus the children of the expanded ids (empty list -> roots only)."""
    cond = F.col("parent_id").isNull()
    ids = [int(i) for i in expanded]
    if ids:
        cond = cond | F.col("parent_id").isin(ids)
    return totals.filter(cond)


def with_total(df: DataFrame, value: str, total_df: DataFrame, alias: str,
               by: Sequence[str] = ()) -> DataFrame:
    """Repeat a one-row scalar on every row (scalar subquery as a broadcast cross join), or one per value of ``by``."""
    total = total_df.select(*by, F.col(value).alias(alias))
    return df.join(total, list(by), "left") if by else df.crossJoin(F.broadcast(total))


def roots_total(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (totals.filter(F.col("parent_id").isNull()).groupBy(*by)
            .agg(F.round(F.sum("total").cast(TOTAL_TYPE), 2).cast("decimal(38,2)")
                 .alias("categories_total")))


def category_subtotals(totals: DataFrame, expanded: Sequence[int] = (), by: Sequence[str] = ()) -> DataFrame:
    """Visible categories with subtotal rounded to cents and the roots' total on every row."""
    vis = visible_categories(totals, expanded).select(
        *by, "category_id", "parent_id", "has_subcategory", "category_name", "item_count",
        F.round(F.col("total").cast(TOTAL_TYPE), 2).cast("decimal(38,2)").alias("subtotal"))
    return with_total(vis, "categories_total", roots_total(totals, by), "categories_total", by)


def sort_tree(df: DataFrame) -> DataFrame:
    """Parent first, then its children: ORDER BY coalesce(parent_id, category_id), category_id."""
    return df.orderBy(F.coalesce("parent_id", "category_id"), "category_id")


def flat_subtotals(totals: DataFrame) -> DataFrame:
    return (totals.select("category_name", "item_count", F.col("total").alias("subtotal"))
            .orderBy("category_name"))


def category_list(categories: DataFrame) -> DataFrame:
    return categories.select("category_id", "category_name").distinct().orderBy("category_name")


def reconcile_cart(cart_view: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cart total against the sum of root totals; delta 0 when every cart category is in the tree."""
    ct = cart_total(cart_view, by)
    rt = roots_total(totals, by)
    both = ct.join(rt, list(by), "left") if by else ct.crossJoin(rt)   # one row each
    return (both
            .select(*by, "cart_total",
                    F.coalesce("categories_total", F.lit(0).cast("decimal(38,2)")).alias("categories_total"))
            .withColumn("delta", (F.col("cart_total") - F.col("categories_total")).cast("decimal(38,2)")))


def cart_stock(cart: DataFrame, inventory: DataFrame) -> DataFrame:
    """Distinct cart products with each of their inventory rows' stock."""
    return (cart.select("product_id").distinct()
            .join(inventory.select("product_id", "warehouse_id", "stock"), "product_id"))


def cart_snapshot(cart_view: DataFrame, categories: DataFrame, expanded: Sequence[int] = (), *,
                  other_offset: int = hierarchy.OTHER_OFFSET) -> DataFrame:
    """The cart page as JSON records: one per item, one per visible category, one total.

    Emitted as rows (``kind``, ``position``, ``id``, ``doc``) rather than one
    nested document, so no task or driver ever holds the whole cart; items are
    numbered from the most expensive, categories and the total have no position.
    The cart is written once; sums, totals and places are read from that.
    """
    cart_view = written(cart_view, "cart")
    direct = hierarchy.direct_totals(cart_view)
    totals = hierarchy.category_totals(categories, None, other_offset=other_offset, direct=direct)
    placed = global_position(cart_view, ["price", "product_id", "product_name"], descending=True)
    no_place = F.lit(None).cast("bigint").alias("position")
    items = placed.select(
        F.lit("item").alias("kind"), F.col("position").cast("bigint").alias("position"),
        F.col("product_id").alias("id"),
        json_doc("product_id", "product_name", "category_id", "category_name",
                 "price", "available_stock").alias("doc"))
    subs = category_subtotals(totals, expanded).select(
        F.lit("category").alias("kind"), no_place,
        F.col("category_id").alias("id"),
        json_doc("category_id", "parent_id", "has_subcategory", "category_name",
                 "item_count", "subtotal", "categories_total").alias("doc"))
    tot = reconcile_cart(direct.select(F.col("total").alias("price")), totals).select(
        F.lit("total").alias("kind"), no_place, F.lit(None).cast("bigint").alias("id"),
        json_doc("cart_total", "categories_total").alias("doc"))
    return items.unionByName(subs).unionByName(tot)
