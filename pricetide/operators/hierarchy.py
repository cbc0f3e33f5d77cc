"""Recursive category roll-up of the cart (``category_totals``).

The cart is reduced to one row per category, the category tree to its
(node, ancestor) pairs, and the two are joined once and summed per ancestor. The
pairs are built by doubling: after k steps every node knows its ancestors up
to 2^k - 1 levels up and the one 2^k levels up, each step a join written to the
shared folder, until no node has one that far up. Depth and size of the tree are
not limited; a parent cycle shows as a node that is its own ancestor.

``by`` names key columns of all tables (such as ``vertical``): each of their
values has a tree of its own, and equal ids in two of them are two nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.session import written

TOTAL_TYPE = "decimal(38,10)"
# Fixed values of the synthetic rows: id offset and name of the 'Other' bucket.
OTHER_OFFSET = 1000
OTHER_NAME = "Other"


def direct_totals(cart_view: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per category: SUM(price) and COUNT(price) of the cart lines placed directly in it."""
    return (cart_view.groupBy(*by, "category_id")
            .agg(F.coalesce(F.sum("price"), F.lit(0)).cast(TOTAL_TYPE).alias("total"),
                 F.count("price").alias("item_count")))


def has_children(categories: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(category_id, has_subcategory) for every category."""
    parents = (categories.filter(F.col("parent_id").isNotNull())
               .select(*by, F.col("parent_id").alias("category_id")).distinct().withColumn("_has", F.lit(True)))
    return (categories.select(*by, "category_id")
            .join(parents, [*by, "category_id"], "left")
            .select(*by, "category_id", F.col("_has").isNotNull().alias("has_subcategory")))


def ancestor_closure(categories: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(category_id, ancestor_id, depth) for every node and each of its ancestors (itself at 0).

    Raises ValueError naming a category on a parent cycle.
    """
    up, pair = [*by, "up"], [*by, "category_id"]
    known = written(categories.select(*pair, F.col("category_id").alias("ancestor_id"),
                                      F.lit(0).alias("depth")), "closure")
    jump = written(categories.where("parent_id IS NOT NULL")
                   .select(*pair, F.col("parent_id").alias("up")), "closure-jump")
    step = 1
    while jump.head(1):
        above = known.select(*by, F.col("category_id").alias("up"), F.col("ancestor_id"), (F.col("depth") + step).alias("depth"))
        farther = jump.join(above, up).select(*pair, "ancestor_id", "depth")
        # a parent outside the table is an ancestor without ancestors of its own
        outside = jump.join(known.select(*by, F.col("category_id").alias("up")).distinct(), up, "left_anti")
        farther = farther.unionByName(outside.select(*pair, F.col("up").alias("ancestor_id"),
                                                     F.lit(step).alias("depth")))
        known = written(known.unionByName(farther), "closure")
        on_cycle = known.where("category_id = ancestor_id AND depth > 0").select("category_id").head(1)
        if on_cycle:
            raise ValueError(f"category parent cycle at category {on_cycle[0][0]}")
        jump = written(jump.join(jump.select(*by, F.col("category_id").alias("up"), F.col("up").alias("next")), up)
                       .select(*pair, F.col("next").alias("up")), "closure-jump")
        step *= 2
    return known


def _other_rows(direct: DataFrame, has_sub: DataFrame, categories: DataFrame,
                other_offset: int, by: Sequence[str] = ()) -> DataFrame:
    others = (direct.filter(F.col("item_count") > 0)
              .join(has_sub.filter("has_subcategory"), [*by, "category_id"])
              .select(*by, (F.col("category_id") + F.lit(other_offset)).alias("_oid"),
                      F.col("category_id").alias("parent_id"), "total", "item_count"))
    # An 'Other' id equal to a real id would make two rows share a key: refuse it.
    taken = categories.select(*by, F.col("category_id").alias("_oid"), F.lit(True).alias("_taken"))
    return (others.join(taken, [*by, "_oid"], "left")
            .select(*by, F.when(F.col("_taken").isNotNull(),
                           F.raise_error(F.concat(F.lit("'Other' id collides with category "),
                                                  F.col("_oid").cast("string"),
                                                  F.lit("; raise other_offset"))))
                    .otherwise(F.col("_oid")).cast("bigint").alias("category_id"),
                    "parent_id",
                    F.lit(False).alias("has_subcategory"),
                    F.lit(OTHER_NAME).alias("category_name"),
                    "total", "item_count"))


def finish(rolled: DataFrame, direct: DataFrame, categories: DataFrame,
            other_offset: int, by: Sequence[str] = ()) -> DataFrame:
    has_sub = has_children(categories, by)
    key = [*by, "category_id"]
    main = (rolled.join(categories.select(*key, "parent_id", "category_name"), key)
            .join(has_sub, key)
            .select(*key, "parent_id", "has_subcategory", "category_name",
                    F.col("total").cast(TOTAL_TYPE).alias("total"),
                    F.col("item_count").cast("bigint").alias("item_count")))
    return main.unionByName(_other_rows(direct, has_sub, categories, other_offset, by))


def rollup_tree(closure: DataFrame, measures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum per-node measures (category_id, total, item_count) into every ancestor."""
    return (measures.join(closure.select(*by, "category_id", "ancestor_id"), [*by, "category_id"])
            .groupBy(*by, F.col("ancestor_id").alias("category_id"))
            .agg(F.sum("total").alias("total"), F.sum("item_count").alias("item_count"))
            .filter(F.col("item_count") > 0))


def category_totals(categories: DataFrame, cart_view: DataFrame | None, *,
                    other_offset: int = OTHER_OFFSET, direct: DataFrame | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Totals of every category with lines below it, and the synthetic ``Other`` rows of direct lines.

    ``direct`` may pass ready per-category sums (:func:`direct_totals`) instead of the cart.
    """
    direct = direct_totals(cart_view, by) if direct is None else direct
    return finish(rollup_tree(ancestor_closure(categories, by), direct, by), direct, categories, other_offset, by)
