"""Live price per product (the ``inventory_item`` data product) and its parts.

Plan shape, chosen for scale:

* sales are aggregated per product *before* any join (partial + final hash
  aggregate), and both uses of the per-product counts share one aggregate;
* the "10 newest sales" top-N is a ``row_number`` filter, which Catalyst turns
  into a partial ``WindowGroupLimit`` before the shuffle, so a product holding a
  third of all sales ships at most N rows per map task;
* the popularity and stock RANK bands never materialise a rank: only the 3rd
  and 10th largest value per category (or globally for stock) are needed, and
  ``rank <= k  <=>  value >= t_k``. Those thresholds come from a bounded top-k,
  so no single task ever sorts a whole category or the whole inventory;
* every per-product side is hash partitioned on ``product_id``, so the final
  left joins reuse one partitioning.

``by`` names key columns that all tables carry beside their own keys (such as
``vertical``): every group, join, window and threshold then holds within one
value of them, so one job prices many verticals as if each ran alone. A row
with NULL in one of them belongs to none and vanishes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import factors as fx
from pricetide.operators.ordering import running_sum


# --------------------------------------------------------------------------- helpers

def kth_largest(df: DataFrame, value: str, ks: Sequence[int],
                partition_cols: Sequence[str] = ()) -> DataFrame:
    """k-th largest ``value`` (duplicates counted) per partition, one column ``t<k>`` per k.

    NULL when the partition has fewer than k rows. The ``row_number() <= max(k)``
    filter is planned as a partial WindowGroupLimit before the exchange, so the
    shuffle carries at most max(k) rows per partition key and map task.
    """
    kmax = max(ks)
    w = Window.partitionBy(*partition_cols).orderBy(F.col(value).desc())
    top = (df.select(*partition_cols, value)
           .filter(F.col(value).isNotNull())
           .withColumn("_rn", F.row_number().over(w))
           .filter(F.col("_rn") <= kmax))
    aggs = [F.max(F.when(F.col("_rn") == k, F.col(value))).alias(f"t{k}") for k in ks]
    return top.groupBy(*partition_cols).agg(*aggs)


def rank_desc(df: DataFrame, value: str, partition_cols: Sequence[str] = (),
              rank_col: str = "rank") -> DataFrame:
    """Exact ``RANK() OVER (PARTITION BY .. ORDER BY value DESC)`` via a value histogram.

    The window runs over the *distinct* values per partition (with their
    multiplicity), never over the rows themselves, so a partition key holding
    a third of all rows costs one histogram row per distinct value.
    """
    pcols = list(partition_cols)
    hist = df.groupBy(*pcols, value).agg(F.count(F.lit(1)).alias("_n"))
    if pcols:
        w = (Window.partitionBy(*pcols).orderBy(F.col(value).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
        ranks = hist.select(*pcols, value,
                            (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).alias(rank_col))
    else:
        # global rank: running sum over range partitions of the distinct values
        run = running_sum(hist, value, "_n", "_cum", descending=True)
        ranks = run.select(value, (F.col("_cum") - F.col("_n") + 1).alias(rank_col))
    return df.join(ranks, on=[*pcols, value], how="left")


# --------------------------------------------------------------------------- parts of D1

def sales_counts(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """COUNT(*) and SUM(sale_price) per product (one shared pre-aggregate)."""
    return sales.groupBy(*by, "product_id").agg(
        F.count(F.lit(1)).alias("sale_count"),
        F.sum("sale_price").alias("sale_price_sum"),
    )


def recent_prices(sales: DataFrame, n: int = fx.RECENT_SALES, by: Sequence[str] = ()) -> DataFrame:
    """Average list price of each product's ``n`` newest sales.

    Ties on ``sale_date`` are broken by the higher price, so the result is a
    function of the data (the reference leaves such ties arbitrary).
    """
    w = Window.partitionBy(*by, "product_id").orderBy(F.col("sale_date").desc(), F.col("price").desc())
    top = (sales.select(*by, "product_id", "sale_date", "price")
           .withColumn("_rn", F.row_number().over(w))
           .filter(F.col("_rn") <= n))
    return top.groupBy(*by, "product_id").agg(
        (F.sum("price").cast("double") / F.count(F.lit(1))).alias("avg_price"))


def active_promotions(promotions: DataFrame) -> DataFrame:
    """``active = TRUE``; start and end dates are not checked (as in the reference)."""
    return promotions.filter(F.col("active"))


def promotion_effect(promotions: DataFrame, products: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Smallest active discount per product (the smallest, not the best)."""
    pe = (active_promotions(promotions).groupBy(*by, "product_id")
          .agg(F.min("promotion_discount").alias("promotion_discount")))
    if products is not None:
        pe = pe.join(products.select(*by, "product_id"), [*by, "product_id"], "left_semi")
    return pe


def popularity_counts(sales: DataFrame, products: DataFrame,
                      counts: DataFrame | None = None) -> DataFrame:
    """Sales count per (product, category): products with at least one sale."""
    counts = counts if counts is not None else sales_counts(sales)
    return counts.join(products.select("product_id", "category_id"), "product_id")


def popularity_score(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Exact RANK of sales count within the category, plus the count."""
    pc = popularity_counts(sales, products).select("product_id", "category_id", "sale_count")
    ranked = rank_desc(pc, "sale_count", ["category_id"], rank_col="popularity_rank")
    return ranked.select("product_id", "category_id", "popularity_rank", "sale_count")


def inventory_totals(inventory: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # product_id is NOT NULL in the model; saying so keeps the two uses of the
    # totals (thresholds and bands) one identical, reusable subplan
    return (inventory.filter(F.col("product_id").isNotNull())
            .groupBy(*by, "product_id").agg(F.sum("stock").alias("total_stock")))


def inventory_status(inventory: DataFrame) -> DataFrame:
    """SUM(stock) per product and its exact global RANK (via value histogram)."""
    totals = inventory_totals(inventory)
    return rank_desc(totals, "total_stock", rank_col="stock_rank").select(
        "product_id", "total_stock", "stock_rank")


def stock_thresholds(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """3rd and 10th largest total stock (NULL when fewer rows): one row, or one per value of ``by``."""
    ks = [edge for edge, _ in fx.STOCK_BANDS]
    return kth_largest(totals, "total_stock", ks, by)


def _with_thresholds(totals: DataFrame, th: DataFrame, by: Sequence[str]) -> DataFrame:
    # without ``by`` th is one row by construction (global aggregate of a bounded top-k): broadcasting it is bounded;
    # with it, it has a row per value and AQE broadcasts it by its measured size
    return totals.join(th, list(by)) if by else totals.crossJoin(F.broadcast(th))


def stock_bands(inventory: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stock adjustment per product with inventory, without a global sort."""
    totals = inventory_totals(inventory, by)
    ks = [edge for edge, _ in fx.STOCK_BANDS]
    th = stock_thresholds(totals, by)
    return _with_thresholds(totals, th, by).select(
        *by, "product_id", "total_stock",
        fx.band_by_threshold("total_stock", [f"t{k}" for k in ks],
                             [f for _, f in fx.STOCK_BANDS], fx.STOCK_OTHERWISE)
        .alias("stock_adjustment"))


def high_demand(products: DataFrame, sales: DataFrame,
                counts: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Products sold more often than the mean per-product count, with their mean paid price."""
    counts = counts if counts is not None else sales_counts(sales, by)
    mean = counts.groupBy(*by).agg((F.sum("sale_count") / F.count(F.lit(1))).alias("_mean"))   # one row (per value of by)
    return (_with_thresholds(counts.join(products.select(*by, "product_id"), [*by, "product_id"]), mean, by)
            .filter(F.col("sale_count") > F.col("_mean"))
            .select(*by, "product_id",
                    (F.col("sale_price_sum").cast("double") / F.col("sale_count"))
                    .alias("avg_sale_price"),
                    F.col("sale_count").alias("total_sales")))


# --------------------------------------------------------------------------- D1

def price_inputs(sales: DataFrame, promotions: DataFrame, inventory: DataFrame, *,
                 top_n: int = fx.RECENT_SALES, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The four per-product aggregates the live price is made of (each keyed by product_id).

    They are what a stream maintains incrementally: recomputing them for the
    products a change touches is enough, everything after is product-sized.
    """
    return {
        "counts": sales_counts(sales, by),                                   # sale_count, sale_price_sum
        "recent": recent_prices(sales, top_n, by),                           # avg_price
        "promo": promotion_effect(promotions, by=by),                           # promotion_discount
        "stock": inventory_totals(inventory, by),                            # total_stock
    }


def price_thresholds(products: DataFrame, inputs: dict[str, DataFrame],
                     by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(per-category t3/t10 of sale counts, one row of global t3/t10 of stock totals).

    Both come from bounded top-k computations; they are all a product's bands
    depend on besides its own count and stock.
    """
    pop_ks = [edge for edge, _ in fx.POPULARITY_BANDS]
    counts = inputs["counts"].select(*by, "product_id", "sale_count").join(
        products.select(*by, "product_id", "category_id"), [*by, "product_id"])
    cat_th = kth_largest(counts, "sale_count", pop_ks, [*by, "category_id"])
    return cat_th, stock_thresholds(inputs["stock"].select(*by, "product_id", "total_stock"), by)


def assemble_factors(products: DataFrame, inputs: dict[str, DataFrame], cat_th: DataFrame,
                     stock_th: DataFrame, *, cheap_pattern: str = fx.CHEAP_PATTERN,
                     by: Sequence[str] = ()) -> DataFrame:
    """Every factor of the live price for ``products``, given the thresholds of the whole table."""
    pop_ks = [edge for edge, _ in fx.POPULARITY_BANDS]
    stock_ks = [edge for edge, _ in fx.STOCK_BANDS]
    prods = products.select(*by, "product_id", "product_name", "base_price", "category_id", "last_update_time")
    key = [*by, "product_id"]
    pop = (inputs["counts"].select(*by, "product_id", "sale_count").join(prods, key)
           .join(cat_th, [*by, "category_id"])
           .withColumn("popularity_adjustment",
                       fx.band_by_threshold("sale_count", [f"t{k}" for k in pop_ks],
                                            [f for _, f in fx.POPULARITY_BANDS], fx.POPULARITY_OTHERWISE))
           .drop(*[f"t{k}" for k in pop_ks]))
    totals = inputs["stock"].select(*by, "product_id", "total_stock")
    sb = _with_thresholds(totals, stock_th, by).select(
        *by, "product_id",
        fx.band_by_threshold("total_stock", [f"t{k}" for k in stock_ks],
                             [f for _, f in fx.STOCK_BANDS], fx.STOCK_OTHERWISE).alias("stock_adjustment"))
    joined = (pop.join(inputs["recent"].select(*by, "product_id", "avg_price"), key, "left")
              .join(inputs["promo"].select(*by, "product_id", "promotion_discount"), key, "left")
              .join(sb, key, "left"))
    return joined.select(
        *by, "product_id",
        "base_price",
        "popularity_adjustment",
        "avg_price",
        fx.promo_factor("promotion_discount").alias("promotion_discount"),
        F.coalesce(F.col("stock_adjustment"), F.lit(fx.STOCK_OTHERWISE)).alias("stock_adjustment"),
        fx.demand_factor("base_price", "avg_price").alias("demand_multiplier"),
        fx.name_factor("product_name", cheap_pattern).alias("additional_discount"),
        "last_update_time",
    )


def factors_from_inputs(products: DataFrame, inputs: dict[str, DataFrame], *,
                        cheap_pattern: str = fx.CHEAP_PATTERN, by: Sequence[str] = ()) -> DataFrame:
    """Every factor of the live price from product-sized inputs (see :func:`price_inputs`)."""
    cat_th, stock_th = price_thresholds(products, inputs, by)
    return assemble_factors(products, inputs, cat_th, stock_th, cheap_pattern=cheap_pattern, by=by)


def item_factors(products: DataFrame, sales: DataFrame, promotions: DataFrame,
                 inventory: DataFrame, *, top_n: int = fx.RECENT_SALES,
                 cheap_pattern: str = fx.CHEAP_PATTERN, by: Sequence[str] = ()) -> DataFrame:
    """Every factor of the live price, one row per product with at least one sale."""
    return factors_from_inputs(products, price_inputs(sales, promotions, inventory, top_n=top_n, by=by),
                               cheap_pattern=cheap_pattern, by=by)


def live_price_of(factors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return factors.select(
        *by, "product_id",
        fx.live_price("base_price", "popularity_adjustment", "promotion_discount",
                      "stock_adjustment", "demand_multiplier", "additional_discount")
        .alias("live_price"),
        "last_update_time",
    )


def inventory_item(products: DataFrame, sales: DataFrame, promotions: DataFrame,
                   inventory: DataFrame, *, top_n: int = fx.RECENT_SALES,
                   cheap_pattern: str = fx.CHEAP_PATTERN, by: Sequence[str] = ()) -> DataFrame:
    """(product_id, live_price, last_update_time) for every product with a sale, behind the columns of ``by``."""
    return live_price_of(item_factors(products, sales, promotions, inventory, top_n=top_n,
                                      cheap_pattern=cheap_pattern, by=by), by)


def price_of(items: DataFrame, product_id: int) -> DataFrame:
    """Point lookup ``WHERE product_id = ?`` with the price renamed."""
    return items.filter(F.col("product_id") == F.lit(product_id)).select(
        "product_id", F.col("live_price").alias("price"))
