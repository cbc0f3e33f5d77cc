"""Synthetic data (S14-S17) and referential down-sampling.

Random values come from :mod:`pricetide.functions.rand` (hash of key and
seed), so a generated table is the same on any cluster and after retries.
Generation fans rows out with ``explode(sequence(..))`` per product — never a
cross join — and every output row is produced by the task that owns its
product.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.rand import uniform
from pricetide.operators.changes import insert_new
from pricetide.operators.ordering import global_position

# Fixed values of the generator: name suffix by id % 5, 10 categories,
# 5 suppliers, 80 % available, prices 50..1000; sales 100 rounds, promotions
# 5 rounds (discount 0..50 %, 30 % active, +-30 days), inventory 5 rounds
# (stock 0..1000, warehouses 2..6).
NAME_SUFFIX = ("Premium", "Standard", "Basic", "Cheap", "Luxury")
N_CATEGORIES = 10
N_SUPPLIERS = 5
P_AVAILABLE = 0.8


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(as_of).cast("timestamp_ntz")


def _cents(u: Column, units: int) -> Column:
    """Money in [0, units) with 2 decimals, exact (no double -> decimal rounding)."""
    return (F.floor(u * (units * 100)) * F.lit(Decimal("0.01"))).cast("decimal(10,2)")


def _shift_seconds(ts: Column, u: Column, max_days: int, sign: int = -1) -> Column:
    """ts -/+ a whole number of seconds uniform in [0, max_days)."""
    return F.timestamp_add("SECOND", F.floor(u * (max_days * 86400)) * sign, ts)


# one generated row per (product, round); ids stay unique while rounds < ID_STRIDE
ID_STRIDE = 1_000_000


def gen_products(spark: SparkSession, n: int, *, seed: int = 42, as_of="2024-01-01 00:00:00",
                 existing: DataFrame | None = None) -> DataFrame:
    """Products 1..n; ids already present in ``existing`` keep their row (ON CONFLICT DO NOTHING)."""
    i = F.col("id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in NAME_SUFFIX]), (i % 5 + 1).cast("int"))
    gen = spark.range(1, n + 1).select(
        i.alias("product_id"),
        F.concat_ws(" ", F.lit("Product"), i.cast("string"), suffix).alias("product_name"),
        (F.lit(Decimal("50.00")) + _cents(uniform(seed, i, tag="price"), 950)).cast("decimal(10,2)")
        .alias("base_price"),
        (i % N_CATEGORIES + 1).alias("category_id"),
        (i % N_SUPPLIERS + 1).alias("supplier_id"),
        (uniform(seed, i, tag="avail") < P_AVAILABLE).alias("available"),
        _ts(as_of).alias("last_update_time"),
    )
    if existing is None:
        return gen
    return insert_new(existing, gen, ["product_id"])


def _rounds(products: DataFrame, rounds: int, per_round: int | None, seed: int, tag: str) -> DataFrame:
    """(product_id, round) pairs: each round draws ``per_round`` products.

    With ``per_round`` >= the number of products every product is drawn once per
    round (the reference's case). Otherwise each product enters a round with
    probability per_round / N (Bernoulli), so a round's size is per_round on
    average and no task has to rank a whole round.
    """
    pairs = products.select("product_id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    if per_round is None:
        return pairs
    n = products.agg(F.count(F.lit(1)).alias("_n"))            # one row
    return (pairs.crossJoin(F.broadcast(n))
            .filter(uniform(seed, "product_id", "round", tag=tag) * F.col("_n") < F.lit(float(per_round)))
            .drop("_n"))


def gen_sales(products: DataFrame, *, rounds: int = 100, per_round: int | None = 100_000, seed: int = 42,
              as_of="2024-01-01 00:00:00", hot_product: int | None = None, hot_share: float = 0.0) -> DataFrame:
    """Sales over the last 365 days; optionally one hot product gets ``hot_share`` of all rows.

    The hot product's extra rows are produced in chunks of 10,000 spread over
    tasks (negative ids), so even the generator never builds one huge group.
    """
    k = ("product_id", "round")
    base = _rounds(products.select("product_id"), rounds, per_round, seed, "sales")
    base = base.withColumn("sale_id", F.col("product_id") * ID_STRIDE + F.col("round"))
    if hot_product is not None and hot_share > 0:
        n_base = base.agg(F.count(F.lit(1)).alias("_n"))   # one row
        extra = (n_base.select(F.lit(hot_product).cast("bigint").alias("product_id"),
                               F.ceil(F.col("_n") * hot_share / (1 - hot_share)).cast("bigint").alias("_k"))
                 .select("product_id", "_k", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                  F.floor((F.col("_k") - 1) / 10000))).alias("_chunk"))
                 .repartition("_chunk")
                 .select("product_id", F.explode(F.sequence(
                     F.col("_chunk") * 10000 + 1,
                     F.least(F.col("_k"), (F.col("_chunk") + 1) * 10000))).alias("_j"))
                 .select("product_id", (-F.col("_j")).alias("round"), (-F.col("_j")).alias("sale_id")))
        base = base.unionByName(extra)
    return base.select(
        "sale_id",
        "product_id",
        _cents(uniform(seed, *k, tag="sp"), 800).alias("sale_price"),
        _shift_seconds(_ts(as_of), uniform(seed, *k, tag="sd"), 365).alias("sale_date"),
        _cents(uniform(seed, *k, tag="p"), 1000).alias("price"),
    )


def gen_promotions(products: DataFrame, *, rounds: int = 5, per_round: int | None = 100_000, seed: int = 42,
                   as_of="2024-01-01 00:00:00") -> DataFrame:
    base = _rounds(products.select("product_id"), rounds, per_round, seed, "promo")
    ts = _ts(as_of)
    k = ("product_id", "round")
    return base.select(
        (F.col("product_id") * ID_STRIDE + F.col("round")).alias("promotion_id"),
        "product_id",
        _cents(uniform(seed, *k, tag="d"), 50).alias("promotion_discount"),
        _shift_seconds(ts, uniform(seed, *k, tag="s"), 30).alias("start_date"),
        _shift_seconds(ts, uniform(seed, *k, tag="e"), 30, sign=1).alias("end_date"),
        (uniform(seed, *k, tag="a") < 0.3).alias("active"),
        _shift_seconds(ts, uniform(seed, *k, tag="u"), 30).alias("updated_at"),
    )


def gen_inventory(products: DataFrame, *, rounds: int = 5, per_round: int | None = 200_000, seed: int = 42,
                  as_of="2024-01-01 00:00:00") -> DataFrame:
    """Stock rows; warehouse 2..6 (``1 + n % 5 + 1`` of the reference, n from a hash instead of row order)."""
    base = _rounds(products.select("product_id"), rounds, per_round, seed, "inv")
    k = ("product_id", "round")
    return base.select(
        (F.col("product_id") * ID_STRIDE + F.col("round")).alias("inventory_id"),
        "product_id",
        (F.floor(uniform(seed, *k, tag="st") * 1001)).cast("int").alias("stock"),
        (F.lit(2) + F.floor(uniform(seed, *k, tag="w") * 5)).cast("bigint").alias("warehouse_id"),
        _shift_seconds(_ts(as_of), uniform(seed, *k, tag="r"), 30).alias("restock_date"),
    )


# --------------------------------------------------------------------------- down-sampling

def downsample_products(products: DataFrame, keep: Sequence[int] = (1,)) -> DataFrame:
    """Forced ids plus every other remaining product (1st, 3rd, ... in id order)."""
    forced = F.col("product_id").isin([int(k) for k in keep])
    rest = global_position(products.filter(~forced), ["product_id"])
    odd = rest.filter(F.col("position") % 2 == 1).drop("position")
    return products.filter(forced).unionByName(odd)


def downsample_promotions(promotions: DataFrame, kept: DataFrame) -> DataFrame:
    return promotions.join(kept.select("product_id"), "product_id", "left_semi")


def downsample_inventory(inventory: DataFrame, kept: DataFrame) -> DataFrame:
    """Inventory of kept products with stock halved, rounding up."""
    return (inventory.join(kept.select("product_id"), "product_id", "left_semi")
            .withColumn("stock", F.floor((F.col("stock") + 1) / 2).cast("int")))


def downsample_sales(sales: DataFrame, kept: DataFrame, keep: Sequence[int] = (1,)) -> DataFrame:
    """Sales of kept products: all of the forced ids, and those with an even sale_id otherwise."""
    return (sales.join(kept.select("product_id"), "product_id", "left_semi")
            .filter(F.col("product_id").isin([int(k) for k in keep]) | (F.col("sale_id") % 2 == 0)))


def downsample(tables: dict[str, DataFrame], keep: Sequence[int] = (1,)) -> dict[str, DataFrame]:
    kept = downsample_products(tables["products"], keep)
    out = dict(tables)
    out["products"] = kept
    if "promotions" in tables:
        out["promotions"] = downsample_promotions(tables["promotions"], kept)
    if "inventory" in tables:
        out["inventory"] = downsample_inventory(tables["inventory"], kept)
    if "sales" in tables:
        out["sales"] = downsample_sales(tables["sales"], kept, keep)
    return out
