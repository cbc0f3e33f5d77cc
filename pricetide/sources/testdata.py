"""Retail tables derived from the driver's TPC-H-like parquet tables.

Every table here is a pure DataFrame derivation of the given tables, so the
work grows with them. Derivation rule (the same rule is written as DuckDB SQL
in ``pricetide.plans.oracle``):

* categories: regions are roots (``1 + r_regionkey``), nations their children
  (``101 + n_nationkey``), four leaves per nation (``1000 + 10*n_nationkey + k``).
* products: one per part; ``'Cheap'`` replaces the PROMO type in the name;
  every fifth part sits directly in a nation category, the rest in a leaf.
* sales: every lineitem (list price = extended price, paid price after discount).
* inventory: returned lineitems (flag ``R``) summed per part and warehouse
  ``1 + l_suppkey % 5``.
* promotions: lineitems with zero tax; active when the return flag is ``A``.
* shopping_cart: lines of open orders (status ``O``) priced at base price.
* query_log: events (type = source, value = latency in ms).
* heartbeats: ``signup`` events; the replica holds those at least one hour
  older than the newest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAVES_PER_NATION = 4


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read_raw(spark, sf_dir, "region")
    nation = read_raw(spark, sf_dir, "nation")
    roots = region.select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("category_id"),
        F.col("r_name").alias("category_name"),
        F.lit(None).cast("bigint").alias("parent_id"),
    )
    mids = nation.select(
        (F.col("n_nationkey") + 101).cast("bigint").alias("category_id"),
        F.col("n_name").alias("category_name"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("parent_id"),
    )
    leaves = (
        nation.select("n_nationkey", "n_name",
                      F.explode(F.sequence(F.lit(0), F.lit(LEAVES_PER_NATION - 1))).alias("k"))
        .select(
            (F.col("n_nationkey") * 10 + F.col("k") + 1000).cast("bigint").alias("category_id"),
            F.concat_ws(" ", "n_name", F.col("k").cast("string")).alias("category_name"),
            (F.col("n_nationkey") + 101).cast("bigint").alias("parent_id"),
        )
    )
    return roots.unionByName(mids).unionByName(leaves)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_raw(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(
        k.cast("bigint").alias("product_id"),
        F.concat_ws(" ", "p_name",
                    F.when(F.col("p_type") == "PROMO", F.lit("Cheap")).otherwise(F.col("p_type"))
                    ).alias("product_name"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("base_price"),
        F.when(k % 5 == 0, (k % 25) + 101)
         .otherwise((k % 25) * 10 + (F.col("p_size") % LEAVES_PER_NATION) + 1000)
         .cast("bigint").alias("category_id"),
        (k % 100).cast("bigint").alias("supplier_id"),
        (F.col("p_size") % 5 != 0).alias("available"),
        F.timestamp_add("MINUTE", k, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
         .alias("last_update_time"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_raw(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("sale_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        (price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
        .cast("decimal(18,4)").alias("sale_price"),
        F.col("l_shipdate").alias("sale_date"),
        price.alias("price"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_raw(spark, sf_dir, "lineitem")
    return (
        li.filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_partkey").cast("bigint").alias("product_id"),
                 (F.col("l_suppkey") % 5 + 1).cast("bigint").alias("warehouse_id"))
        .agg(F.sum("l_quantity").cast("int").alias("stock"),
             F.max("l_shipdate").alias("restock_date"))
        .select((F.col("product_id") * 10 + F.col("warehouse_id")).alias("inventory_id"),
                "product_id", "stock", "warehouse_id", "restock_date")
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_raw(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_tax") == 0).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("promotion_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        F.round(F.col("l_discount") * 100).cast("decimal(10,2)").alias("promotion_discount"),
        F.col("l_shipdate").alias("start_date"),
        F.timestamp_add("DAY", F.lit(30), F.col("l_shipdate")).alias("end_date"),
        (F.col("l_returnflag") == "A").alias("active"),
        F.col("l_shipdate").alias("updated_at"),
    )


def shopping_cart(spark: SparkSession, sf_dir: str, prods: DataFrame | None = None) -> DataFrame:
    orders = read_raw(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O")
    li = read_raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    prods = prods if prods is not None else products(spark, sf_dir)
    return (
        orders.join(li, orders.o_orderkey == li.l_orderkey)
        .join(prods, F.col("l_partkey") == prods.product_id)
        .select(prods.product_id, prods.product_name, prods.category_id,
                prods.base_price.alias("price"), F.col("o_orderdate").alias("ts"))
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_raw(spark, sf_dir, "supplier")
    return sup.select(F.col("s_suppkey").cast("bigint").alias("supplier_id"),
                      F.col("s_name").alias("supplier_name"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_raw(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("source"),
        F.col("value").alias("latency_ms"),
        F.col("user_id").alias("product_id"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_raw(spark, sf_dir, "events")
    return ev.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("id"), "ts")


def replica_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats the replica has seen: those at least one hour older than the newest."""
    hb = heartbeats(spark, sf_dir)
    newest = hb.agg(F.max("ts").alias("newest_ts"))
    return (hb.crossJoin(F.broadcast(newest))  # one row
            .filter(F.col("ts") <= F.col("newest_ts") - F.expr("INTERVAL 1 HOUR"))
            .select("id", "ts"))


@dataclass
class RetailTables:
    """Lazily derived retail tables of one scale-factor folder."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def _get(self, name, fn):
        if name not in self._cache:
            self._cache[name] = fn()
        return self._cache[name]

    @property
    def categories(self) -> DataFrame:
        return self._get("categories", lambda: categories(self.spark, self.sf_dir))

    @property
    def products(self) -> DataFrame:
        return self._get("products", lambda: products(self.spark, self.sf_dir))

    @property
    def sales(self) -> DataFrame:
        return self._get("sales", lambda: sales(self.spark, self.sf_dir))

    @property
    def inventory(self) -> DataFrame:
        return self._get("inventory", lambda: inventory(self.spark, self.sf_dir))

    @property
    def promotions(self) -> DataFrame:
        return self._get("promotions", lambda: promotions(self.spark, self.sf_dir))

    @property
    def shopping_cart(self) -> DataFrame:
        return self._get("shopping_cart",
                         lambda: shopping_cart(self.spark, self.sf_dir, self.products))

    @property
    def suppliers(self) -> DataFrame:
        return self._get("suppliers", lambda: suppliers(self.spark, self.sf_dir))

    @property
    def query_log(self) -> DataFrame:
        return self._get("query_log", lambda: query_log(self.spark, self.sf_dir))

    @property
    def heartbeats(self) -> DataFrame:
        return self._get("heartbeats", lambda: heartbeats(self.spark, self.sf_dir))

    @property
    def replica_heartbeats(self) -> DataFrame:
        return self._get("replica_heartbeats",
                         lambda: replica_heartbeats(self.spark, self.sf_dir))


def retail_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    return RetailTables(spark, sf_dir)


# --------------------------------------------------------------------------- change feeds

def product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat product change rows from events: signup = insert, error = delete, others = update.

    seq = event_id; the after image is built from the event (user -> product).
    """
    ev = read_raw(spark, sf_dir, "events")
    uid = F.col("user_id")
    return ev.select(
        F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I")
         .otherwise("U").alias("op"),
        F.col("event_id").alias("seq"),
        uid.cast("bigint").alias("product_id"),
        F.concat_ws(" ", F.lit("Product"), uid.cast("string"), F.col("event_type")).alias("product_name"),
        F.col("value").cast("decimal(10,2)").alias("base_price"),
        ((uid % 25) * 10 + uid % LEAVES_PER_NATION + 1000).cast("bigint").alias("category_id"),
        (uid % 100).cast("bigint").alias("supplier_id"),
        (F.col("value") >= 1).alias("available"),
        F.col("ts").alias("last_update_time"),
    )


def cart_changes(spark: SparkSession, sf_dir: str, prods: DataFrame | None = None) -> DataFrame:
    """Weighted cart rows: +1 per line of a pending order (status P), -1 per returned open line."""
    return cart_change_lines(spark, sf_dir, prods).drop("order_id", "line")


def cart_change_lines(spark: SparkSession, sf_dir: str, prods: DataFrame | None = None) -> DataFrame:
    """:func:`cart_changes` with the order and line that each comes from, which tell equal rows apart."""
    orders = read_raw(spark, sf_dir, "orders")
    li = read_raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    prods = prods if prods is not None else products(spark, sf_dir)
    lines = (orders.join(li, orders.o_orderkey == li.l_orderkey)
             .join(prods, F.col("l_partkey") == prods.product_id))
    w = (F.when(F.col("o_orderstatus") == "P", F.lit(1))
         .when((F.col("o_orderstatus") == "O") & (F.col("l_returnflag") == "R"), F.lit(-1)))
    return (lines.select(w.alias("w"), prods.product_id, prods.product_name, prods.category_id,
                         prods.base_price.alias("price"), F.col("o_orderdate").alias("ts"),
                         F.col("o_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))
            .filter(F.col("w").isNotNull()))
