"""What users do as change rows: (op, before, after) with whole row images, and nothing of rows that stay.

Each function here gives the changes that its namesake in
:mod:`pricetide.operators.changes` makes to a table. It reads the rows that
change, by filters and semi joins on their keys; where a new row needs an id,
``first_id`` can name it, else the largest id is looked up. Given places in a
log (:func:`logged`) they feed the maintained views; :func:`folded` applies them to
a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.rand import random_row
from pricetide.operators import changes as ch
from pricetide.operators.ordering import global_position
from pricetide.streaming import live


def _update(rows: DataFrame, **new: Column) -> DataFrame:
    """Rows (table columns and helpers) as updates: ``new`` columns replace those of the same name; equal images are left out."""
    helpers = [c for c in rows.columns if c.startswith("_")]
    kept = [c for c in rows.columns if c not in helpers]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    image = F.struct(*kept)
    after = F.struct(*[(new[c].cast(kinds[c]) if c in new else F.col(c)).alias(c) for c in kept])
    return rows.select(F.lit("U").alias("op"), image.alias("before"), after.alias("after")).where("NOT (before <=> after)")


def _insert(rows: DataFrame, like: DataFrame) -> DataFrame:
    image = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])
    return rows.select(F.lit("I").alias("op"), _nothing(like).alias("before"), image.alias("after"))


def _delete(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("D").alias("op"), F.struct(*rows.columns).alias("before"), _nothing(rows).alias("after"))


def _nothing(like: DataFrame) -> Column:
    return F.lit(None).cast(like.schema)


def _with_ids(base: DataFrame, rows: DataFrame, id_col: str, order: Sequence[str], first_id: int | None) -> DataFrame:
    if first_id is None:
        return ch.next_ids(base, rows, id_col, order)
    return (global_position(rows, list(order), out="_pos")
            .withColumn(id_col, F.lit(int(first_id) - 1) + F.col("_pos")).drop("_pos"))


def toggle_promotion(products: DataFrame, promotions: DataFrame, product_id: int, as_of, *, first_id: int | None = None) -> DataFrame:
    """Every promotion of the product turned round, or a new one if there is none; an unknown product raises."""
    ts, pid = ch._ts(as_of), F.lit(int(product_id)).cast("bigint")
    mine = promotions.where(F.col("product_id") == pid)
    known = products.where(F.col("product_id") == pid).agg((F.count(F.lit(1)) > 0).alias("_known"))          # one row
    guard = F.when(~F.col("_known"), F.raise_error(F.lit(f"Product with ID {int(product_id)} does not exist"))).otherwise(pid)
    # the guard is part of what is read, so that it is not optimized away
    checked = mine.crossJoin(F.broadcast(known)).withColumn("product_id", guard).drop("_known")
    flipped = _update(checked.select(*promotions.columns), active=~F.col("active"), updated_at=ts)
    none = known.crossJoin(F.broadcast(mine.agg((F.count(F.lit(1)) == 0).alias("_none")))).where("_none")      # one row each
    new = _with_ids(promotions, none.select(guard.alias("product_id")), "promotion_id", ["product_id"], first_id).withColumns({
        "promotion_discount": F.lit(ch.NEW_PROMO_DISCOUNT), "start_date": ts, "end_date": ch._days(ts, ch.NEW_PROMO_DAYS),
        "active": F.lit(True), "updated_at": ts})
    return flipped.unionByName(_insert(new, promotions))


def replenish(inventory: DataFrame, targets: DataFrame, as_of, *, first_id: int | None = None) -> DataFrame:
    """New stock and restock date on every row of the ``targets`` (product_id, stock); a row for those without one."""
    restock = ch._days(ch._ts(as_of), ch.RESTOCK_DAYS)
    wanted = targets.select("product_id", F.col("stock").cast("int").alias("_new"))
    hit = _update(inventory.join(wanted, "product_id").select(*inventory.columns, "_new"), stock=F.col("_new"), restock_date=restock)
    missing = wanted.join(inventory.select("product_id"), "product_id", "left_anti")
    new = _with_ids(inventory, missing, "inventory_id", ["product_id"], first_id).withColumns({
        "stock": F.col("_new"), "warehouse_id": F.lit(1), "restock_date": restock})
    return hit.unionByName(_insert(new, inventory))


def add_to_cart(cart: DataFrame, products: DataFrame, inventory: DataFrame, *, as_of, seed: int = 42, stock: int | None = None,
                smallest: bool = False, seed_product: int = 1) -> dict[str, DataFrame]:
    """Changes of ``shopping_cart`` and ``inventory`` by one round of inserts."""
    ts, one = ch._ts(as_of), F.lit(int(seed_product)).cast("bigint")
    need_one = products.where(F.col("product_id") == one).join(
        cart.where(F.col("product_id") == one).select("product_id").distinct(), "product_id", "left_anti")
    other = random_row(products.where(F.col("product_id") != one), seed, ["product_id"], smallest=smallest)
    names = ["product_id", "product_name", "category_id", "base_price"]
    added = need_one.select(*names).unionByName(other.select(*names)).withColumns({"price": F.col("base_price"), "ts": ts})
    ids = added.select("product_id").distinct()
    wanted = ids.withColumn("stock", F.lit(int(stock))) if stock is not None else ch.seeded_stock(ids, seed)
    return {"shopping_cart": _insert(added, cart), "inventory": replenish(inventory, wanted, as_of)}


def cart_delete(cart: DataFrame, *, seed: int = 42, smallest: bool = False, keep_product: int = 1) -> DataFrame:
    """Every cart line with the ts of one picked line of another product."""
    pick = ch.picked_line(cart, seed=seed, smallest=smallest, keep_product=keep_product).select("ts")        # one row
    return _delete(cart.join(F.broadcast(pick), "ts", "left_semi").select(*cart.columns))


def stock_jitter(cart: DataFrame, inventory: DataFrame, delta: Column | None = None, seed: int = 42) -> DataFrame:
    """Stock of the cart's products after one pass, of the rows that it changes."""
    delta = ch.seeded_delta(seed) if delta is None else delta
    mine = inventory.join(cart.select("product_id").distinct(), "product_id", "left_semi")
    steps = mine.select("product_id", "stock").distinct().withColumn("_d", delta)
    later = Window.partitionBy("product_id").orderBy("stock").rowsBetween(1, Window.unboundedFollowing)
    per = (steps.withColumn("_rest", F.coalesce(F.sum("_d").over(later), F.lit(0)))
           .groupBy("product_id").agg(F.sum("_d").alias("_all"), F.max("_rest").alias("_floor")))
    return _update(mine.join(per, "product_id").select(*inventory.columns, "_all", "_floor"),
                   stock=F.greatest(F.col("_floor"), F.col("stock") + F.col("_all")))


def touch(products: DataFrame, ids: Sequence[int], as_of) -> DataFrame:
    """last_update_time of the given products."""
    mine = products.where(F.col("product_id").isin([int(i) for i in ids]))
    return _update(mine, last_update_time=ch._ts(as_of))


def add_product(tables: dict[str, DataFrame], *, name: str, category_id: int, price: str, as_of, stock: int | None = None,
                seed: int = 42) -> dict[str, DataFrame]:
    """Changes of four tables by a new product with one sale, one stock row and one cart line."""
    products, ts = tables["products"], ch._ts(as_of)
    row = products.sparkSession.range(1).select(F.lit(name).alias("product_name"))
    new = ch.next_ids(products, row, "product_id", ["product_name"]).withColumns({
        "base_price": F.lit(price).cast("decimal(10,2)"), "category_id": F.lit(int(category_id)), "supplier_id": F.lit(1),
        "available": F.lit(True), "last_update_time": ts, "price": F.lit(price).cast("decimal(10,2)"), "ts": ts})
    sale = ch.next_ids(tables["sales"], new.select("product_id", "base_price"), "sale_id", ["product_id"]).withColumns({
        "sale_price": F.col("base_price"), "price": F.col("base_price"), "sale_date": ts})
    wanted = new.select("product_id", F.lit(int(stock)).alias("stock")) if stock is not None else ch.seeded_stock(new, seed)
    return {"products": _insert(new, products), "sales": _insert(sale, tables["sales"]),
            "inventory": replenish(tables["inventory"], wanted, as_of), "shopping_cart": _insert(new, tables["shopping_cart"])}


def folded(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``base`` after the changes, rows counted as often as they are there."""
    return ch.expand_bag(ch.apply_changes_bag(base, ch.weighted(rows)))


def logged(rows: DataFrame, table: str, log: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """The changes as rows of a log, at positions after ``start`` in the order of columns of their images."""
    keyed = rows.select("*", *[F.coalesce(f"after.{c}", f"before.{c}").alias(f"_{c}") for c in order])
    placed = global_position(keyed, [f"_{c}" for c in order])
    return live.changes(placed.withColumn("position", F.col("position") + start), table, log)
