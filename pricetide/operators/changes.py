"""Change algebra: applying change feeds, and the data operations that make them.

Parquet tables take no UPDATE or MERGE, so every operation here is a pure
function ``tables in -> table (or change rows) out``; writing the result as a
new table version is the caller's job (see :mod:`pricetide.streaming`).

Change rows of a keyed table are flat: ``op`` ('I', 'U', 'D'), ``seq`` and the
after image of the row. The key's row with the highest ``seq`` wins (a delete
removes it); equal ``seq`` is broken by the rest of the row, so a replay gives
the same table. For the keyless cart, rows carry a weight (+1 / -1) and the
bag is kept in counted form ``(row..., multiplicity)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions.rand import randint, random_row
from pricetide.operators.ordering import global_position
from pricetide.session import input_bytes

OPS = ("I", "U", "D")


def change_schema(schema: T.StructType) -> T.StructType:
    """Full-image change row: (op, seq, before, after) as in a replica-identity-full feed."""
    return T.StructType([
        T.StructField("op", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("before", schema, True),
        T.StructField("after", schema, True),
    ])


def flatten_changes(changes: DataFrame) -> DataFrame:
    """(op, seq, before, after) -> flat (op, seq, cols...) with the after image (before for deletes)."""
    fields = changes.schema["after"].dataType.fieldNames()
    img = F.when(F.col("op") == "D", F.col("before")).otherwise(F.col("after"))
    return changes.select("op", "seq", *[img[f].alias(f) for f in fields])


def weighted(changes: DataFrame) -> DataFrame:
    """(op, seq, before, after) -> (w, cols...): +after, -before, update = both."""
    fields = changes.schema["after"].dataType.fieldNames()
    pairs = F.array(
        F.struct(F.lit(-1).alias("w"), F.col("before").alias("img")),
        F.struct(F.lit(1).alias("w"), F.col("after").alias("img")),
    )
    rows = changes.select(F.explode(pairs).alias("_p")).filter(F.col("_p.img").isNotNull())
    return rows.select(F.col("_p.w").alias("w"), *[F.col(f"_p.img.{f}").alias(f) for f in fields])


def latest_changes(changes: DataFrame, keys: Sequence[str], columns: Sequence[str],
                   seq: str = "seq", op: str = "op") -> DataFrame:
    """Last change per key as (keys..., _op, cols...), by max(struct) — partial aggregation."""
    payload = [c for c in columns if c not in keys]
    packed = F.struct(F.col(seq).alias("_seq"), F.col(op).alias("_op"), *[F.col(c) for c in payload])
    agg = changes.groupBy(*keys).agg(F.max(packed).alias("_l"))
    return agg.select(*keys, F.col("_l._op").alias("_op"), *[F.col(f"_l.{c}").alias(c) for c in payload])


def apply_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                  seq: str = "seq", op: str = "op") -> DataFrame:
    """Snapshot + inserts/updates/deletes -> current table (same columns as ``base``)."""
    keys = list(keys)
    latest = latest_changes(changes, keys, base.columns, seq, op)
    untouched = base.join(latest.select(*keys), keys, "left_anti")
    upserts = latest.filter(F.col("_op") != "D").select(*base.columns)
    return untouched.unionByName(upserts)


def counted(df: DataFrame) -> DataFrame:
    """Bag in counted form: (cols..., multiplicity)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("multiplicity"))


#: Bytes of input files whose rows one task counts: whole rows are the keys of its hash map.
COUNTED_BYTES = 16 << 20


def apply_changes_bag(base: DataFrame, changes: DataFrame, weight: str = "w") -> DataFrame:
    """Keyless bag + weighted rows -> (cols..., multiplicity) with multiplicity > 0.

    Rows of large inputs are dealt to as many tasks as their files ask for before
    they are counted, so a task's map doesn't grow with the input.
    """
    cols = base.columns
    all_rows = base.select(F.lit(1).alias("_w"), *cols).unionByName(
        changes.select(F.col(weight).cast("int").alias("_w"), *cols))
    tasks = -(-input_bytes(base) // COUNTED_BYTES)
    if tasks > int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        all_rows = all_rows.repartition(tasks, *cols)
    return (all_rows.groupBy(*cols).agg(F.sum("_w").alias("multiplicity"))
            .filter(F.col("multiplicity") > 0))


def expand_bag(bag: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Counted bag -> one row per unit, in chunks of ``chunk`` so no array holds a whole group."""
    cols = [c for c in bag.columns if c != "multiplicity"]
    m = F.col("multiplicity")
    chunks = bag.select(*cols, "multiplicity",
                        F.explode(F.sequence(F.lit(0), ((m - 1) / chunk).cast("bigint"))).alias("_c"))
    return (chunks.repartition(*cols, "_c")
            .select(*cols, F.explode(F.sequence(F.col("_c") * chunk + 1,
                                                F.least(m, (F.col("_c") + 1) * chunk))).alias("_u"))
            .drop("_u"))


# --------------------------------------------------------------------------- filters and inserts by key

def exclude_ids(df: DataFrame, col: str, ids: Sequence[int]) -> DataFrame:
    """Rows whose ``col`` is set and none of ``ids`` (a short list of literals)."""
    kept = df.filter(F.col(col).isNotNull())
    return kept.filter(~F.col(col).isin([int(i) for i in ids])) if ids else kept


def insert_new(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and those ``rows`` whose key it doesn't have yet (INSERT .. ON CONFLICT DO NOTHING)."""
    fresh = rows.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh.select(*base.columns))


# --------------------------------------------------------------------------- ids

def next_ids(base: DataFrame, rows: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Give new ``rows`` ids max(base.id)+1, +2, ... in ``order`` (sequence resync to MAX).

    ``order`` must be a total order of ``rows``; positions are computed without
    a single-partition window (see :mod:`pricetide.operators.ordering`).
    """
    mx = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_mx"))   # one row
    return (global_position(rows, list(order), out="_pos").crossJoin(F.broadcast(mx))
            .withColumn(id_col, F.col("_mx") + F.col("_pos"))
            .drop("_mx", "_pos"))


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def _days(ts: Column, n: int) -> Column:
    return F.timestamp_add("DAY", F.lit(n), ts)


# --------------------------------------------------------------------------- C1

def upsert_log(log: DataFrame, rows: DataFrame, key: str = "view_name", seq: str | None = None) -> DataFrame:
    """Insert-or-replace by ``key``: the new rows win; among them the highest ``seq`` (or last_refresh)."""
    order = seq or "last_refresh"
    old = log.select(*log.columns, F.lit(0).alias("_prio"), F.lit(None).cast("bigint").alias("_s"))
    new = rows.select(*log.columns, F.lit(1).alias("_prio"),
                      F.col(order).cast("bigint").alias("_s") if seq else F.lit(None).cast("bigint").alias("_s"))
    both = old.unionByName(new)
    payload = [c for c in log.columns if c != key]
    packed = F.struct("_prio", "_s", *payload)
    best = both.groupBy(key).agg(F.max(packed).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in payload]).select(*log.columns)


# --------------------------------------------------------------------------- C2

# Fixed values of a new promotion created by a toggle: 10 %, 30 days, active.
NEW_PROMO_DISCOUNT = "10.00"
NEW_PROMO_DAYS = 30


def toggle_promotion(products: DataFrame, promotions: DataFrame, product_id: int, as_of) -> DataFrame:
    """Promotions after a toggle of ``product_id``.

    Every promotion row of the product flips ``active`` and gets ``updated_at``
    = as_of; with none, a new 10 % promotion (as_of .. as_of + 30 days, active)
    is added with id MAX+1. An unknown product raises when the result is computed.
    """
    ts = _ts(as_of)
    pid = F.lit(int(product_id)).cast("bigint")
    mine = F.col("product_id") == pid
    # Two global aggregates: one row each, whatever the table sizes.
    status = (products.filter(mine).agg((F.count(F.lit(1)) > 0).alias("_known"))
              .crossJoin(promotions.filter(mine).agg((F.count(F.lit(1)) > 0).alias("_has"))))
    guard = F.when(~F.col("_known"),
                   F.raise_error(F.lit(f"Product with ID {int(product_id)} does not exist")))
    flipped = promotions.select(*[
        F.when(mine, ~F.col("active")).otherwise(F.col("active")).alias("active") if c == "active" else
        F.when(mine, ts).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at" else
        F.col(c) for c in promotions.columns])
    checked = (flipped.crossJoin(F.broadcast(status.select(F.coalesce(guard, F.lit(0)).alias("_g"))))
               .drop("_g"))
    new_row = status.filter(~F.col("_has")).select(F.coalesce(guard, pid).alias("product_id"))
    new_row = next_ids(promotions, new_row, "promotion_id", ["product_id"]).select(
        "promotion_id", "product_id",
        F.lit(NEW_PROMO_DISCOUNT).cast("decimal(10,2)").alias("promotion_discount"),
        ts.alias("start_date"), _days(ts, NEW_PROMO_DAYS).alias("end_date"),
        F.lit(True).alias("active"), ts.alias("updated_at"))
    return checked.unionByName(new_row.select(*promotions.columns))


# --------------------------------------------------------------------------- C5 / C4

# Replenished stock is drawn from 5..25; restock 30 days ahead.
STOCK_LOW, STOCK_HIGH = 5, 25
RESTOCK_DAYS = 30


def replenish(inventory: DataFrame, targets: DataFrame, as_of) -> DataFrame:
    """Inventory after replenishing ``targets`` (product_id, stock).

    A product without inventory gets one row (warehouse 1); otherwise every one
    of its warehouse rows is overwritten with the new stock and restock date.
    """
    ts = _ts(as_of)
    t = targets.select("product_id", F.col("stock").cast("int").alias("_new"))
    hit = inventory.join(t, "product_id", "left")
    updated = hit.select(*[
        F.coalesce(F.col("_new"), F.col("stock")).alias("stock") if c == "stock" else
        F.when(F.col("_new").isNotNull(), _days(ts, RESTOCK_DAYS)).otherwise(F.col("restock_date"))
        .alias("restock_date") if c == "restock_date" else F.col(c) for c in inventory.columns])
    missing = t.join(inventory.select("product_id"), "product_id", "left_anti")
    new_rows = next_ids(inventory, missing, "inventory_id", ["product_id"]).select(
        "inventory_id", "product_id", F.col("_new").alias("stock"),
        F.lit(1).cast("bigint").alias("warehouse_id"), _days(ts, RESTOCK_DAYS).alias("restock_date"))
    return updated.unionByName(new_rows.select(*inventory.columns))


def seeded_stock(products: DataFrame, seed: int) -> DataFrame:
    """(product_id, stock) with stock uniform in 5..25 from a seeded hash."""
    return products.select("product_id", randint(seed, STOCK_LOW, STOCK_HIGH, "product_id", tag="stock")
                           .alias("stock"))


def add_to_cart(cart: DataFrame, products: DataFrame, inventory: DataFrame, *, as_of, seed: int = 42,
                stock: int | None = None, smallest: bool = False, seed_product: int = 1):
    """One cart insert round: product 1 if absent, then one other product; returns (cart, inventory).

    Added lines are priced at the product's base price; each added product's
    stock is replenished (5..25 seeded, or ``stock``). ``smallest=True`` picks
    the smallest other id instead of a seeded random one.
    """
    ts = _ts(as_of)
    one = F.lit(int(seed_product)).cast("bigint")
    line = lambda p: p.select("product_id", "product_name", "category_id",
                              F.col("base_price").alias("price"), ts.alias("ts"))
    need_one = (products.filter(F.col("product_id") == one)
                .join(cart.filter(F.col("product_id") == one).select("product_id").distinct(),
                      "product_id", "left_anti"))
    other = random_row(products.filter(F.col("product_id") != one), seed, ["product_id"], smallest=smallest)
    added = line(need_one).unionByName(line(other))
    new_cart = cart.unionByName(added.select(*cart.columns))
    ids = added.select("product_id").distinct()
    tgt = (ids.select("product_id", F.lit(int(stock)).alias("stock")) if stock is not None
           else seeded_stock(ids, seed))
    return new_cart, replenish(inventory, tgt, as_of)


# --------------------------------------------------------------------------- C6

def picked_line(cart: DataFrame, *, seed: int, smallest: bool, keep_product: int) -> DataFrame:
    """One cart line (ts, product_id) of another product than ``keep_product``."""
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    lines = exclude_ids(cart, "product_id", [keep_product]).select("ts", since.alias("_at"), "product_id")
    return random_row(lines, seed, ["_at", "product_id"], smallest=smallest).select("ts", "product_id")


def cart_delete(cart: DataFrame, *, seed: int = 42, smallest: bool = False, keep_product: int = 1) -> DataFrame:
    """Delete every cart line whose ts equals the ts of one line of another product than 1."""
    pick = picked_line(cart, seed=seed, smallest=smallest, keep_product=keep_product).select("ts")
    return cart.join(F.broadcast(pick), "ts", "left_anti")   # one row


# --------------------------------------------------------------------------- C7

def seeded_delta(seed: int) -> Column:
    """+-1..5 from a seeded hash of (product_id, stock)."""
    mag = randint(seed, 1, 5, "product_id", "stock", tag="jit")
    sign = F.when(randint(seed, 0, 1, "product_id", "stock", tag="dir") == 1, 1).otherwise(-1)
    return mag * sign


def stock_jitter(cart: DataFrame, inventory: DataFrame, delta: Column | None = None, seed: int = 42) -> DataFrame:
    """Inventory after one jitter pass over the cart's products.

    As in the reference, each distinct (product, stock) of the cart's
    inventory rows draws a delta and updates *all* rows of the product with
    ``greatest(0, stock + delta)``, one after the other (here in ascending
    stock order). k clamped additions compose into ``max(C, x + B)`` with B the
    sum of the deltas and C the largest suffix sum (0 included), so the
    k updates are applied at once with a window over the product's distinct
    stock values.
    """
    delta = delta if delta is not None else seeded_delta(seed)
    pairs = (cart.select("product_id").distinct()
             .join(inventory.select("product_id", "stock"), "product_id").distinct()
             .withColumn("_d", delta))
    w_suffix = (Window.partitionBy("product_id").orderBy("stock")
                .rowsBetween(1, Window.unboundedFollowing))
    per = (pairs.withColumn("_after", F.coalesce(F.sum("_d").over(w_suffix), F.lit(0)))
           .groupBy("product_id").agg(F.sum("_d").alias("_B"), F.max("_after").alias("_C")))
    joined = inventory.join(per, "product_id", "left")
    return joined.select(*[
        F.when(F.col("_B").isNull(), F.col("stock"))
        .otherwise(F.greatest(F.col("_C"), F.col("stock") + F.col("_B"))).cast("int").alias("stock")
        if c == "stock" else F.col(c) for c in inventory.columns])


# --------------------------------------------------------------------------- C3 / C8

def add_product(tables: dict, *, name: str, category_id: int, price: str, as_of,
                stock: int | None = None, seed: int = 42) -> dict:
    """New product (id MAX+1, supplier 1, available) with one sale, one stock row and one cart line."""
    products, sales, inventory, cart = (tables["products"], tables["sales"], tables["inventory"],
                                        tables["shopping_cart"])
    spark: SparkSession = products.sparkSession
    ts = _ts(as_of)
    row = spark.range(1).select(F.lit(name).alias("product_name"))
    prod = next_ids(products, row, "product_id", ["product_name"]).select(
        "product_id", "product_name", F.lit(price).cast("decimal(10,2)").alias("base_price"),
        F.lit(int(category_id)).cast("bigint").alias("category_id"),
        F.lit(1).cast("bigint").alias("supplier_id"), F.lit(True).alias("available"),
        ts.alias("last_update_time"))
    sale = next_ids(sales, prod.select("product_id", "base_price"), "sale_id", ["product_id"]).select(
        "sale_id", "product_id", F.col("base_price").cast(sales.schema["sale_price"].dataType).alias("sale_price"),
        ts.alias("sale_date"), F.col("base_price").cast(sales.schema["price"].dataType).alias("price"))
    st = (prod.select("product_id", F.lit(int(stock)).alias("stock")) if stock is not None
          else seeded_stock(prod, seed))
    out = dict(tables)
    out["products"] = products.unionByName(prod.select(*products.columns))
    out["sales"] = sales.unionByName(sale.select(*sales.columns))
    out["inventory"] = replenish(inventory, st, as_of)
    out["shopping_cart"] = cart.unionByName(prod.select(
        "product_id", "product_name", "category_id", F.col("base_price").alias("price"),
        ts.alias("ts")).select(*cart.columns))
    return out


def touch(products: DataFrame, ids: Sequence[int], as_of) -> DataFrame:
    """last_update_time = as_of for the given products (the heartbeat's touch of product 1)."""
    hit = F.col("product_id").isin([int(i) for i in ids])
    return products.select(*[F.when(hit, _ts(as_of)).otherwise(F.col(c)).alias(c) if c == "last_update_time"
                             else F.col(c) for c in products.columns])
