"""Stored prices, cart sums and category totals that follow a log of changes by what changes.

A change is one row of a log: ``(log, position, table, op, before, after)``, the
images as JSON of the table's columns; its place in the log is its identity. So
a value that returns to what it was counts again, and a change delivered twice
doesn't: per log the positions seen are kept as intervals, one while nothing is
missing, whatever the number of changes. A snapshot names the position of each
log up to which each table has it; changes at or below are in it already.

Sales, promotions, stock and cart lines are kept as counted rows, to which a
change adds its images with sign -1 and +1. Of products and categories the row
with the highest position counts. A micro-batch

1. appends the signed images of its new changes,
2. computes the facts of the products that they touch (sales count, mean of the
   ten newest prices, smallest active discount, stock), from their rows alone,
3. moves them in the counted histograms of sales counts per category and of
   stock, whose 3rd and 10th largest values are the edges of the bands; where an
   edge moves, the products between its old and its new value change too,
4. stores the new prices and logs each change of a price (old, new),
5. takes cart lines whose price, category or count changed out of their category's
   sum and puts them into it again with what they are now, and carries the
   difference to all ancestors, after a change of the tree to the old and the
   new ones.

No step reads a whole table of sales, stock or cart lines, and only products
beside a moved edge are read beyond those touched. Views are read as of a
version; all views of one :class:`Reader` are of the same one, and what it reads
is not removed while its lease lasts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricetide.functions import factors as fx
from pricetide.operators import cart as cartops
from pricetide.operators import hierarchy, pricing
from pricetide.session import input_bytes, written
from pricetide.streaming.buckets import LoggedTable
from pricetide.streaming.maintain import JSON_OPTIONS

FEED_SCHEMA = T.StructType([T.StructField(name, T.LongType() if name == "position" else T.StringType())
                            for name in ("log", "position", "table", "op", "before", "after")])

#: Columns that an image must have, per table.
IMAGES = {
    "products": "product_id bigint, product_name string, base_price decimal(10,2), category_id bigint, "
                "last_update_time timestamp_ntz",
    "sales": "product_id bigint, sale_date timestamp_ntz, price decimal(20,4), sale_price decimal(20,4)",
    "promotions": "product_id bigint, promotion_discount decimal(10,2), active boolean",
    "inventory": "product_id bigint, stock bigint",
    "shopping_cart": "product_id bigint, product_name string",
    "categories": "category_id bigint, category_name string, parent_id bigint",
}
_NEWEST = ("products", "categories")
_PRICED = ("products", "sales", "promotions", "inventory")
_FACTS = ("product_name string, base_price decimal(10,2), category_id bigint, last_update_time timestamp_ntz, "
          "sale_count bigint, avg_price double, promotion_discount decimal(10,2), total_stock bigint")
_BANDS = "popularity_adjustment double, stock_adjustment double, live_price decimal(20,6)"
#: What is kept: table -> (columns, key).
KEPT = {
    "products": ("product_id bigint, seq bigint, op string, product_name string, base_price decimal(10,2), "
                 "category_id bigint, last_update_time timestamp_ntz", "product_id"),
    "sales": ("product_id bigint, sale_date timestamp_ntz, price decimal(20,4), n bigint, amount decimal(38,4)", "product_id"),
    "promotions": ("product_id bigint, promotion_discount decimal(10,2), n bigint", "product_id"),
    "inventory": ("product_id bigint, n bigint, stock bigint", "product_id"),
    "shopping_cart": ("product_id bigint, product_name string, n bigint", "product_id"),
    "categories": ("category_id bigint, seq bigint, op string, category_name string, parent_id bigint", "category_id"),
    "prices": (f"product_id bigint, seq bigint, priced boolean, {_FACTS}, {_BANDS}", "product_id"),
    "ranks": ("scope string, value bigint, n bigint", "scope"),
    "direct": ("category_id bigint, total decimal(38,10), item_count bigint", "category_id"),
    "closure": ("category_id bigint, ancestor_id bigint, n bigint", "category_id"),
    "totals": ("category_id bigint, total decimal(38,10), item_count bigint", "category_id"),
}
_STOCK = "stock"
_EDGES = [edge for edge, _ in fx.POPULARITY_BANDS]


def together(*steps: Callable[[], object]) -> list:
    """Run steps that don't depend on each other as jobs side by side."""
    with ThreadPoolExecutor(len(steps) or 1) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


# --------------------------------------------------------------------------- log

def changes(rows: DataFrame, table: str, log: str, position: str = "position") -> DataFrame:
    """Change rows (position, op, before, after structs of the table's columns or null) as rows of the log."""
    image = lambda c: F.to_json(c, JSON_OPTIONS) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(log).alias("log"), F.col(position).cast("bigint").alias("position"), F.lit(table).alias("table"),
                       F.col("op").cast("string").alias("op"), image("before").alias("before"), image("after").alias("after"))


#: A log's positions are looked up, numbered and joined in blocks of 2 ** BLOCK_BITS, each by one task.
BLOCK_BITS = 8


def _block(position: Column | str) -> Column:
    return F.shiftright(position, BLOCK_BITS)


def _first(block: Column | str) -> Column:
    return F.shiftleft(block, BLOCK_BITS)


def _by_block(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals as at most two parts of a block each, (log, _block, lo, hi), and the blocks between that they hold whole,
    (log, _from, _upto)."""
    a, b, start, stop = (F.col(c) for c in ("_a", "_b", "_from", "_upto"))
    at = seen.select("log", "lo", "hi", _block("lo").alias("_a"), _block("hi").alias("_b"))
    at = at.withColumns({"_from": F.when(F.col("lo") == _first("_a"), a).otherwise(a + 1),
                         "_upto": F.when(F.col("hi") == _first(b + 1) - 1, b).otherwise(b - 1)})
    head = F.when((start > a) | ((a == b) & (stop < b)),
                  F.struct(a.alias("_block"), F.col("lo").alias("lo"), F.least("hi", _first(a + 1) - 1).alias("hi")))
    tail = F.when((b > a) & (stop < b), F.struct(b.alias("_block"), _first(b).alias("lo"), F.col("hi").alias("hi")))
    parts = at.select("log", F.explode(F.array(head, tail)).alias("p")).where("p IS NOT NULL").select("log", "p.*")
    return parts, at.where("_from <= _upto").select("log", "_from", "_upto")


def _upto(at: str, hi: str, *keys: str) -> Column:
    """The last place that an interval (at, hi) in the group holds which begins at or before a row's; of other rows ``hi`` is null."""
    order = Window.partitionBy(*keys).orderBy(at, F.desc_nulls_last(hi))
    return F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, 0))


def _outside(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (log, position, ..) whose position no interval of ``seen`` holds, each position once.

    Rows and intervals meet inside blocks, in the order of their positions: the
    work follows their numbers, however many intervals a log has. Of a whole log
    a task takes no more than the numbers of its blocks.
    """
    parts, whole = _by_block(seen)
    placed = rows.withColumns({"_block": _block("position"), "_hi": F.lit(None).cast("bigint")})
    blocks = placed.select("log", "_block").distinct().withColumn("_hi", F.lit(None).cast("bigint"))
    blocks = (blocks.unionByName(whole.select("log", F.col("_from").alias("_block"), F.col("_upto").alias("_hi")))
              .withColumn("_upto", _upto("_block", "_hi", "log")).where("_hi IS NULL AND _upto >= _block"))
    marks = parts.unionByName(blocks.select("log", "_block", _first("_block").alias("lo"), (_first(F.col("_block") + 1) - 1).alias("hi")))
    every = placed.unionByName(marks.select("log", F.col("lo").alias("position"), "_block", F.col("hi").alias("_hi")), allowMissingColumns=True)
    before = F.lag("position").over(Window.partitionBy("log", "_block").orderBy("position", F.desc_nulls_last("_hi")))
    return (every.withColumns({"_upto": _upto("position", "_hi", "log", "_block"), "_before": before})
            .where("_hi IS NULL AND (_upto IS NULL OR _upto < position) AND NOT (_before <=> position)").select(*rows.columns))


def not_seen(batch: DataFrame, seen: DataFrame, cuts: DataFrame) -> DataFrame:
    """Changes of ``batch`` that no interval of ``seen`` (log, lo, hi) holds and that no snapshot (``cuts``) has, each once."""
    return _uncut(_outside(_placed(batch), seen), cuts)


def _placed(batch: DataFrame) -> DataFrame:
    return batch.where("log IS NOT NULL AND position IS NOT NULL")


def _uncut(fresh: DataFrame, cuts: DataFrame) -> DataFrame:
    """Changes that no snapshot has."""
    cuts = F.broadcast(cuts.select("log", "table", F.col("position").alias("_cut")))               # one row a log and table
    return fresh.join(cuts, ["log", "table"], "left").where("_cut IS NULL OR position > _cut").drop("_cut")


def _joined(intervals: DataFrame, *keys: str) -> DataFrame:
    """Intervals (keys, lo, hi) that touch as one."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = (intervals.withColumn("_new", F.when(F.col("lo") <= before + 1, 0).otherwise(1))
                .withColumn("_at", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return numbered.groupBy(*keys, "_at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_at")


def with_seen(seen: DataFrame, batch: DataFrame) -> DataFrame:
    """The intervals of ``seen`` and of the batch's positions, joined where they touch.

    Positions that an interval holds already are left out, else each of a sparse
    second delivery would be a row.
    """
    return _with_new(seen, _outside(_placed(batch).select("log", "position"), seen))


def _with_new(seen: DataFrame, new: DataFrame) -> DataFrame:
    """The intervals of ``seen`` and positions (log, position) outside them, joined where they touch.

    They are joined inside blocks, and then those at a block's edge, at most two
    a block, with what lies beyond it: a log of many positions, or of many
    intervals, is numbered in many tasks.
    """
    parts, whole = _by_block(seen)
    at = new.select("log", _block("position").alias("_block"), F.col("position").alias("lo"), F.col("position").alias("hi"))
    inside = _joined(at.unionByName(parts), "log", "_block")
    edge = (F.col("lo") == _first("_block")) | (F.col("hi") == _first(F.col("_block") + 1) - 1)
    every = inside.withColumn("_block", F.when(~edge, F.col("_block"))).unionByName(whole.select(
        "log", F.lit(None).cast("bigint").alias("_block"), _first("_from").alias("lo"), (_first(F.col("_upto") + 1) - 1).alias("hi")))
    return _joined(every, "log", "_block").select("log", "lo", "hi")


def _images(fresh: DataFrame, table: str) -> DataFrame:
    """(op, seq, w, columns): both images of each change of a table; of products and categories the newest state alone."""
    rows, kind = fresh.where(F.col("table") == table), IMAGES[table]
    if table in _NEWEST:
        state = F.when(F.col("op") == "D", F.col("before")).otherwise(F.col("after"))
        return (rows.select("op", F.col("position").alias("seq"), F.lit(1).alias("w"),
                            F.from_json(state, kind, JSON_OPTIONS).alias("i")).select("op", "seq", "w", "i.*"))
    both = F.explode(F.array(F.struct(F.lit(-1).alias("w"), F.col("before").alias("i")),
                             F.struct(F.lit(1).alias("w"), F.col("after").alias("i"))))
    return (rows.select("op", F.col("position").alias("seq"), both.alias("x")).where("x.i IS NOT NULL")
            .select("op", "seq", "x.w", F.from_json("x.i", kind, JSON_OPTIONS).alias("i")).select("op", "seq", "w", "i.*"))


# --------------------------------------------------------------------------- adding up

def _newest(key: str):
    def add_up(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, "seq")]
        return (rows.groupBy(key).agg(F.max(F.struct("seq", F.struct(*rest).alias("r"))).alias("b"))
                .select(key, "b.seq", *[F.col(f"b.r.{c}").alias(c) for c in rest]).select(*rows.columns))
    return add_up


def _summed(*measures: str):
    def add_up(rows: DataFrame) -> DataFrame:
        keys, kinds = [c for c in rows.columns if c not in measures], dict(rows.dtypes)
        left = " OR ".join(f"{m} <> 0" for m in measures)
        return (rows.groupBy(*keys).agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in measures]).where(left).select(*rows.columns))
    return add_up


_ADD_UP = {"products": _newest("product_id"), "categories": _newest("category_id"), "prices": _newest("product_id"),
           "sales": _summed("n", "amount"), "promotions": _summed("n"), "inventory": _summed("n", "stock"),
           "shopping_cart": _summed("n"), "ranks": _summed("n"), "closure": _summed("n"),
           "direct": _summed("total", "item_count"), "totals": _summed("total", "item_count")}


def _signed(table: str, rows: DataFrame) -> DataFrame:
    """Images (op, seq, w, columns) in the form of the kept table."""
    w = F.col("w").cast("bigint")
    if table in _NEWEST:
        return rows.drop("w")
    if table == "sales":
        return rows.select("product_id", "sale_date", F.col("price").cast("decimal(20,4)").alias("price"), w.alias("n"),
                           (w * F.col("sale_price")).cast("decimal(38,4)").alias("amount"))
    if table == "promotions":
        return rows.where("active").select("product_id", "promotion_discount", w.alias("n"))
    if table == "inventory":
        return rows.select("product_id", w.alias("n"), (w * F.coalesce("stock", F.lit(0))).cast("bigint").alias("stock"))
    return rows.select("product_id", "product_name", w.alias("n"))


# --------------------------------------------------------------------------- facts and bands

def newest_mean(sales: DataFrame, n: int = fx.RECENT_SALES) -> DataFrame:
    """(product_id, avg_price) over the ``n`` newest of counted sales (product_id, sale_date, price, n)."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("sale_date"), F.desc("price"))
    top = (sales.where("n > 0").select("product_id", "sale_date", "price", F.col("n").alias("_n"))
           .withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)
           .withColumn("room", n - F.coalesce(F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("take", F.greatest(F.lit(0), F.least("_n", "room"))))
    return top.groupBy("product_id").agg(
        (F.sum(F.col("price") * F.col("take")).cast("double") / F.sum("take")).alias("avg_price"))


def _counted(sales: DataFrame) -> DataFrame:
    """Rows of sales as (product_id, sale_date, price, n), each once."""
    return sales.groupBy("product_id", "sale_date", "price").agg(F.sum("n").alias("n"))


def _sale_counts(sales: DataFrame) -> DataFrame:
    """(product_id, sale_count) of rows of sales, added up or not."""
    return sales.groupBy("product_id").agg(F.sum("n").alias("sale_count")).where("sale_count > 0")


def _facts(products: DataFrame, counts: DataFrame, sales: DataFrame, promotions: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row a product that any of the tables holds; ``base_price`` and the like are null where there is no product.

    ``sales`` are counted rows of which none takes another back.
    """
    best = promotions.where("n > 0").groupBy("product_id").agg(F.min("promotion_discount").alias("promotion_discount"))
    stock = inventory.where("n > 0").select("product_id", F.col("stock").alias("total_stock"))
    out = products.where("op <> 'D'").select("product_id", F.lit(True).alias("known"), "product_name", "base_price", "category_id",
                                             "last_update_time")
    for part in (counts, newest_mean(sales), best, stock):
        out = out.join(part, "product_id", "full")
    names = [f.split()[0] for f in _FACTS.split(", ")]
    return out.select("product_id", (F.coalesce("known", F.lit(False)) & F.col("sale_count").isNotNull()
                                     & F.col("category_id").isNotNull()).alias("priced"), *names)


def _places(facts: DataFrame, sign: int) -> DataFrame:
    """Where facts stand in the histograms: (scope, value, n)."""
    popular = facts.where("priced").select(F.concat(F.lit("c"), "category_id").alias("scope"), F.col("sale_count").alias("value"))
    stocked = facts.where("total_stock IS NOT NULL").select(F.lit(_STOCK).alias("scope"), F.col("total_stock").alias("value"))
    return popular.unionByName(stocked).withColumn("n", F.lit(sign).cast("bigint"))


def band_edges(ranks: DataFrame) -> DataFrame:
    """(scope, t3, t10) of counted values (scope, value, n): the values that are 3rd and 10th from the top, null if there are fewer.

    At most ten different values of a scope matter; the limit is applied before the shuffle.
    """
    order = Window.partitionBy("scope").orderBy(F.desc("value"))
    top = (ranks.where("n > 0").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max(_EDGES))
           .withColumn("_upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return top.groupBy("scope").agg(*[F.max(F.when(F.col("_upto") >= k, F.col("value"))).alias(f"t{k}") for k in _EDGES])


def _popularity(count: Column | str, t: str = "t") -> Column:
    return fx.band_by_threshold(count, [f"{t}{k}" for k in _EDGES], [f for _, f in fx.POPULARITY_BANDS], fx.POPULARITY_OTHERWISE)


def _stocked(stock: Column | str, t: str) -> Column:
    return fx.band_by_threshold(stock, [f"{t}{k}" for k, _ in fx.STOCK_BANDS], [f for _, f in fx.STOCK_BANDS], fx.STOCK_OTHERWISE)


def _price(rows: DataFrame) -> DataFrame:
    """``live_price`` from facts and bands; null for a product without a price."""
    price = fx.live_price("base_price", "popularity_adjustment", fx.promo_factor("promotion_discount"), "stock_adjustment",
                          fx.demand_factor("base_price", "avg_price"), fx.name_factor("product_name"))
    return rows.withColumn("live_price", F.when(F.col("priced"), price))


def _lines(cart: DataFrame, prices: DataFrame, categories: DataFrame, sign: int) -> DataFrame:
    """What cart lines add to their category's sum, with a sign: a line counts once however often it is in the cart."""
    return (cart.where("n > 0").select("product_id", "product_name")
            .join(prices.where("priced").select("product_id", "category_id", "live_price"), "product_id")
            .join(categories.where("op <> 'D'").select("category_id"), "category_id", "left_semi")
            .where("live_price IS NOT NULL")
            .select("category_id", (sign * F.col("live_price")).cast("decimal(38,10)").alias("total"),
                    F.lit(sign).cast("bigint").alias("item_count")))


def _pairs(categories: DataFrame) -> DataFrame:
    """(category_id, ancestor_id, n = 1) of the tree, itself included."""
    tree = categories.where("op <> 'D'").select("category_id", "parent_id")
    return hierarchy.ancestor_closure(tree).select("category_id", "ancestor_id", F.lit(1).cast("bigint").alias("n"))


# --------------------------------------------------------------------------- views

class LiveViews:
    """The kept tables under ``root``. ``load`` gives version 0; micro-batch b gives version b + 1."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int | None = None):
        self.spark, self.root = spark, root
        self.tables = {n: LoggedTable(spark, f"{root}/{n}", ddl, key, _ADD_UP[n], buckets) for n, (ddl, key) in KEPT.items()}

    # ---- loading

    def load(self, snapshot: Mapping[str, DataFrame], positions: Mapping[tuple[str, str], int] | None = None) -> None:
        """``snapshot``: table -> rows; ``positions``: (log, table) -> the last position of the log that the table's rows include."""
        t = self.tables

        def load(name: str, columns: str) -> None:
            if name in snapshot:
                rows = snapshot[name].select(F.lit("I").alias("op"), F.lit(-1).cast("bigint").alias("seq"), F.lit(1).alias("w"),
                                             *T.StructType.fromDDL(columns).fieldNames())
                kept = _signed(name, rows)
                if name == "sales":     # hardly ever alike: equal rows are added up when they are read
                    t[name].load(kept, input_bytes(snapshot[name]))
                else:
                    t[name].load(kept if name in _NEWEST else _ADD_UP[name](kept))
            else:
                t[name].load(self.spark.createDataFrame([], t[name].schema))

        def price() -> None:
            sales = t["sales"].read(0)          # a snapshot takes nothing back
            facts = written(_facts(t["products"].now(0), _sale_counts(sales), sales, t["promotions"].now(0), t["inventory"].now(0)), "facts")
            t["ranks"].load(_ADD_UP["ranks"](_places(facts, 1)))
            banded = self._banded(facts.withColumn("seq", F.lit(0).cast("bigint")), band_edges(t["ranks"].now(0)))
            t["prices"].load(_price(banded).select(*t["prices"].schema.fieldNames()))
            t["direct"].load(_ADD_UP["direct"](_lines(t["shopping_cart"].now(0), t["prices"].now(0), t["categories"].now(0), 1)))

        together(*[lambda n=n, c=c: load(n, c) for n, c in IMAGES.items()])
        together(price, lambda: t["closure"].load(_pairs(t["categories"].now(0))))
        t["totals"].load(_ADD_UP["totals"](self._carried(t["direct"].now(0), t["closure"].now(0))))
        cuts = [(log, table, int(p)) for (log, table), p in (positions or {}).items()]
        cuts = self.spark.createDataFrame(cuts, "log string, `table` string, position bigint")
        cuts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cuts")
        # up to the lowest of a log's positions nothing is new in any table
        cuts.groupBy("log").agg(F.lit(-(1 << 62)).alias("lo"), F.min("position").alias("hi")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.root}/seen/v=0")

    @staticmethod
    def _banded(facts: DataFrame, edges: DataFrame) -> DataFrame:
        stock = edges.where(F.col("scope") == _STOCK).agg(*[F.max(f"t{k}").alias(f"s{k}") for k in _EDGES])     # one row
        return (facts.withColumn("scope", F.concat(F.lit("c"), "category_id")).join(edges.where(F.col("scope") != _STOCK), "scope", "left")
                .crossJoin(F.broadcast(stock))
                .withColumn("popularity_adjustment", _popularity("sale_count"))
                .withColumn("stock_adjustment", _stocked("total_stock", "s"))
                .drop("scope", *[f"{p}{k}" for p in "ts" for k in _EDGES]))

    @staticmethod
    def _carried(direct: DataFrame, closure: DataFrame) -> DataFrame:
        return (direct.join(closure.select("category_id", "ancestor_id", "n"), "category_id")
                .select(F.col("ancestor_id").alias("category_id"), (F.col("total") * F.col("n")).cast("decimal(38,10)").alias("total"),
                        (F.col("item_count") * F.col("n")).alias("item_count")))

    # ---- folding

    def seen(self, version: int) -> DataFrame:
        return self.spark.read.schema("log string, lo bigint, hi bigint").parquet(f"{self.root}/seen/v={version}")

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function. A batch that runs again gives the same version."""
        old, new = batch_id, batch_id + 1
        cuts = self.spark.read.schema("log string, `table` string, position bigint").parquet(f"{self.root}/cuts")
        batch = batch.select(*FEED_SCHEMA.fieldNames())
        placed = self._put(_outside(_placed(batch), self.seen(old)), f"batch/v={new}")
        together(lambda: self._put(_with_new(self.seen(old), placed.select("log", "position")), f"seen/v={new}"),
                  lambda: self._follow(_uncut(placed, cuts), old, new))
        self._tidy(old, new)

    def _follow(self, fresh: DataFrame, old: int, new: int) -> None:
        """Views of version ``new`` by changes that are in no older one."""
        t = self.tables
        names = {r[0] for r in fresh.select("table").distinct().collect()} & set(IMAGES)      # at most one row a table
        images = {n: _images(fresh, n) for n in names}
        together(*[lambda n=n: t[n].append(_signed(n, images[n]), new) for n in names])
        # whom the changes touch is read from what was appended, not from the images again
        added = {n: t[n].added(new) for n in names}
        self._reprice([added[n].select("product_id") for n in names if n in _PRICED], old, new)
        self._resum(added, old, new)

    def _put(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as a table. Written by all tasks that make them (fewer files would run their joins in fewer tasks)."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def _one_row(self) -> DataFrame:
        return self.spark.range(1)

    def _reprice(self, touched: list[DataFrame], old: int, new: int) -> None:
        """New prices of touched products and of those beside a moved edge; each changed price is logged."""
        t, names = self.tables, [f.split()[0] for f in _FACTS.split(", ")]
        if touched:
            ids = touched[0]
            for more in touched[1:]:
                ids = ids.unionAll(more)
            ids = self._put(ids.where("product_id IS NOT NULL").distinct(), f"touched/v={new}")
            # sales are counted where they lie, and only the counts meet the products
            counts = _sale_counts(t["sales"].beside(ids, new)).join(ids, "product_id", "left_semi")
            now = _facts(t["products"].of(ids, new), counts, _counted(t["sales"].rows_of(ids, new)), t["promotions"].of(ids, new),
                         t["inventory"].of(ids, new)).withColumn("is_new", F.lit(True))
            was = t["prices"].of(ids, old).select("product_id", "priced", *names).withColumn("is_new", F.lit(False))
            both = self._put(was.unionByName(now), f"facts/v={new}")
            moved = _ADD_UP["ranks"](_places(both.where("NOT is_new"), -1).unionByName(_places(both.where("is_new"), 1)))
            t["ranks"].append(moved, new)
            scopes = (both.where("priced").select(F.concat(F.lit("c"), "category_id").alias("scope"))
                      .union(self._one_row().select(F.lit(_STOCK))).distinct())
            before = band_edges(t["ranks"].of(scopes, old)).select("scope", *[F.col(f"t{k}").alias(f"o{k}") for k in _EDGES])
            edges = self._put(scopes.join(before, "scope", "left").join(band_edges(t["ranks"].of(scopes, new)), "scope", "left"),
                              f"edges/v={new}")
            banded = self._banded(both.where("is_new").drop("is_new"), edges.drop(*[f"o{k}" for k in _EDGES]))
            rows = [banded]
            shifted = edges.where(" OR ".join(f"NOT (t{k} <=> o{k})" for k in _EDGES))
            if shifted.head(1):
                rows.append(self._beside(shifted, ids, old))
            priced = rows[0]
            for more in rows[1:]:
                priced = priced.unionByName(more)
            priced = _price(priced.withColumn("seq", F.lit(new).cast("bigint"))).select(*t["prices"].schema.fieldNames())
            gone = ids.join(both.where("is_new").select("product_id"), "product_id", "left_anti")
            kinds = {f.name: F.lit(None).cast(f.dataType) for f in t["prices"].schema.fields}
            gone = gone.select("product_id", *[v.alias(c) for c, v in kinds.items() if c != "product_id"]).withColumns(
                {"seq": F.lit(new).cast("bigint"), "priced": F.lit(False)})
            stored = self._put(priced.unionByName(gone), f"repriced/v={new}")
            then = t["prices"].of(stored.select("product_id"), old).where("priced").select(
                "product_id", F.col("live_price").alias("old_price"), F.col("category_id").alias("old_category"), F.lit(True).alias("had"))
            after = stored.where("priced").select("product_id", F.col("live_price").alias("new_price"),
                                                  F.col("category_id").alias("new_category"), F.lit(True).alias("has"))
            log = then.join(after, "product_id", "full").where(
                "NOT (old_price <=> new_price AND old_category <=> new_category AND had <=> has)")
            together(lambda: t["prices"].append(stored, new), lambda: self._put(log, f"price_log/v={new}"))
            return
        self._put(self.spark.createDataFrame([], "product_id bigint, old_price decimal(20,6), old_category bigint, had boolean, "
                                                 "new_price decimal(20,6), new_category bigint, has boolean"), f"price_log/v={new}")

    def _beside(self, shifted: DataFrame, ids: DataFrame, old: int) -> DataFrame:
        """Products not in ``ids`` whose band changes with the moved edges, in the form of :meth:`_banded`."""
        t, names = self.tables, [f.split()[0] for f in _FACTS.split(", ")]
        held = t["prices"].now(old).join(ids, "product_id", "left_anti")
        shifted = shifted.withColumn("moved", F.lit(True))
        stock = (self._one_row().select(F.lit(_STOCK).alias("scope")).join(shifted, "scope", "left")
                 .select(F.col("moved").alias("moved_stock"), *[F.col(f"t{k}").alias(f"s{k}") for k in _EDGES]))    # one row
        rows = (held.withColumn("scope", F.concat(F.lit("c"), "category_id"))
                .join(shifted.where(F.col("scope") != _STOCK), "scope", "left").crossJoin(F.broadcast(stock)))
        popular = F.when(F.col("moved"), _popularity("sale_count")).otherwise(F.col("popularity_adjustment"))
        stocked = F.when(F.col("moved_stock"), _stocked("total_stock", "s")).otherwise(F.col("stock_adjustment"))
        return (rows.withColumns({"_p": popular, "_s": stocked})
                .where("NOT (_p <=> popularity_adjustment) OR NOT (_s <=> stock_adjustment)")
                .select("product_id", "priced", *names, F.col("_p").alias("popularity_adjustment"), F.col("_s").alias("stock_adjustment")))

    def _resum(self, added: Mapping[str, DataFrame], old: int, new: int) -> None:
        """Sums of categories, direct and carried to their ancestors, by the lines that changed; ``added``: table -> appended rows."""
        t = self.tables
        log = self.price_log(new)
        ids = log.select("product_id")
        if "shopping_cart" in added:
            ids = ids.unionAll(added["shopping_cart"].select("product_id"))
        tree = "categories" in added
        if tree:
            nodes = added["categories"].select("category_id").distinct()
            came = (t["categories"].of(nodes, old).where("op <> 'D'").select("category_id", F.lit(1).alias("a"))
                    .join(t["categories"].of(nodes, new).where("op <> 'D'").select("category_id", F.lit(1).alias("b")), "category_id", "full")
                    .where("NOT (a <=> b)").select("category_id"))
            ids = ids.unionAll(t["prices"].now(old).join(came, "category_id", "left_semi").select("product_id"))
        ids = self._put(ids.distinct(), f"lines/v={new}")
        parts = [_lines(t["shopping_cart"].of(ids, v), t["prices"].of(ids, v), t["categories"].now(v), sign)
                 for v, sign in ((old, -1), (new, 1))]
        direct = self._put(_ADD_UP["direct"](parts[0].unionByName(parts[1])), f"direct_log/v={new}")
        t["direct"].append(direct, new)
        if tree:
            turned = written(_ADD_UP["closure"](_pairs(t["categories"].now(new)).unionByName(
                t["closure"].now(old).withColumn("n", -F.col("n")))), "turned")
            t["closure"].append(turned, new)
        carried = self._carried(direct, t["closure"].of(direct.select("category_id"), new))
        if tree:      # what stood in a category before counts for the ancestors that it got, and no longer for those it lost
            carried = carried.unionByName(self._carried(t["direct"].of(turned.select("category_id"), old), turned))
        t["totals"].append(self._put(_ADD_UP["totals"](carried), f"total_log/v={new}"), new)

    def _tidy(self, old: int, new: int) -> None:
        """Compact, and remove what neither a reader nor a second run of this batch can need."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for name in ("batch", "touched", "facts", "edges", "repriced", "lines", "seen"):
            path = jvm.Path(f"{self.root}/{name}/v={old - 1}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        oldest = min([old, *self._leases()])
        for table in self.tables.values():
            table.compact(new)
            table.prune(oldest)

    def start(self, feed_path: str, *, max_files_per_trigger: int | None = None, available_now: bool = True,
              interval: str = "1 second") -> StreamingQuery:
        """Fold the Parquet change files under ``feed_path`` as they come."""
        reader = self.spark.readStream.schema(FEED_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        writer = (reader.parquet(feed_path).writeStream.outputMode("append").foreachBatch(self.fold)
                  .option("checkpointLocation", f"{self.root}/checkpoint"))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()

    # ---- reading

    def version(self) -> int:
        """Version of the last batch that Spark has committed (0: the snapshot)."""
        return max((int(n) + 1 for n in self._names("checkpoint/commits/*") if n.isdigit()), default=0)

    def _names(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return [s.getPath().getName() for s in found]

    def _leases(self) -> list[int]:
        """Versions that readers hold; a lease past its time counts no more."""
        held = [n.split("-") for n in self._names("leases/*")]
        return [int(x[0]) for x in held if len(x) == 3 and int(x[1]) > time.time()]

    def reader(self, version: int | None = None, seconds: int = 3600) -> Reader:
        """All views as of one version, which stays readable for so many seconds or until the reader is closed."""
        version = self.version() if version is None else version
        path = self.spark._jvm.org.apache.hadoop.fs.Path(
            f"{self.root}/leases/{version}-{int(time.time()) + seconds}-{uuid.uuid4().hex}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return Reader(self, version, path)

    def price_log(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/price_log/v={version}")

    def price_deltas(self, since: int, upto: int) -> DataFrame:
        """(product_id, old_price, new_price) of all prices that differ between two versions."""
        logs = [self.price_log(v).withColumn("v", F.lit(v)) for v in range(since + 1, upto + 1)]
        every = logs[0]
        for more in logs[1:]:
            every = every.unionByName(more)
        return (every.groupBy("product_id").agg(F.min_by("old_price", "v").alias("old_price"), F.max_by("new_price", "v").alias("new_price"))
                .where("NOT (old_price <=> new_price)"))

    def category_deltas(self, since: int, upto: int) -> DataFrame:
        """(category_id, total, item_count): by how much the sums of all below a category changed between two versions."""
        paths = [f"{self.root}/total_log/v={v}" for v in range(since + 1, upto + 1)]
        return _ADD_UP["totals"](self.spark.read.schema(self.tables["totals"].schema).parquet(*paths))


class Reader:
    """Views as of one version."""

    def __init__(self, views: LiveViews, version: int, lease):
        self.version, self._views, self._lease = version, views, lease
        # what each view reads is settled now: later batches neither change nor remove it
        self._now = {n: t.now(version) for n, t in views.tables.items()}

    def inventory_item(self) -> DataFrame:
        return self._now["prices"].where("priced").select("product_id", "live_price", "last_update_time")

    def dynamic_cart(self) -> DataFrame:
        prices = self._now["prices"].where("priced")
        lines = self._now["shopping_cart"].where("n > 0").withColumnRenamed("n", "multiplicity")
        return cartops.dynamic_cart(lines, prices, self._categories(), prices, None, stock=prices)

    def _categories(self) -> DataFrame:
        return self._now["categories"].where("op <> 'D'").select("category_id", "category_name", "parent_id")

    def category_totals(self, other_offset: int = hierarchy.OTHER_OFFSET) -> DataFrame:
        rolled = self._now["totals"].where("item_count > 0")
        return hierarchy.finish(rolled, self._now["direct"], self._categories(), other_offset)

    def recent_prices(self) -> DataFrame:
        return newest_mean(self._now["sales"])

    def stock(self) -> DataFrame:
        return self._now["inventory"].where("n > 0").select("product_id", F.col("stock").alias("total_stock"))

    def cart_lines(self) -> DataFrame:
        return self._now["shopping_cart"].where("n > 0")

    def close(self) -> None:
        self._lease.getFileSystem(self._views.spark._jsc.hadoopConfiguration()).delete(self._lease, True)
