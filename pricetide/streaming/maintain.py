"""Maintained prices, cart and roll-up: a stream of row changes, and the views over what it keeps.

The change feed has one row per row image: ``(change_id, table, op, seq, w,
payload)`` with the payload as JSON of the table's columns. Products come as
whole rows (insert, update, delete), the newest ``seq`` of a product counts.
Sales, promotions, stock and cart lines come as signed images: w = -1 for the
row before a change, +1 for the row after it. Everything kept of them is a sum of
signs, so changes may arrive in any order and however late; a change delivered
twice is dropped by its id. The ids that have come are a logged table too, joined
with each batch: no task or state store holds them in memory.

A micro-batch is written once without what has come before, then appends its
changes to logged tables (:class:`buckets.LoggedTable`) of counted sales,
promotions and cart lines and summed stock; what is kept isn't written again, but
for a bucket with many appended parts. Of the products it touches it computes
anew those facts that a price depends on whose table has changed, and keeps the
others: a promotion reads no sale. The views are queries over these tables, one
row per product: a price needs its product's facts and the thresholds of all
facts, never a sale.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import WindowSpec

from pricetide.functions import factors as fx
from pricetide.operators import cart as cartops
from pricetide.operators import hierarchy, pricing
from pricetide.session import written
from pricetide.sources import io
from pricetide.streaming.buckets import BUCKETS, LoggedTable

FEED_SCHEMA = T.StructType([
    T.StructField("change_id", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("w", T.IntegerType(), False),
    T.StructField("payload", T.StringType(), True),
])

# JSON payloads keep full microsecond timestamps (the default format cuts to ms).
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: What is kept: table -> (columns, key). All sums are over signed rows.
KEPT = {
    "products": ("product_id bigint, seq bigint, op string, product_name string, base_price decimal(10,2), "
                 "category_id bigint, last_update_time timestamp_ntz"),
    "sales": "product_id bigint, sale_date timestamp_ntz, price decimal(20,4), n bigint, amount decimal(38,4)",
    "promotions": "product_id bigint, promotion_discount decimal(10,2), n bigint",
    "inventory": "product_id bigint, n bigint, stock bigint",
    "shopping_cart": "product_id bigint, product_name string, n bigint",
    "facts": ("product_id bigint, seq bigint, sale_count bigint, sale_price_sum decimal(38,4), avg_price double, "
              "promotion_discount decimal(10,2), total_stock bigint"),
}
#: Columns of a change that are kept, per table.
_PAYLOAD = {
    "products": "product_id bigint, product_name string, base_price decimal(10,2), category_id bigint, "
                "last_update_time timestamp_ntz",
    "sales": "product_id bigint, sale_date timestamp_ntz, price decimal(20,4), sale_price decimal(20,4)",
    "promotions": "product_id bigint, promotion_discount decimal(10,2), active boolean",
    "inventory": "product_id bigint, stock bigint",
    "shopping_cart": "product_id bigint, product_name string",
}


def kept_tables(spark: SparkSession, root: str, buckets: int = BUCKETS) -> dict[str, LoggedTable]:
    return {n: LoggedTable(spark, f"{root}/{n}", ddl, "product_id", lambda rows, n=n: _added_up(n, rows), buckets)
            for n, ddl in KEPT.items()}


# --------------------------------------------------------------------------- feed

def encode_rows(changes: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Whole-row changes (op, seq, columns) as feed rows; ``seq`` is unique in the table."""
    seq = F.col("seq").cast("bigint")
    return changes.select(F.concat_ws(":", F.lit(table), seq).alias("change_id"), F.lit(table).alias("table"), "op",
                          seq.alias("seq"), F.lit(1).alias("w"),
                          F.to_json(F.struct(*columns), JSON_OPTIONS).alias("payload"))


def encode_signed(rows: DataFrame, table: str, columns: list[str], position: Column | str) -> DataFrame:
    """Signed row images (w, columns) as feed rows.

    ``position`` tells the change that an image belongs to: its place in the
    source's log, or the id of the event. Equal images at different positions
    are different changes; an image counts once per position and sign.
    """
    at = F.col(position) if isinstance(position, str) else position
    return rows.select(F.concat_ws(":", F.lit(table), at.cast("string"), F.col("w").cast("string")).alias("change_id"),
                       F.lit(table).alias("table"), F.when(F.col("w") > 0, "I").otherwise("D").alias("op"),
                       F.lit(0).cast("bigint").alias("seq"), F.col("w").cast("int").alias("w"),
                       F.to_json(F.struct(*columns), JSON_OPTIONS).alias("payload"))


def decode(feed: DataFrame, table: str) -> DataFrame:
    """Feed rows of a table as (op, seq, w, kept columns)."""
    return (feed.where(F.col("table") == table)
            .select("op", "seq", "w", F.from_json("payload", _PAYLOAD[table], JSON_OPTIONS).alias("_p"))
            .select("op", "seq", "w", "_p.*"))


# --------------------------------------------------------------------------- folding

def _as_kept(table: str, rows: DataFrame) -> DataFrame:
    """Changes (op, seq, w, columns) in the form of the kept table, not yet added up."""
    if table == "products":
        return rows.select("product_id", "seq", "op", "product_name", "base_price", "category_id", "last_update_time")
    w = F.col("w").cast("bigint")
    if table == "sales":
        return rows.select("product_id", "sale_date", F.col("price").cast("decimal(20,4)").alias("price"), w.alias("n"),
                           (F.col("w") * F.col("sale_price")).cast("decimal(38,4)").alias("amount"))
    if table == "promotions":
        return rows.where("active").select("product_id", "promotion_discount", w.alias("n"))
    if table == "inventory":
        return rows.select("product_id", w.alias("n"), (w * F.col("stock")).cast("bigint").alias("stock"))
    return rows.select("product_id", "product_name", w.alias("n"))


def _added_up(table: str, rows: DataFrame) -> DataFrame:
    """One row per kept key: the newest product or facts, or sums of signed rows (a key whose sums are 0 is gone)."""
    if table in ("products", "facts"):
        first = [c for c in ("seq", "op") if c in rows.columns]
        rest = [c for c in rows.columns if c not in ("product_id", *first)]
        best = rows.groupBy("product_id").agg(F.max(F.struct(*first, *rest)).alias("_b"))
        return best.select("product_id", "_b.*")
    if table == "sales":
        return (rows.groupBy("product_id", "sale_date", "price")
                .agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,4)").alias("amount")).where("n <> 0 OR amount <> 0"))
    if table == "inventory":
        return rows.groupBy("product_id").agg(F.sum("n").alias("n"), F.sum("stock").alias("stock")).where("n <> 0")
    keys = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def _newest() -> WindowSpec:
    return Window.partitionBy("product_id").orderBy(F.desc("sale_date"), F.desc("price"))


def _with_newest(sales: DataFrame) -> tuple[DataFrame, Column]:
    """Sales with how many of each are among their product's newest, and the mean price of those."""
    before = F.sum(F.greatest(F.lit(0), "n")).over(_newest().rowsBetween(Window.unboundedPreceding, -1))
    rows = (sales.withColumn("room", fx.RECENT_SALES - F.coalesce(before, F.lit(0)))
            .withColumn("take", F.when(F.col("n") > 0, F.greatest(F.lit(0), F.least("n", "room")))))
    return rows, (F.sum(F.col("price") * F.col("take")).cast("double") / F.sum("take")).alias("avg_price")


def _of_snapshot_sales(sales: DataFrame) -> DataFrame:
    """:func:`_of_sales` where nothing is taken back: rows needn't be added up, and few of a product leave a task."""
    counts = sales.groupBy("product_id").agg(F.sum("n").alias("sale_count"),
                                             F.sum("amount").cast("decimal(38,4)").alias("sale_price_sum"))
    top = sales.where("n > 0").withColumn("rn", F.row_number().over(_newest())).where(F.col("rn") <= fx.RECENT_SALES)
    rows, avg_price = _with_newest(top)
    return counts.where("sale_count > 0").join(rows.groupBy("product_id").agg(avg_price), "product_id", "full")


def _of_sales(sales: DataFrame) -> DataFrame:
    """Counts and the mean of the newest prices by one pass over added up sales."""
    rows, avg_price = _with_newest(sales)
    facts = rows.groupBy("product_id").agg(F.sum("n").alias("_n"), F.sum("amount").cast("decimal(38,4)").alias("_amount"), avg_price)
    sold = F.col("_n") > 0
    return facts.select("product_id", F.when(sold, F.col("_n")).alias("sale_count"),
                        F.when(sold, F.col("_amount")).alias("sale_price_sum"), "avg_price")


def _of_promotions(promotions: DataFrame) -> DataFrame:
    return promotions.where("n > 0").groupBy("product_id").agg(F.min("promotion_discount").alias("promotion_discount"))


def _of_inventory(inventory: DataFrame) -> DataFrame:
    return inventory.select("product_id", F.col("stock").alias("total_stock"))


#: What a price depends on, per product: counted table -> (columns of the facts, how to compute them).
_FACTS = {"sales": (["sale_count", "sale_price_sum", "avg_price"], _of_sales),
          "promotions": (["promotion_discount"], _of_promotions), "inventory": (["total_stock"], _of_inventory)}


class Maintainer:
    """Loads a snapshot as version 0 and folds micro-batches; batch b gives version b + 1."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.tables = spark, root, kept_tables(spark, root, buckets)
        #: Ids of the changes folded so far, each once.
        self.seen = LoggedTable(spark, f"{root}/seen", "change_id string", "change_id", lambda rows: rows, buckets)

    def load(self, snapshot: Mapping[str, DataFrame]) -> None:
        """Freeze the snapshot's tables (one pass over each; a missing table is empty)."""
        for name, payload in _PAYLOAD.items():
            columns = T.StructType.fromDDL(payload).fieldNames()
            if name not in snapshot:
                self.tables[name].load(self.spark.createDataFrame([], self.tables[name].schema))
                continue
            rows = snapshot[name].select(F.lit("I").alias("op"), F.lit(-1).cast("bigint").alias("seq"),
                                         F.lit(1).alias("w"), *columns)
            kept = _as_kept(name, rows)
            # sales are hardly ever alike: equal ones are added up when they are read
            self.tables[name].load(kept if name == "sales" else _added_up(name, kept))
        facts = None
        for name, (_, compute) in _FACTS.items():
            part = (_of_snapshot_sales if name == "sales" else compute)(self.tables[name].read(0))
            facts = part if facts is None else facts.join(part, "product_id", "full")
        self.tables["facts"].load(facts.withColumn("seq", F.lit(0).cast("bigint")))
        self.seen.load(self.spark.createDataFrame([], self.seen.schema))

    def _update_facts(self, touched: Mapping[str, DataFrame], old: int, new: int) -> None:
        """Facts of touched products (counted table -> product_id): of the tables that changed anew, the others as they are."""
        ids = None
        for name, rows in touched.items():
            one = rows.where("product_id IS NOT NULL").distinct().withColumn(f"_{name}", F.lit(True))
            ids = one if ids is None else ids.join(one, "product_id", "full")
        if ids is None:
            return
        ids = written(ids, "touched")
        facts = ids.join(self.tables["facts"].of(ids.select("product_id"), old), "product_id", "left")
        for name in touched:
            columns, compute = _FACTS[name]
            # a hash table of a task's products, so that the rows of the table needn't be sorted to meet them
            own = ids.where(f"_{name}").select("product_id").hint("shuffle_hash")
            now = compute(self.tables[name].of(own, new))
            facts = facts.join(now.withColumnsRenamed({c: f"_new_{c}" for c in columns}), "product_id", "left").withColumns(
                {c: F.when(F.col(f"_{name}"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
        self.tables["facts"].append(facts.withColumn("seq", F.lit(new).cast("bigint")), new)

    def _put(self, batch: DataFrame, version: int) -> DataFrame:
        """The batch as a table: computed once, held neither in memory nor on executors' disks."""
        path = f"{self.root}/batch/v={version}"
        batch.select(*FEED_SCHEMA.fieldNames()).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(FEED_SCHEMA).parquet(path)

    def _unseen(self, batch: DataFrame, version: int) -> DataFrame:
        """Changes of ``batch`` whose id none of the versions up to ``version`` has folded, each once.

        Both sides are dealt and sorted by a hash of the id, once; the ids themselves are compared.
        """
        hashed = F.xxhash64("change_id").alias("_hash")
        alike = Window.partitionBy("_hash", "change_id").orderBy("_hash")
        once = (batch.withColumn("change_id", F.coalesce("change_id", F.lit(""))).select("*", hashed)
                .repartition("_hash", "change_id").withColumn("_nth", F.row_number().over(alike)).where("_nth = 1"))
        if version == 0:                                                        # the snapshot has no ids
            return once
        seen = self.seen.read(version).select(hashed, F.col("change_id").alias("_seen"))
        same = (once["_hash"] == seen["_hash"]) & (once["change_id"] == F.col("_seen"))
        return once.join(seen, same, "left_anti")

    def follow(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function: :meth:`fold` of the changes that haven't come before."""
        fresh = self._put(self._unseen(batch, batch_id), batch_id + 1)
        self.seen.append(fresh.select("change_id"), batch_id + 1)
        self._fold(fresh, batch_id, batch_id + 1)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Fold changes whose ids are new, each once. A batch that runs again gives the same versions."""
        self._fold(self._put(batch, batch_id + 1), batch_id, batch_id + 1)

    def _fold(self, batch: DataFrame, old: int, new: int) -> None:
        names = [r[0] for r in batch.select("table").distinct().collect()]       # at most one row per table
        for name in names:
            self.tables[name].append(_as_kept(name, decode(batch, name)), new)
        # whom the changes touch is read from what was appended, not from the payloads again
        touched = {name: self.tables[name].added(new).select("product_id") for name in names if name in _FACTS}
        self._update_facts(touched, old, new)
        for table in (*self.tables.values(), self.seen):
            table.compact(new)
            table.prune(old)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, feed_path: str, *, max_files_per_trigger: int | None = None, available_now: bool = True,
              interval: str = "5 seconds") -> StreamingQuery:
        """Fold the Parquet change files under ``feed_path`` as they come."""
        reader = self.spark.readStream.schema(FEED_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        writer = (reader.parquet(feed_path).writeStream.outputMode("append").foreachBatch(self.follow)
                  .option("checkpointLocation", f"{self.root}/checkpoint"))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()

    # ------------------------------------------------------------------ views

    def version(self) -> int:
        """Version of the last batch that Spark has committed (0: the snapshot)."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.root}/checkpoint/commits/*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        done = [int(n) for n in (s.getPath().getName() for s in found) if n.isdigit()]
        return max(done) + 1 if done else 0

    def products(self, version: int) -> DataFrame:
        return self.tables["products"].now(version).where("op <> 'D'").drop("op", "seq")

    def _inputs(self, version: int) -> dict[str, DataFrame]:
        facts = self.tables["facts"].now(version)
        return {
            "counts": facts.where("sale_count > 0").select("product_id", "sale_count", "sale_price_sum"),
            "recent": facts.where("avg_price IS NOT NULL").select("product_id", "avg_price"),
            "promo": facts.where("promotion_discount IS NOT NULL").select("product_id", "promotion_discount"),
            "stock": facts.where("total_stock IS NOT NULL").select("product_id", "total_stock"),
        }

    def inventory_item(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        items = pricing.live_price_of(pricing.factors_from_inputs(self.products(version), self._inputs(version)))
        return io.describe_view(items, "inventory_item")

    def dynamic_cart(self, categories: DataFrame, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        lines = self.tables["shopping_cart"].now(version).where("n > 0").withColumnRenamed("n", "multiplicity")
        view = cartops.dynamic_cart(lines, self.products(version), categories, self.inventory_item(version), None,
                                    stock=self._inputs(version)["stock"])
        return io.describe_view(view, "dynamic_cart")

    def category_totals(self, categories: DataFrame, other_offset: int = hierarchy.OTHER_OFFSET,
                        version: int | None = None) -> DataFrame:
        totals = hierarchy.category_totals(categories, self.dynamic_cart(categories, version), other_offset=other_offset)
        return io.describe_view(totals, "category_totals")


# --------------------------------------------------------------------------- batch refresh

def refresh_inventory_item(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, *,
                           as_of=None, view_name: str = "mv_inventory_item") -> DataFrame:
    """Recompute the live price table as a new copy, then log it; returns the log's newest row per view.

    A copy counts once it is in the log, so a refresh that fails half way is never read.
    """
    log_path, started = f"{root}/refresh_log", time.time()
    before = refresh_log(spark, root)
    last = before.where(F.col("view_name") == view_name).select("copy").first()
    copy = last[0] + 1 if last else 0
    items = pricing.inventory_item(tables["products"], tables["sales"], tables["promotions"],
                                   tables["inventory"])
    # key-clustered serving copy: point lookups by product_id prune row groups
    io.write_serving(io.describe_view(items, "inventory_item"), "product_id", f"{root}/{view_name}/copy={copy}")
    when = (F.lit(str(as_of)).cast("timestamp_ntz") if as_of is not None else F.localtimestamp())
    row = spark.range(1).select(F.lit(view_name).alias("view_name"), when.alias("last_refresh"),
                                F.lit(float(time.time() - started)).alias("refresh_duration"), F.lit(copy).alias("copy"))
    row.coalesce(1).write.mode("append").parquet(log_path)
    return refresh_log(spark, root).drop("copy")


_LOG = "view_name string, last_refresh timestamp_ntz, refresh_duration double, copy int"


def refresh_log(spark: SparkSession, root: str) -> DataFrame:
    """(view_name, last_refresh, refresh_duration, copy): the newest refresh of each view."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/refresh_log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _LOG)
    return io.latest_by_key(spark.read.schema(_LOG).parquet(f"{root}/refresh_log"), ["view_name"], ["copy"])


def refreshed(spark: SparkSession, root: str, view_name: str = "mv_inventory_item") -> DataFrame:
    """The newest logged copy of a view."""
    copy = refresh_log(spark, root).where(F.col("view_name") == view_name).select("copy").first()
    if copy is None:
        raise ValueError(f"{view_name} has not been refreshed under {root}")
    return spark.read.parquet(f"{root}/{view_name}/copy={copy[0]}")


def refresh_loop(spark: SparkSession, tables_fn: Callable[[], Mapping[str, DataFrame]], root: str, *,
                 interval: str = "60 seconds", retries: int = 3, checkpoint: str | None = None) -> StreamingQuery:
    """Refresh on a processing-time trigger (one tick per interval from the ``rate`` source).

    A failed refresh is retried ``retries`` times before the query fails; the
    tables are re-read on every tick, so each refresh sees the newest data.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_df: DataFrame, _batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                refresh_inventory_item(spark, tables_fn(), root)
                return
            except Exception:   # retry the whole refresh; an unlogged copy is overwritten
                if attempt == retries:
                    raise
                time.sleep(min(2 ** attempt, 30))

    return (ticks.writeStream.foreachBatch(tick).trigger(processingTime=interval)
            .option("checkpointLocation", checkpoint or f"{root.rstrip('/')}/_refresh_ckpt").start())
