"""Work that follows the input: writes by many tasks, and micro-batches that don't write again what is kept."""

import datetime as dt
import json
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.operators import changes
from pricetide.plans import registry
from pricetide.streaming import live
from pricetide.streaming import maintain as mt
from pricetide.streaming.buckets import LoggedTable

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def small_parts(spark):
    """Partitions of a few KB, so that a small table takes many tasks as a large one does."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def _files(df):
    return len(df.inputFiles())


def test_a_large_bucket_is_written_by_many_tasks(spark, scratch, small_parts):
    t = LoggedTable(spark, scratch, "k bigint, n bigint", "k", lambda rows: rows, 1)
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.col("id").alias("n")).repartition(16)
    t.load(rows)
    assert _files(t.read(0)) > 4
    t.append(rows, 1)
    assert _files(spark.read.parquet(f"{scratch}/bucket=0/v=1/kind=more")) > 4
    assert t.read(1).agg(F.count("k"), F.sum("k")).first()[:] == (80_000, 40_000 * 39_999)


def test_logs_of_a_large_batch_are_written_by_many_tasks(spark, scratch, small_parts):
    n = 6000
    ids = spark.range(n).withColumnRenamed("id", "product_id")
    products = ids.select("product_id", F.lit("p").alias("product_name"), F.lit(10).cast("decimal(10,2)").alias("base_price"),
                          F.lit(1).cast("bigint").alias("category_id"), F.lit(T0).cast("timestamp_ntz").alias("last_update_time"))
    sales = ids.select("product_id", F.lit(T0).cast("timestamp_ntz").alias("sale_date"), F.lit(5).cast("decimal(20,4)").alias("price"),
                       F.lit(5).cast("decimal(20,4)").alias("sale_price"))
    views = live.LiveViews(spark, scratch)
    views.load({"products": products, "sales": sales})
    image = F.struct("product_id", F.lit(Decimal("20.00")).alias("promotion_discount"), F.lit(True).alias("active"))
    views.fold(live.changes(ids.select(F.col("product_id").alias("position"), F.lit("I").alias("op"), image.alias("after")),
                            "promotions", "log"), 0)
    assert views.price_log(1).count() == n
    assert _files(views.price_log(1)) > 1                                   # a full join of two versions, once in one task
    assert _files(spark.read.parquet(f"{scratch}/batch/v=1")) > 4


def test_a_second_delivery_makes_no_runs(spark):
    """Every tenth position again, all in one interval: nothing is numbered, the intervals stay."""
    seen = spark.createDataFrame([("a", 1, 1000)], "log string, lo bigint, hi bigint")
    again = spark.range(10, 1000, 10).select(F.lit("a").alias("log"), F.col("id").alias("position"))
    assert live._outside(again, seen).count() == 0
    assert [tuple(r) for r in live.with_seen(seen, again).collect()] == [("a", 1, 1000)]


@pytest.mark.parametrize("bits", [2, 8])
def test_many_intervals_are_looked_up_by_blocks(spark, monkeypatch, bits):
    """A random part of two logs seen before: no change is compared with all intervals of its log."""
    monkeypatch.setattr(live, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    was = {(log, p) for log in "ab" for p in range(-40, 300) if rng.random() < 0.7} | {("c", p) for p in range(100)}
    now = {(log, p) for log in "ab" for p in range(-40, 300) if rng.random() < 0.7} | {("c", p) for p in range(95, 110)}
    rows = lambda places: spark.createDataFrame([(log, p, "t", "I", None, f"{log}{p}") for log, p in places], live.FEED_SCHEMA)
    runs = lambda places: sorted((log, p, next(q for q in range(p, 400) if (log, q + 1) not in places))
                                 for log, p in places if (log, p - 1) not in places)
    past = spark.createDataFrame([("a", -(1 << 62), -41)], "log string, lo bigint, hi bigint")
    seen = live.with_seen(past, rows(sorted(was)))
    got = sorted(tuple(r) for r in seen.collect())
    assert [r for r in got if r[1] >= 0 or r[0] != "a"] == [r for r in runs(was) if r[1] >= 0 or r[0] != "a"]
    assert got[0][:2] == ("a", -(1 << 62))
    seen = spark.createDataFrame(got, seen.schema)
    fresh = live.not_seen(rows([*now, *now]), seen, spark.createDataFrame([], "log string, `table` string, position bigint"))
    assert sorted(r.after for r in fresh.collect()) == sorted(f"{log}{p}" for log, p in now - was)
    assert "LeftAnti" not in fresh._jdf.queryExecution().executedPlan().toString()
    after = sorted(tuple(r) for r in live.with_seen(seen, rows(sorted(now))).collect())
    assert [r for r in after if r[0] != "a"] == [r for r in runs(was | now) if r[0] != "a"]


def test_second_deliveries_take_several_files(spark, scratch, monkeypatch):
    """The repeated tenth of a feed of many files isn't one file, which one task would write and read."""
    monkeypatch.setattr(registry, "_scratch", lambda spark, what: scratch)
    rows = spark.range(400).select((F.col("id") + 1).alias("position"), F.lit("I").alias("op"), F.struct(
        F.col("id").alias("product_id"), F.lit(1).cast("bigint").alias("stock")).alias("after")).repartition(30)
    feed = live.changes(rows, "inventory", "log")
    views = registry._followed(spark, feed, {})
    assert views.reader().stock().count() == 400 and views.version() == 2
    assert _files(spark.read.parquet(f"{scratch}/feed")) - 30 == 3


def _maintained(spark, scratch):
    prods = spark.createDataFrame([(i, f"p{i}", Decimal("10.00"), 100 + i % 2, 1, True, T0) for i in range(1, 9)], schemas.PRODUCTS)
    sales = spark.createDataFrame(
        [(i, 1 + i % 7, Decimal("10.0000"), T0 + dt.timedelta(days=i % 30), Decimal(f"{5 + i % 9}.00")) for i in range(120)], schemas.SALES)
    keeper = mt.Maintainer(spark, scratch, buckets=1)
    keeper.load({"products": prods, "sales": sales})
    return keeper


def _change(spark, table, payload):
    return spark.createDataFrame([(table, table, "I", 0, 1, json.dumps(payload))], mt.FEED_SCHEMA)


def test_a_batch_writes_what_it_adds(spark, scratch):
    keeper = _maintained(spark, scratch)
    keeper.fold(_change(spark, "sales", {"product_id": 4, "sale_price": "5.0000", "price": "5.00",
                                         "sale_date": "2024-03-01T00:00:00.000000"}), 0)
    for name in ("sales", "facts"):
        assert spark.read.parquet(f"{scratch}/{name}/bucket=0/v=1").count() == 1


def test_a_promotion_reads_no_sale(spark, scratch, monkeypatch):
    keeper = _maintained(spark, scratch)
    before = {r.product_id: r for r in keeper.tables["facts"].now(0).collect()}

    def fail(*_):
        raise AssertionError("sales are read")
    monkeypatch.setattr(keeper.tables["sales"], "of", fail)
    monkeypatch.setattr(keeper.tables["sales"], "read", fail)
    keeper.fold(_change(spark, "promotions", {"product_id": 4, "promotion_discount": "30.00", "active": True}), 0)
    now = {r.product_id: r for r in keeper.tables["facts"].now(1).collect()}
    assert now[4].promotion_discount == Decimal("30.00") and now[4].avg_price == before[4].avg_price
    assert {p: r for p, r in now.items() if p != 4} == {p: r for p, r in before.items() if p != 4}


def test_a_large_bag_is_counted_by_more_tasks(spark, scratch, monkeypatch):
    spark.range(3000).select(F.col("id") % 1000, F.lit("x").alias("s")).toDF("k", "s").write.parquet(f"{scratch}/bag")
    base = spark.read.parquet(f"{scratch}/bag")
    less = base.where("k = 7").limit(2).select(F.lit(-1).alias("w"), "*")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan(changes.apply_changes_bag(base, less))
    monkeypatch.setattr(changes, "COUNTED_BYTES", -(-changes.input_bytes(base) // (partitions + 1)))
    got = changes.apply_changes_bag(base, less)
    assert f", {partitions + 1}), REPARTITION_BY_NUM" in plan(got)
    assert {r.k: r.multiplicity for r in got.collect()} == {k: 1 if k == 7 else 3 for k in range(1000)}


def test_a_batch_is_compared_with_the_seen_once_and_its_images_are_parsed_once(spark, scratch, monkeypatch):
    sale = "product_id bigint, sale_date timestamp_ntz, price decimal(20,4), sale_price decimal(20,4)"
    row = lambda price, day: (1, T0 + dt.timedelta(days=day), Decimal(price), Decimal(price))
    products = spark.createDataFrame([(1, "p", Decimal(10), 1, T0)], live.IMAGES["products"])
    spark.createDataFrame([row(4, 0), row(4, 0), row(8, 1)], sale).write.parquet(f"{scratch}/sales")
    views = live.LiveViews(spark, f"{scratch}/kept")
    views.load({"products": products, "sales": spark.read.parquet(f"{scratch}/sales")})
    assert views.tables["sales"].read(0).count() == 3                       # written without a shuffle that adds up
    mean = lambda: views.reader(views_at[0]).recent_prices().collect()[0]["avg_price"]
    views_at = [0]
    assert mean() == 16 / 3
    calls, sources, outside, reprice = [], [], live._outside, live.LiveViews._reprice
    monkeypatch.setattr(live, "_outside", lambda *a: calls.append(a) or outside(*a))
    monkeypatch.setattr(live.LiveViews, "_reprice",
                        lambda self, touched, *a: sources.extend(f for x in touched for f in x.inputFiles()) or reprice(self, touched, *a))
    gone = F.struct(F.lit(1).alias("product_id"), F.lit(T0).cast("timestamp_ntz").alias("sale_date"),
                    F.lit(Decimal("4.0000")).alias("price"), F.lit(Decimal("4.0000")).alias("sale_price"))
    views.fold(live.changes(spark.range(1).select(F.col("id").alias("position"), F.lit("D").alias("op"), gone.alias("before")),
                            "sales", "log"), 0)
    views_at[0] = 1
    assert mean() == 6                                                      # one of two equal sales was withdrawn
    assert views.tables["prices"].now(1).first()["sale_count"] == 2
    assert [r[:] for r in views.seen(1).collect()] == [("log", 0, 0)]
    assert len(calls) == 1 and sources and all("kind=more" in f for f in sources)


def test_a_log_is_placed_from_rows_that_were_computed_once(spark):
    rows = spark.range(100).select(F.col("id").alias("product_id"), F.lit(1).cast("bigint").alias("stock"))
    log = registry._log(rows, "inventory", "stock", rows.columns, ["product_id"], before="false")
    assert log.inputFiles() and all("/stock-changes-" in f for f in log.inputFiles())
    assert log.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()[:] == (1, 100, 100)


def _stock_feed(spark, n, first=0):
    """``n`` signed stock rows of product 1, one unit each, with ids."""
    rows = spark.range(first, first + n, 1, 4).select(F.lit(1).alias("w"), F.lit(1).cast("bigint").alias("product_id"),
                                                     F.lit(1).alias("stock"), "id")
    return mt.encode_signed(rows, "inventory", ["product_id", "stock"], "id")


def test_ids_that_have_come_are_a_table_not_state(spark, scratch):
    """Repeats within a batch, in a later batch and after a restart are dropped, and no state store holds an id."""
    feed, keeper = _stock_feed(spark, 50).coalesce(1), mt.Maintainer(spark, f"{scratch}/kept", buckets=2)
    keeper.load({})
    feed.unionByName(feed).coalesce(1).write.parquet(f"{scratch}/feed")
    feed.write.mode("append").parquet(f"{scratch}/feed")
    first = keeper.start(f"{scratch}/feed", max_files_per_trigger=1)
    first.awaitTermination()
    feed.unionByName(_stock_feed(spark, 30, 45)).coalesce(1).write.mode("append").parquet(f"{scratch}/feed")
    keeper = mt.Maintainer(spark, f"{scratch}/kept", buckets=2)
    again = keeper.start(f"{scratch}/feed", max_files_per_trigger=1)
    again.awaitTermination()
    assert keeper.version() == 3
    assert keeper.tables["inventory"].now(3).select("n", "stock").collect() == [(75, 75)]
    assert not any(p["stateOperators"] for q in (first, again) for p in q.recentProgress)
    assert not spark.sparkContext._jvm.java.io.File(f"{scratch}/kept/checkpoint/state").exists()
    assert sorted(r[0] for r in keeper.seen.read(3).collect()) == sorted(f"inventory:{i}:1" for i in range(75))


def test_a_batch_that_runs_again_drops_the_same_changes(spark, scratch):
    keeper = mt.Maintainer(spark, scratch, buckets=2)
    keeper.load({})
    keeper.follow(_stock_feed(spark, 20), 0)
    for _ in range(2):                                                              # as after a failure half way
        keeper.follow(_stock_feed(spark, 20, 10), 1)
        assert keeper.tables["inventory"].now(2).select("stock").collect() == [(30,)] and keeper.seen.read(2).count() == 30
    missing = _stock_feed(spark, 2).withColumn("change_id", F.lit(None).cast("string"))
    keeper.follow(missing, 2)
    assert keeper.tables["inventory"].now(3).select("stock").collect() == [(31,)]    # rows without an id are one change, as ever


def test_the_repeated_changes_are_those_that_were_sent(spark, monkeypatch, scratch):
    """The tenth that comes twice is read from the written feed: computed again, ids that differ by run would be new ones."""
    monkeypatch.setattr(registry, "_scratch", lambda spark, what: scratch)
    fresh = F.udf(lambda: str(uuid.uuid4())).asNondeterministic()
    feed = _stock_feed(spark, 400).withColumn("change_id", fresh())
    keeper = registry._streamed(spark, None, feed, {})
    sent = spark.read.parquet(f"{scratch}/feed")
    assert sent.count() > 400 and sent.select("change_id").distinct().count() == 400
    assert keeper.tables["inventory"].now(keeper.version()).select("stock").collect() == [(400,)]


def test_cart_lines_are_joined_once(spark, monkeypatch):
    """Bounds, counts and rows of the numbered lines are read from a table, not from the joins three times."""
    seen = []

    def numbered(lines, order):
        seen.append("Join" in lines._jdf.queryExecution().optimizedPlan().toString())
        return lines.withColumn("position", F.lit(1))
    monkeypatch.setattr(registry, "global_position", numbered)
    monkeypatch.setattr(registry, "_streamed", lambda spark, d, feed, snapshot: feed)
    registry._stream_with_cart(spark, "/root/testdata/sf0.001")
    assert seen == [False]


def test_a_snapshot_of_sales_is_written_without_adding_up(spark, scratch):
    """Equal sales stay rows of their own until they are read; counts and the ten newest are the same."""
    sale = lambda i, days, price: (i, 1, Decimal("2.0000"), T0 + dt.timedelta(days=days), Decimal(price))
    rows = [sale(i, 9, "7.00") for i in range(8)] + [sale(8 + i, 5, "3.00") for i in range(4)]
    keeper = mt.Maintainer(spark, scratch, buckets=1)
    keeper.load({"sales": spark.createDataFrame(rows, schemas.SALES)})
    assert keeper.tables["sales"].read(0).count() == 12 and keeper.tables["sales"].now(0).count() == 2
    fact = keeper.tables["facts"].now(0).first()
    assert (fact.sale_count, fact.sale_price_sum, fact.avg_price) == (12, Decimal("24.0000"), (8 * 7 + 2 * 3) / 10)


def test_facts_of_sales_take_one_pass(spark):
    """Counts and newest prices of kept sales: no join of two passes; what is taken back below zero counts nothing."""
    day = lambda n: T0 + dt.timedelta(days=n)
    d = lambda x: None if x is None else Decimal(x)
    rows = [(1, day(3), d("4"), 6, d("6")), (1, day(2), d("1"), -3, d("-3")), (1, day(1), d("2"), 3, d("3")), (1, day(0), d("9"), 5, d("5")),
            (2, day(1), d("5"), 1, d("1")), (2, day(0), d("5"), -2, d("-2")),      # more taken back than came so far
            (3, day(1), d("5"), -1, d("-1")), (4, day(1), None, 2, None)]
    kept = spark.createDataFrame(rows, mt.KEPT["sales"])
    facts = mt._of_sales(kept)
    assert "Join" not in facts._jdf.queryExecution().optimizedPlan().toString()
    got = {r.product_id: tuple(r)[1:] for r in facts.collect()}
    assert got == {1: (11, Decimal("11.0000"), (6 * 4 + 3 * 2 + 9) / 10), 2: (None, None, 5.0), 3: (None, None, None), 4: (2, None, None)}
