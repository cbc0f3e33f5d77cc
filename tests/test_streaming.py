"""Maintained views: equality with the batch result, replay, order, duplicates; refreshes; rates."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.operators import cart as cartops
from pricetide.operators import hierarchy, pricing
from pricetide.streaming import maintain as mt
from pricetide.streaming import qps
from pricetide.streaming.buckets import BucketedTable

T0 = dt.datetime(2024, 1, 1)


def _tables(spark):
    prods = spark.createDataFrame([(i, f"p{i}", Decimal("10.00"), 100 + i % 2, 1, True, T0) for i in range(1, 9)],
                                  schemas.PRODUCTS)
    sales = spark.createDataFrame(
        [(i, 1 + i % 7, Decimal("10.0000"), T0 + dt.timedelta(days=i % 30), Decimal(f"{5 + i % 9}.00")) for i in range(120)],
        schemas.SALES)
    promos = spark.createDataFrame([(1, 2, Decimal("15.00"), T0, T0, True, T0), (2, 2, Decimal("5.00"), T0, T0, False, T0)],
                                   schemas.PROMOTIONS)
    inv = spark.createDataFrame([(i, i, 5 * i, 1, T0) for i in range(1, 7)], schemas.INVENTORY)
    return {"products": prods, "sales": sales, "promotions": promos, "inventory": inv}


def _feed(spark, rows):
    """rows: (change_id, table, op, seq, w, payload dict)"""
    return spark.createDataFrame([(*r[:-1], json.dumps(r[-1])) for r in rows], mt.FEED_SCHEMA)


def _product(pid, price):
    return {"product_id": pid, "product_name": f"p{pid}", "base_price": price, "category_id": 100 + pid % 2,
            "supplier_id": 1, "available": True, "last_update_time": "2024-01-02T00:00:00.000000"}


def _prices(df):
    return {r["product_id"]: r["live_price"] for r in df.collect()}


def _batch(t):
    return _prices(pricing.inventory_item(t["products"], t["sales"], t["promotions"], t["inventory"]))


def test_replay_and_out_of_order_products(spark, scratch):
    tabs = _tables(spark)
    keeper = mt.Maintainer(spark, scratch, buckets=4)
    keeper.load(tabs)
    assert _prices(keeper.inventory_item(0)) == _batch(tabs)
    b0 = _feed(spark, [("a", "products", "U", 10, 1, _product(2, "20.00"))])
    b1 = _feed(spark, [("b", "products", "U", 5, 1, _product(2, "99.00")),        # older seq: must lose
                       ("c", "products", "D", 11, 1, _product(3, "10.00")),
                       ("d", "sales", "I", 0, 1, {"product_id": 4, "sale_price": "5.0000", "price": "5.00",
                                                  "sale_date": "2024-03-01T00:00:00.000000"})])
    keeper.fold(b0, 0)
    keeper.fold(b1, 1)
    first = _prices(keeper.inventory_item(2))
    keeper.fold(b1, 1)                                                              # batch 1 runs again
    assert _prices(keeper.inventory_item(2)) == first and 3 not in first
    prods = (tabs["products"].filter("product_id <> 3").withColumn("base_price", F.when(
        F.col("product_id") == 2, F.lit(Decimal("20.00"))).otherwise(F.col("base_price")).cast("decimal(10,2)")))
    sales = tabs["sales"].unionByName(spark.createDataFrame(
        [(100, 4, Decimal("5.0000"), dt.datetime(2024, 3, 1), Decimal("5.00"))], schemas.SALES))
    assert first == _batch({**tabs, "products": prods, "sales": sales})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_signed_changes_equal_batch(spark, scratch, seed):
    """Random inserts, deletes and updates of every table as images, shuffled over batches, some delivered twice."""
    rng, tabs = random.Random(seed), _tables(spark)
    now = {n: [r.asDict() for r in tabs[n].collect()] for n in ("sales", "promotions", "inventory")}
    fresh = {"sales": lambda: {"sale_id": rng.randrange(10 ** 6), "product_id": rng.randrange(1, 9), "price": Decimal(f"{rng.randrange(1, 20)}.00"),
                               "sale_price": Decimal(f"{rng.randrange(1, 20)}.0000"), "sale_date": T0 + dt.timedelta(days=rng.randrange(40))},
             "promotions": lambda: {"promotion_id": rng.randrange(10 ** 6), "product_id": rng.randrange(1, 9), "active": rng.random() < 0.7,
                                    "promotion_discount": Decimal(f"{rng.randrange(60)}.00"), "start_date": T0, "end_date": T0, "updated_at": T0},
             "inventory": lambda: {"inventory_id": rng.randrange(10 ** 6), "product_id": rng.randrange(1, 9), "stock": rng.randrange(90),
                                   "warehouse_id": 1, "restock_date": T0}}
    changes = []
    for i in range(60):
        name = rng.choice(sorted(now))
        kind = rng.choice("IUD")
        if kind != "I" and now[name]:
            gone = now[name].pop(rng.randrange(len(now[name])))
            changes.append((f"{i}-", name, "D", 0, -1, gone))
        if kind != "D":
            new = fresh[name]()
            now[name].append(new)
            changes.append((f"{i}+", name, "I", 0, 1, new))
    text = lambda p: {k: v.strftime("%Y-%m-%dT%H:%M:%S.%f") if isinstance(v, dt.datetime) else
                      str(v) if isinstance(v, Decimal) else v for k, v in p.items()}
    changes = [(*c[:-1], text(c[-1])) for c in changes]
    sent = changes + rng.sample(changes, 15)
    rng.shuffle(sent)
    for lo in range(0, len(sent), 25):
        _feed(spark, sent[lo:lo + 25]).coalesce(1).write.mode("append").parquet(f"{scratch}/feed")
    keeper = mt.Maintainer(spark, f"{scratch}/kept", buckets=3)
    keeper.load(tabs)
    keeper.start(f"{scratch}/feed", max_files_per_trigger=1).awaitTermination()
    final = {n: spark.createDataFrame([tuple(r[f.name] for f in tabs[n].schema.fields) for r in now[n]], tabs[n].schema) for n in now}
    assert _prices(keeper.inventory_item()) == _batch({**tabs, **final})


def test_cart_and_totals(spark, scratch):
    tabs = _tables(spark)
    cats = spark.createDataFrame([(1, "all", None), (100, "even", 1), (101, "odd", 1)], schemas.CATEGORIES)
    cart = spark.createDataFrame([(p, f"p{p}", 100, Decimal("1.00"), T0) for p in (1, 1, 2, 8)],
                                 "product_id bigint, product_name string, category_id bigint, price decimal(10,2), ts timestamp_ntz")
    keeper = mt.Maintainer(spark, scratch, buckets=4)
    keeper.load({**tabs, "shopping_cart": cart})
    line = lambda p: {"product_id": p, "product_name": f"p{p}"}
    keeper.fold(_feed(spark, [("1", "shopping_cart", "D", 0, -1, line(2)), ("2", "shopping_cart", "I", 0, 1, line(3)),
                              ("3", "shopping_cart", "D", 0, -1, line(1))]), 0)
    left = spark.createDataFrame([(p, f"p{p}", 100, Decimal("1.00"), T0) for p in (1, 3, 8)], cart.schema)
    items = pricing.inventory_item(tabs["products"], tabs["sales"], tabs["promotions"], tabs["inventory"])
    want = cartops.dynamic_cart(left, tabs["products"], cats, items, tabs["inventory"])
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(keeper.dynamic_cart(cats, 1)) == rows(want)
    assert rows(keeper.category_totals(cats, version=1)) == rows(hierarchy.category_totals(cats, want))


def test_a_batch_reads_only_the_buckets_it_touches(spark, scratch):
    tabs = _tables(spark)
    keeper = mt.Maintainer(spark, scratch, buckets=16)
    keeper.load(tabs)
    keeper.fold(_feed(spark, [("a", "sales", "I", 0, 1, {"product_id": 4, "sale_price": "5.0000", "price": "5.00",
                                                         "sale_date": "2024-03-01T00:00:00.000000"})]), 0)
    for name in ("sales", "facts"):
        assert sum(1 in v for v in keeper.tables[name]._versions().values()) == 1
    assert not any(1 in v for v in keeper.tables["inventory"]._versions().values())


def test_bucketed_table_versions(spark, scratch):
    t = BucketedTable(spark, scratch, "k bigint, n bigint", "k", 2)
    assert t.read(5).collect() == []
    df = spark.createDataFrame([(i, 0) for i in range(6)], "k bigint, n bigint")
    t.write(df, 0, range(2))
    one = t.touched(df.where("k = 3"))
    t.write(t.read(0, one).where("k <> 3"), 1, one)
    assert sorted(r.k for r in t.read(1).collect()) == [0, 1, 2, 4, 5] and t.read(0).count() == 6
    t.write(t.read(1, one).where("false"), 2, one)                    # a bucket that becomes empty stays so
    assert t.read(2, one).collect() == [] and t.read(2).count() == 6 - t.read(0, one).count()
    t.prune(2)
    assert t._versions()[one[0]] == [2] and t.read(2).count() == 6 - df.where(t.bucket() == one[0]).count()


def test_refresh_copies_and_log(spark, scratch):
    tabs = _tables(spark)
    log1 = mt.refresh_inventory_item(spark, tabs, scratch, as_of="2024-01-05 00:00:00").collect()
    log2 = mt.refresh_inventory_item(spark, tabs, scratch, as_of="2024-01-06 00:00:00").collect()
    assert len(log1) == 1 and len(log2) == 1
    assert log2[0]["last_refresh"] == dt.datetime(2024, 1, 6)
    assert _prices(mt.refreshed(spark, scratch)) == _batch(tabs)
    with pytest.raises(ValueError):
        mt.refreshed(spark, f"{scratch}/nowhere")


def test_heartbeat_and_refresh_loop(spark, scratch):
    import time
    q = qps.heartbeat_stream(spark, f"{scratch}/hb", f"{scratch}/hb_ckpt")
    tabs = _tables(spark)
    r = mt.refresh_loop(spark, lambda: tabs, f"{scratch}/mv", interval="1 second")
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            if mt.refresh_log(spark, f"{scratch}/mv").count() and len(q.recentProgress) > 2:
                break
            time.sleep(1)
    finally:
        q.stop()
        r.stop()
    assert spark.read.parquet(f"{scratch}/hb").count() >= 1
    assert mt.refreshed(spark, f"{scratch}/mv").count() == 7


def test_rates_count_late_rows(spark, scratch):
    rows = [(i, T0 + dt.timedelta(seconds=7 * i), "ab"[i % 2], 1.0, 1) for i in range(600)]
    log = spark.createDataFrame(rows, schemas.QUERY_LOG)
    for part in (4, 0, 3, 1, 2):           # five parts out of time order, one restart each
        log.filter((F.col("seq") >= part * 120) & (F.col("seq") < (part + 1) * 120)) \
            .write.mode("append").parquet(f"{scratch}/log")
        qps.stream_qps(spark, f"{scratch}/log", f"{scratch}/out", buckets=4).awaitTermination()
    got = {(r["source"], r["window_start"]): r["n"] for r in qps.read_qps(spark, f"{scratch}/out", 4).collect()}
    expect = {}
    for _, ts, src, _, _ in rows:
        w = ts.replace(second=0, microsecond=0)
        expect[(src, w)] = expect.get((src, w), 0) + 1
    assert got == expect


def test_a_watermark_drops_late_rows_and_says_so(spark, scratch):
    rows = [(i, T0 + dt.timedelta(hours=i), "a", 1.0, 1) for i in range(10)]
    log, dropped = spark.createDataFrame(rows, schemas.QUERY_LOG), 0
    for part in (rows[5:], rows[:5]):
        spark.createDataFrame(part, log.schema).write.mode("append").parquet(f"{scratch}/log")
        q = qps.stream_qps(spark, f"{scratch}/log", f"{scratch}/out", watermark="10 seconds", buckets=2)
        q.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped == 5 and qps.read_qps(spark, f"{scratch}/out", 2).count() == 5
