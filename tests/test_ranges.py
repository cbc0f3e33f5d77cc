"""Ranges of values, readings at moments, change rows."""

import bisect
import datetime as dt
import random

import pytest

from pricetide.operators import change_rows, changes, metrics
from pricetide.operators.ordering import range_of
from pricetide.sources.testdata import retail_tables
from pricetide.streaming import live

T0 = dt.datetime(2024, 1, 1)
AS_OF = "2024-05-01 00:00:00"


@pytest.mark.parametrize("n", [0, 1, 7, 128, 129, 1000])
def test_range_of_counts_the_bounds_below(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.sample(range(10_000), n))
    values = [rng.randrange(-5, 10_005) for _ in range(200)] + bounds[:40] + [None]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", range_of("v", bounds).alias("r")).collect()
    assert all(r.r == (0 if r.v is None else bisect.bisect_left(bounds, r.v)) for r in got)


def test_readings_at_moments(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    log = spark.createDataFrame([(1, at(0), "a", 1.0), (2, at(5), "a", 2.0), (3, at(5), "a", 3.0), (4, at(7), "b", 9.0),
                                 (5, at(100), "a", 4.0), (6, at(3), "x", 5.0), (7, None, "a", 6.0)],
                                "seq bigint, ts timestamp_ntz, source string, latency_ms double")
    moments = spark.createDataFrame([(i, at(s)) for i, s in enumerate((-1, 0, 4, 5, 50, 200))], "id int, ts timestamp_ntz")
    for parts in (1, 4):
        got = {r.id: (r.a_latency_ms, r.a_age_s, r.b_latency_ms, r.b_age_s) for r in
               metrics.readings_at(moments, log, ["a", "b"], partitions=parts).collect()}
        assert got == {0: (None, None, None, None), 1: (1.0, 0.0, None, None), 2: (1.0, 4.0, None, None), 3: (3.0, 0.0, None, None),
                       4: (3.0, 45.0, 9.0, 43.0), 5: (4.0, 100.0, 9.0, 193.0)}
    assert metrics.readings_at(moments.where("false"), log, ["a"]).collect() == []


def test_change_rows_fold_to_the_tables(spark):
    t = retail_tables(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    pid = t.promotions.first()["product_id"]
    toggled = change_rows.toggle_promotion(t.products, t.promotions, pid, AS_OF)
    assert {r.before.product_id for r in toggled.collect()} == {pid}
    assert rows(change_rows.folded(t.promotions, toggled)) == rows(changes.toggle_promotion(t.products, t.promotions, pid, AS_OF))
    with pytest.raises(Exception, match="does not exist"):
        change_rows.toggle_promotion(t.products, t.promotions, 10 ** 9, AS_OF).collect()
    new = change_rows.add_to_cart(t.shopping_cart, t.products, t.inventory, as_of=AS_OF, seed=7)
    cart, inventory = changes.add_to_cart(t.shopping_cart, t.products, t.inventory, as_of=AS_OF, seed=7)
    assert rows(change_rows.folded(t.shopping_cart, new["shopping_cart"])) == rows(cart)
    assert rows(change_rows.folded(t.inventory, new["inventory"])) == rows(inventory)
    jitter = change_rows.stock_jitter(t.shopping_cart, t.inventory)
    assert rows(change_rows.folded(t.inventory, jitter)) == rows(changes.stock_jitter(t.shopping_cart, t.inventory))
    deleted = change_rows.cart_delete(t.shopping_cart)
    assert rows(change_rows.folded(t.shopping_cart, deleted)) == rows(
        changes.cart_delete(t.shopping_cart).select(*t.shopping_cart.columns))
    assert {r.op for r in deleted.collect()} == {"D"}


def test_a_toggle_reads_its_products_rows(spark):
    t = retail_tables(spark, "/root/testdata/sf0.001")
    plan = change_rows.toggle_promotion(t.products, t.promotions, 1, AS_OF, first_id=9)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("EqualTo(" in s for s in scans)


def test_user_actions_reach_the_live_prices(spark, scratch):
    t = retail_tables(spark, "/root/testdata/sf0.001")
    views = live.LiveViews(spark, scratch, buckets=1)
    views.load({n: getattr(t, n) for n in live.IMAGES})
    before = {r.product_id: r.live_price for r in views.reader(0).inventory_item().collect()}
    pid = t.promotions.where("active AND promotion_discount > 0").first()["product_id"]
    feed = change_rows.logged(change_rows.toggle_promotion(t.products, t.promotions, pid, AS_OF), "promotions", "users", ["promotion_id"])
    views.fold(feed, 0)
    deltas = {r.product_id: (r.old_price, r.new_price) for r in views.price_deltas(0, 1).collect()}
    after = {r.product_id: r.live_price for r in views.reader(1).inventory_item().collect()}
    assert deltas == {p: (before[p], after[p]) for p in before if before[p] != after[p]} and set(deltas) <= {pid}
