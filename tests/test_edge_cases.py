"""Hand-made edge tables with literal expected results (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.operators import cart as cartops
from pricetide.operators import changes, hierarchy, metrics, pricing

T0 = dt.datetime(2024, 1, 1)


def products_df(spark, rows):
    """rows: (product_id, name, base_price, category_id)"""
    data = [(p, n, Decimal(str(b)), c, 1, True, T0) for p, n, b, c in rows]
    return spark.createDataFrame(data, schemas.PRODUCTS)


def sales_df(spark, rows):
    """rows: (sale_id, product_id, price, day)"""
    data = [(i, p, Decimal(str(pr)).quantize(Decimal("0.0001")), T0 + dt.timedelta(days=d),
             Decimal(str(pr)).quantize(Decimal("0.01"))) for i, p, pr, d in rows]
    return spark.createDataFrame(data, schemas.SALES)


def promos_df(spark, rows):
    """rows: (promotion_id, product_id, discount, active, end_day)"""
    data = [(i, p, Decimal(str(d)), T0, T0 + dt.timedelta(days=e), a, T0) for i, p, d, a, e in rows]
    return spark.createDataFrame(data, schemas.PROMOTIONS)


def inv_df(spark, rows):
    """rows: (inventory_id, product_id, stock, warehouse)"""
    data = [(i, p, s, w, T0) for i, p, s, w in rows]
    return spark.createDataFrame(data, schemas.INVENTORY)


def factors_of(spark, prods, sales, promos, inv):
    f = pricing.item_factors(prods, sales, promos, inv)
    return {r["product_id"]: r for r in f.collect()}


def price_of(spark, prods, sales, promos, inv):
    return {r["product_id"]: r["live_price"] for r in pricing.inventory_item(prods, sales, promos, inv).collect()}


# --------------------------------------------------------------------------- pricing

def test_product_without_sales_is_absent(spark):
    prods = products_df(spark, [(1, "a", 10, 100), (9, "b", 10, 100)])
    sales = sales_df(spark, [(1, 1, 10, 0)])
    got = price_of(spark, prods, sales, promos_df(spark, []), inv_df(spark, []))
    assert set(got) == {1}


def test_promotion_rules(spark):
    prods = products_df(spark, [(1, "a", 10, 100), (2, "b", 10, 100), (3, "c", 10, 100),
                                (4, "d", 10, 100), (5, "e", 10, 100)])
    sales = sales_df(spark, [(i, i, 10, 0) for i in range(1, 6)])
    promos = promos_df(spark, [
        (1, 2, 30, False, 10),                       # inactive only -> 1
        (2, 3, 5, True, 10), (3, 3, 20, True, 10),   # two active -> MIN 5
        (4, 4, 50, True, -400),                      # expired but active -> applied
        (5, 5, 100, True, 10),                       # 100 % -> price 0
    ])
    f = factors_of(spark, prods, sales, promos, inv_df(spark, []))
    assert f[1]["promotion_discount"] == 1.0
    assert f[2]["promotion_discount"] == 1.0
    assert f[3]["promotion_discount"] == pytest.approx(0.95)
    assert f[4]["promotion_discount"] == pytest.approx(0.5)
    p = price_of(spark, prods, sales, promos, inv_df(spark, []))
    assert p[5] == Decimal("0.000000")


def test_no_inventory_row_has_stock_factor_one_and_zero_stock(spark):
    prods = products_df(spark, [(1, "a", 10, 100)])
    sales = sales_df(spark, [(1, 1, 10, 0)])
    f = factors_of(spark, prods, sales, promos_df(spark, []), inv_df(spark, []))
    assert f[1]["stock_adjustment"] == 1.0
    cats = spark.createDataFrame([(100, "root", None)], schemas.CATEGORIES)
    cart = spark.createDataFrame([(1, "a", 100, Decimal("10.00"), T0)], schemas.SHOPPING_CART)
    items = pricing.inventory_item(prods, sales, promos_df(spark, []), inv_df(spark, []))
    dc = cartops.dynamic_cart(cart, prods, cats, items, inv_df(spark, [])).collect()
    assert dc[0]["available_stock"] == 0


def test_rank_ties_share_band_and_next_rank_skips(spark):
    # sales counts in one category: 5,5,5,5 (ranks 1), then 3 (rank 5) ... 11 products
    counts = [5, 5, 5, 5, 3, 3, 3, 3, 3, 3, 1]
    prods = products_df(spark, [(i, f"p{i}", 10, 100) for i in range(len(counts))])
    rows, sid = [], 0
    for pid, c in enumerate(counts):
        for _ in range(c):
            rows.append((sid, pid, 10, sid))
            sid += 1
    sales = sales_df(spark, rows)
    f = factors_of(spark, prods, sales, promos_df(spark, []), inv_df(spark, []))
    bands = [f[i]["popularity_adjustment"] for i in range(len(counts))]
    # ranks: 1,1,1,1 -> 1.2 ; 5..10 -> 1.1 (six products tied at rank 5) ; rank 11 -> 0.9
    assert bands == [1.2] * 4 + [1.1] * 6 + [0.9]
    ranked = {r["product_id"]: r["popularity_rank"] for r in pricing.popularity_score(sales, prods).collect()}
    assert [ranked[i] for i in range(len(counts))] == [1] * 4 + [5] * 6 + [11]


def test_fewer_than_three_products_all_top_band(spark):
    prods = products_df(spark, [(1, "a", 10, 100), (2, "b", 10, 100)])
    sales = sales_df(spark, [(1, 1, 10, 0), (2, 1, 10, 1), (3, 2, 10, 0)])
    inv = inv_df(spark, [(1, 1, 5, 1)])
    f = factors_of(spark, prods, sales, promos_df(spark, []), inv)
    assert f[1]["popularity_adjustment"] == 1.2 and f[2]["popularity_adjustment"] == 1.2
    assert f[1]["stock_adjustment"] == 1.1


def test_stock_threshold_matches_rank_with_ties(spark):
    stocks = [50, 50, 50, 50, 40, 30, 30, 20, 10, 10, 10, 5, 1]
    inv = inv_df(spark, [(i, i, s, 1) for i, s in enumerate(stocks)])
    bands = {r["product_id"]: r["stock_adjustment"] for r in pricing.stock_bands(inv).collect()}
    ranks = {r["product_id"]: r["stock_rank"] for r in pricing.inventory_status(inv).collect()}
    for pid in ranks:
        r = ranks[pid]
        expect = 1.1 if r <= 3 else 1.05 if r <= 10 else 1.0
        assert bands[pid] == expect, (pid, r)


def test_recent_prices_tie_on_date_keeps_higher_price(spark):
    # 12 sales; the 10th and 11th newest share a date: the higher price is kept
    rows = [(i, 1, 100, 100 - i) for i in range(9)]          # 9 newest, price 100
    rows += [(9, 1, 50, 50), (10, 1, 70, 50), (11, 1, 1, 10)]  # tie on day 50
    avg = pricing.recent_prices(sales_df(spark, rows)).collect()[0]["avg_price"]
    assert avg == pytest.approx((9 * 100 + 70) / 10)


def test_zero_average_gives_null_price(spark):
    prods = products_df(spark, [(1, "a", 10, 100)])
    sales = sales_df(spark, [(1, 1, 0, 0)])
    assert price_of(spark, prods, sales, promos_df(spark, []), inv_df(spark, []))[1] is None


def test_cheap_in_any_case(spark):
    prods = products_df(spark, [(1, "Very CHEAP thing", 10, 100), (2, "cheaP", 10, 100), (3, "dear", 10, 100)])
    sales = sales_df(spark, [(i, i, 10, 0) for i in (1, 2, 3)])
    f = factors_of(spark, prods, sales, promos_df(spark, []), inv_df(spark, []))
    assert [f[i]["additional_discount"] for i in (1, 2, 3)] == [0.8, 0.8, 1.0]


# --------------------------------------------------------------------------- cart and categories

def _tree(spark):
    # 1 root -> 10 (has direct items and a child 20); 30 a root without items
    return spark.createDataFrame([(1, "root", None), (10, "mid", 1), (20, "leaf", 10), (30, "empty", None)],
                                 schemas.CATEGORIES)


def test_cart_twice_two_warehouses(spark):
    prods = products_df(spark, [(1, "a", 10, 20)])
    sales = sales_df(spark, [(1, 1, 10, 0)])
    inv = inv_df(spark, [(1, 1, 5, 1), (2, 1, 5, 2)])
    cart = spark.createDataFrame([(1, "a", 20, Decimal("10.00"), T0)] * 2, schemas.SHOPPING_CART)
    items = pricing.inventory_item(prods, sales, promos_df(spark, []), inv)
    dc = cartops.dynamic_cart(cart, prods, _tree(spark), items, inv).collect()
    assert len(dc) == 1 and dc[0]["available_stock"] == 20
    dd = cartops.dynamic_cart(cart, prods, _tree(spark), items, inv, dedupe_stock=True).collect()
    assert dd[0]["available_stock"] == 10


def _cart_view(spark, rows):
    return spark.createDataFrame(
        [(p, f"p{p}", c, "x", Decimal(str(pr)), 0) for p, c, pr in rows],
        "product_id bigint, product_name string, category_id bigint, category_name string, "
        "price decimal(20,6), available_stock bigint")


def test_category_totals_tree(spark):
    view = _cart_view(spark, [(1, 10, "2.5"), (2, 20, "4"), (3, 20, "1")])
    rows = {r["category_id"]: r for r in hierarchy.category_totals(_tree(spark), view).collect()}
    assert set(rows) == {1, 10, 20, 1010}                      # 30 has nothing below: absent
    assert rows[1]["total"] == Decimal("7.5") and rows[1]["item_count"] == 3
    assert rows[10]["total"] == Decimal("7.5") and rows[10]["has_subcategory"]
    assert rows[20]["total"] == Decimal("5") and not rows[20]["has_subcategory"]
    other = rows[1010]
    assert other["parent_id"] == 10 and other["category_name"] == "Other"
    assert other["total"] == Decimal("2.5") and other["item_count"] == 1


def test_category_cycle_is_reported(spark):
    cats = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], schemas.CATEGORIES)
    view = _cart_view(spark, [(1, 1, "1")])
    with pytest.raises(Exception, match="cycle"):
        hierarchy.category_totals(cats, view).collect()


def test_closure_of_a_deep_chain_and_a_cycle_below_it(spark):
    chain = spark.range(1, 151).selectExpr("id AS category_id", "CAST(id AS STRING) AS category_name",
                                           "CASE WHEN id > 1 THEN id - 1 END AS parent_id")
    got = {(r.category_id, r.ancestor_id): r.depth for r in hierarchy.ancestor_closure(chain).collect()}
    assert got == {(c, a): c - a for c in range(1, 151) for a in range(1, c + 1)}
    total = hierarchy.category_totals(chain, _cart_view(spark, [(1, 150, "2"), (2, 75, "3")])).where("category_id = 1")
    assert total.first()["total"] == Decimal("5")
    tail = chain.selectExpr("category_id", "category_name", "CASE WHEN category_id = 1 THEN 40 ELSE parent_id END AS parent_id")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.ancestor_closure(tail)


def test_closure_above_a_million_pairs(spark):
    """16,384 leaves in a binary tree below a chain of 60: more pairs than the engine's recursion allows rows."""
    nodes = spark.range(1, 32768).selectExpr("id + 60 AS category_id", "CAST(id AS STRING) AS category_name",
                                             "CASE WHEN id = 1 THEN 60 ELSE id DIV 2 + 60 END AS parent_id")
    chain = spark.range(1, 61).selectExpr("id AS category_id", "CAST(id AS STRING) AS category_name",
                                          "CASE WHEN id > 1 THEN id - 1 END AS parent_id")
    got = hierarchy.ancestor_closure(chain.unionByName(nodes))
    want = 60 * 61 // 2 + sum(2 ** k * (k + 61) for k in range(15))
    assert got.count() == want > 2_000_000 and got.agg(F.max("depth")).first()[0] == 74


def test_other_id_collision_raises(spark):
    cats = spark.createDataFrame([(1, "root", None), (2, "child", 1), (1001, "clash", 2)], schemas.CATEGORIES)
    view = _cart_view(spark, [(1, 1, "1"), (2, 2, "1")])
    with pytest.raises(Exception, match="collides"):
        hierarchy.category_totals(cats, view).collect()


def test_expanded_filter(spark):
    view = _cart_view(spark, [(1, 10, "2.5"), (2, 20, "4")])
    totals = hierarchy.category_totals(_tree(spark), view)
    ids = lambda e: sorted(r["category_id"] for r in cartops.category_subtotals(totals, e).collect())
    assert ids([]) == [1]
    assert ids([999]) == [1]
    assert ids([1]) == [1, 10]
    sub = cartops.category_subtotals(totals, [1]).collect()
    assert all(r["categories_total"] == Decimal("6.50") for r in sub)


# --------------------------------------------------------------------------- metrics

@pytest.mark.parametrize("n,p99", [(1, 1), (99, 99), (100, 100), (250, 248)])
def test_p99_nearest_rank(spark, n, p99):
    log = spark.createDataFrame([("s", float(i)) for i in range(1, n + 1)], "source string, latency_ms double")
    got = metrics.sample_stats(log, ["source"], "latency_ms").collect()[0]
    assert got["p99"] == p99 and got["max"] == n


def test_median_even_and_odd(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 10.0), ("b", 1.0), ("b", 2.0)], "g string, v double")
    got = {r["g"]: r["median"] for r in metrics.median_by(df, ["g"], "v").collect()}
    assert got == {"a": 3.0, "b": 1.5}


def test_heartbeat_lag(spark):
    src = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(seconds=10))], schemas.HEARTBEATS)
    as_of = "2024-01-01 00:00:30"
    equal = metrics.heartbeat_lag(src, src, as_of).collect()[0]["lag_s"]
    behind = metrics.heartbeat_lag(src, src.filter("id = 1"), as_of).collect()[0]["lag_s"]
    assert equal == 0.0 and behind == 30.0


def test_trailing_count_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, T0 + dt.timedelta(microseconds=rnd.randrange(0, 5_000_000)), rnd.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, source string")
    got = {r["seq"]: r["n_window"] for r in metrics.trailing_count(df, ["source"], "ts", 1.0).collect()}
    for s, t, src in rows:
        expect = sum(1 for _, t2, s2 in rows if s2 == src and t - dt.timedelta(seconds=1) <= t2 <= t)
        assert got[s] == expect


def test_carry_forward_and_previous_match_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        v = rnd.choice([None, None, 1.0, 2.0, 3.0])
        rows.append((i, T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 30)), rnd.choice("xy"), v))
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, source string, price double")
    cf = {r["seq"]: r["c"] for r in metrics.carry_forward(df, ["source"], "ts", "price", "c", ["seq"]).collect()}
    pv = {r["seq"]: r["p"] for r in metrics.previous_value(df, ["source"], "ts", "price", "p", ["seq"]).collect()}
    for src in "xy":
        seq_rows = sorted((r for r in rows if r[2] == src), key=lambda r: (r[1], r[0]))
        last, prev = None, None
        for k, r in enumerate(seq_rows):
            if r[3] is not None:
                last = r[3]
            assert cf[r[0]] == last
            assert pv[r[0]] == (seq_rows[k - 1][3] if k else None)


# --------------------------------------------------------------------------- changes

def test_toggle_promotion(spark):
    prods = products_df(spark, [(1, "a", 10, 100), (2, "b", 10, 100)])
    promos = promos_df(spark, [(1, 1, 5, True, 10), (2, 1, 20, False, 10)])
    flipped = changes.toggle_promotion(prods, promos, 1, "2024-02-01 00:00:00").collect()
    assert sorted((r["promotion_id"], r["active"]) for r in flipped) == [(1, False), (2, True)]
    new = changes.toggle_promotion(prods, promos, 2, "2024-02-01 00:00:00").collect()
    added = [r for r in new if r["product_id"] == 2]
    assert len(added) == 1 and added[0]["promotion_id"] == 3 and added[0]["active"]
    assert added[0]["promotion_discount"] == Decimal("10.00")
    with pytest.raises(Exception, match="does not exist"):
        changes.toggle_promotion(prods, promos, 77, "2024-02-01 00:00:00").collect()


def test_stock_jitter_floors_at_zero(spark):
    cart = spark.createDataFrame([(1, "a", 1, Decimal("1.00"), T0)], schemas.SHOPPING_CART)
    inv = inv_df(spark, [(1, 1, 3, 1)])
    out = changes.stock_jitter(cart, inv, delta=F.lit(-5)).collect()
    assert out[0]["stock"] == 0


def test_stock_jitter_sequential_clamps(spark):
    # two distinct stock values -> two clamped updates in ascending stock order: -5 then +4
    cart = spark.createDataFrame([(1, "a", 1, Decimal("1.00"), T0)], schemas.SHOPPING_CART)
    inv = inv_df(spark, [(1, 1, 2, 1), (2, 1, 9, 2)])
    delta = F.when(F.col("stock") == 2, -5).otherwise(4)
    out = {r["inventory_id"]: r["stock"] for r in changes.stock_jitter(cart, inv, delta=delta).collect()}
    # row 1: max(0, 2-5)=0 -> 0+4=4 ; row 2: 9-5=4 -> 8
    assert out == {1: 4, 2: 8}


def test_apply_changes_out_of_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, v string")
    ch = spark.createDataFrame([("U", 5, 1, "a5"), ("U", 3, 1, "a3"), ("D", 4, 2, None), ("I", 1, 2, "b1"),
                                ("I", 2, 9, "new")], "op string, seq bigint, k bigint, v string")
    got = sorted(tuple(r) for r in changes.apply_changes(base, ch, ["k"]).collect())
    assert got == [(1, "a5"), (3, "c"), (9, "new")]


def test_bag_changes_and_expand(spark):
    base = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    ch = spark.createDataFrame([(-1, "x"), (1, "z"), (-1, "y")], "w int, v string")
    bag = {r["v"]: r["multiplicity"] for r in changes.apply_changes_bag(base, ch).collect()}
    assert bag == {"x": 1, "z": 1}
    big = spark.createDataFrame([("h", 25_001)], "v string, multiplicity bigint")
    assert changes.expand_bag(big, chunk=10_000).count() == 25_001
