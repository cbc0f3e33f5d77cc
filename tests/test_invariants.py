"""Invariants on the derived tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetide.operators import cart as cartops
from pricetide.operators import hierarchy, pricing
from pricetide.sources.testdata import retail_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    t = retail_tables(spark, SF)
    factors = pricing.item_factors(t.products, t.sales, t.promotions, t.inventory)
    items = pricing.live_price_of(factors)
    dc = cartops.dynamic_cart(t.shopping_cart, t.products, t.categories, items, t.inventory)
    totals = hierarchy.category_totals(t.categories, dc, other_offset=10000)
    return t, factors, items, dc, totals


def test_prices_non_negative(views):
    _, _, items, _, _ = views
    assert items.filter(F.col("live_price") < 0).count() == 0


def test_parent_total_is_children_plus_other(views):
    t, _, _, _, totals = views
    rows = totals.collect()
    by_id = {r["category_id"]: r for r in rows}
    children = {}
    for r in rows:
        if r["parent_id"] is not None:
            children.setdefault(r["parent_id"], []).append(r)
    for cid, r in by_id.items():
        if r["category_name"] == "Other":
            continue
        kids = children.get(cid, [])
        if kids:
            assert sum(k["total"] for k in kids) == r["total"], cid
            assert sum(k["item_count"] for k in kids) == r["item_count"], cid
    leaves = {r["category_id"] for r in t.categories.collect()} - {
        r["parent_id"] for r in t.categories.collect() if r["parent_id"] is not None}
    assert not any(r["category_name"] == "Other" and r["parent_id"] in leaves for r in rows)


def test_roots_total_equals_cart_total(views):
    _, _, _, dc, totals = views
    rec = cartops.reconcile_cart(dc, totals).collect()[0]
    assert rec["delta"] == Decimal("0.00")


def test_popularity_band_monotone(views, spark):
    t, factors, _, _, _ = views
    pc = pricing.popularity_counts(t.sales, t.products).join(factors, "product_id")
    rows = pc.select("category_id", "sale_count", "popularity_adjustment").collect()
    per_cat = {}
    for r in rows:
        per_cat.setdefault(r["category_id"], []).append((r["sale_count"], r["popularity_adjustment"]))
    for lst in per_cat.values():
        lst.sort()
        assert all(a[1] <= b[1] for a, b in zip(lst, lst[1:]))
