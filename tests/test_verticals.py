"""Several verticals in one job: the same rows as each vertical alone, and only its folders read."""

import re

import pytest
from pyspark.sql import functions as F

from pricetide.operators import cart, hierarchy, pricing
from pricetide.sources import io

NAMES = ["products", "sales", "promotions", "inventory", "shopping_cart", "categories"]
BY = [io.VERTICAL]


def _tables(spark, scale):
    """A vertical's tables; ids are the same in each, numbers aren't."""
    products = spark.range(1, 31).selectExpr(
        "id AS product_id", "concat('P', id, if(id % 4 = 0, ' cheap', '')) AS product_name",
        f"CAST(id * {scale} AS DECIMAL(10,2)) AS base_price", f"10 + id % {1 + scale} AS category_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS last_update_time")
    sales = spark.range(400).selectExpr(
        "id AS sale_id", f"1 + pmod(xxhash64(id, {scale}), 28) AS product_id", "CAST(5 + id % 7 AS DECIMAL(18,4)) AS sale_price",
        "timestampadd(HOUR, id, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS sale_date", f"CAST(6 + id % (3 * {scale}) AS DECIMAL(12,2)) AS price")
    promotions = spark.range(1, 20).selectExpr(
        "id AS promotion_id", "id AS product_id", "CAST(id % 9 * 5 AS DECIMAL(10,2)) AS promotion_discount", f"id % {1 + scale} = 0 AS active")
    inventory = spark.range(60).selectExpr("id AS inventory_id", "1 + id % 30 AS product_id", "1 AS warehouse_id",
                                           f"CAST(pmod(xxhash64(id, {scale}), 50) AS INT) AS stock")
    lines = spark.range(50).selectExpr(f"1 + pmod(xxhash64(id, {scale}, 1), 30) AS product_id").selectExpr(
        "product_id", "concat('P', product_id) AS product_name")
    tree = spark.createDataFrame([(1, "top", None), *[(10 + i, f"c{i}", 1) for i in range(1 + scale)]],
                                 "category_id bigint, category_name string, parent_id bigint")
    return dict(zip(NAMES, (products, sales, promotions, inventory, lines, tree)))


def _results(t, by=()):
    items = pricing.inventory_item(t["products"], t["sales"], t["promotions"], t["inventory"], by=by)
    view = cart.dynamic_cart(t["shopping_cart"], t["products"], t["categories"], items, t["inventory"], by=by)
    totals = hierarchy.category_totals(t["categories"], view, by=by)
    return {"items": items, "bands": pricing.stock_bands(t["inventory"], by=by),
            "demand": pricing.high_demand(t["products"], t["sales"], by=by), "cart": view, "totals": totals,
            "subtotals": cart.category_subtotals(totals, [1], by=by), "reconcile": cart.reconcile_cart(view, totals, by=by)}


@pytest.fixture()
def stored(spark, scratch):
    own = {"retail": _tables(spark, 1), "securities": _tables(spark, 3)}
    for vertical, tables in own.items():
        io.write_verticals(tables, scratch, vertical=vertical)
    return own, scratch


def _rows(df, vertical=None):
    cols = [c for c in sorted(df.columns) if c != io.VERTICAL]
    df = df if vertical is None else df.where(df[io.VERTICAL] == vertical)
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def test_one_run_equals_a_run_of_each(spark, stored):
    own, root = stored
    together = _results(io.read_verticals(spark, root, NAMES), BY)
    for vertical, tables in own.items():
        for name, alone in _results(tables).items():
            want = _rows(alone)
            assert want and _rows(together[name], vertical) == want, (vertical, name)


def test_a_vertical_reads_only_its_folders(spark, stored):
    _, root = stored
    one = _results(io.read_verticals(spark, root, NAMES, ["retail"]), BY)["cart"]
    late = _results(io.read_verticals(spark, root, NAMES), BY)["cart"].where("vertical = 'retail'")
    for df in (one, late):                       # chosen at the scan, or asked of the finished view
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        scans = re.findall(r"^\(\d+\) Scan parquet.*?\n\n", plan, re.S | re.M)
        assert scans and all(re.search(r"PartitionFilters: \[.*vertical", s) for s in scans), plan


def test_rows_without_a_vertical_belong_to_none(spark):
    t = {n: df.withColumn(io.VERTICAL, F.lit(None).cast("string")) for n, df in _tables(spark, 1).items()}
    assert _results(t, BY)["items"].count() == 0
