"""One product holding a third of all sales: same prices as a plain SQL formulation."""

from pyspark.sql import functions as F

from pricetide.operators import pricing
from pricetide.sources import datagen


def test_hot_product_prices_match_sql(spark):
    prods = datagen.gen_products(spark, 300, seed=5)
    sales = datagen.gen_sales(prods, rounds=20, per_round=None, seed=5, hot_product=7, hot_share=1 / 3)
    promos = datagen.gen_promotions(prods, rounds=2, per_round=None, seed=5)
    inv = datagen.gen_inventory(prods, rounds=2, per_round=None, seed=5)
    n_hot = sales.filter("product_id = 7").count()
    assert n_hot >= sales.count() / 3 - 1

    got = {r["product_id"]: r["live_price"] for r in pricing.inventory_item(prods, sales, promos, inv).collect()}
    for name, df in (("p", prods), ("s", sales), ("pr", promos), ("i", inv)):
        df.createOrReplaceTempView(f"skew_{name}")
    expect_df = spark.sql("""
    WITH rp AS (SELECT product_id, CAST(SUM(price) AS DOUBLE) / COUNT(*) AS avg_price FROM (
                  SELECT product_id, price, ROW_NUMBER() OVER (PARTITION BY product_id
                                                ORDER BY sale_date DESC, price DESC) AS rn FROM skew_s) WHERE rn <= 10
                GROUP BY product_id),
         pe AS (SELECT product_id, MIN(promotion_discount) AS d FROM skew_pr WHERE active GROUP BY product_id),
         pop AS (SELECT s.product_id, RANK() OVER (PARTITION BY p.category_id ORDER BY COUNT(*) DESC) AS r
                 FROM skew_s s JOIN skew_p p ON s.product_id = p.product_id GROUP BY s.product_id, p.category_id),
         inv AS (SELECT product_id, RANK() OVER (ORDER BY SUM(stock) DESC) AS r FROM skew_i GROUP BY product_id)
    SELECT p.product_id,
      CAST(ROUND(CAST(p.base_price AS DOUBLE)
        * CASE WHEN pop.r <= 3 THEN 1.2D WHEN pop.r <= 10 THEN 1.1D ELSE 0.9D END
        * COALESCE(1.0D - CAST(pe.d AS DOUBLE) / 100.0D, 1.0D)
        * CASE WHEN inv.r <= 3 THEN 1.1D WHEN inv.r <= 10 THEN 1.05D ELSE 1.0D END
        * (CAST(p.base_price AS DOUBLE) / rp.avg_price)
        * CASE WHEN p.product_name ILIKE '%cheap%' THEN 0.8D ELSE 1.0D END, 6) AS DECIMAL(20,6)) AS live_price
    FROM skew_p p JOIN pop ON p.product_id = pop.product_id
    LEFT JOIN rp ON p.product_id = rp.product_id LEFT JOIN pe ON p.product_id = pe.product_id
    LEFT JOIN inv ON p.product_id = inv.product_id""")
    expect = {r["product_id"]: r["live_price"] for r in expect_df.collect()}
    assert got == expect
    assert got[7] is not None


def test_hot_key_latest_and_changes_are_aggregates(spark):
    from pricetide.operators import changes
    from pricetide.sources import io
    hot = spark.range(100_000).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("seq"),
                                      F.lit("U").alias("op"), (F.col("id") % 97).cast("string").alias("v"))
    latest = io.latest_by_key(hot.select("k", "seq", "v"), ["k"], ["seq"]).collect()
    assert latest[0]["seq"] == 99_999
    plan = io.latest_by_key(hot.select("k", "seq", "v"), ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
    base = spark.createDataFrame([(1, "x")], "k bigint, v string")
    assert changes.apply_changes(base, hot, ["k"]).collect()[0]["v"] == str(99_999 % 97)
