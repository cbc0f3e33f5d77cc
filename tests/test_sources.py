"""Loading, de-duplication, audits, layout, generators and positions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricetide import schemas
from pricetide.sources import datagen, io


def test_read_csv_declared_schema_and_tf_booleans(spark, scratch):
    path = f"{scratch}/promotions.csv"
    with open(path, "w") as f:
        f.write("promotion_id,product_id,promotion_discount,start_date,end_date,active,updated_at\n")
        f.write("1,24,100.00,2024-01-01 00:00:00,2024-02-01 00:00:00,f,2024-01-01 10:00:00.123456\n")
        f.write("2,24,5.50,2024-01-01 00:00:00,2024-02-01 00:00:00,t,\n")
    df = io.read_table(spark, "promotions", path)
    assert df.schema == schemas.PROMOTIONS or [f.dataType for f in df.schema] == \
        [f.dataType for f in schemas.PROMOTIONS]
    rows = sorted(df.collect(), key=lambda r: r["promotion_id"])
    assert rows[0]["active"] is False and rows[1]["active"] is True
    assert rows[0]["promotion_discount"] == Decimal("100.00")
    assert rows[0]["updated_at"] == dt.datetime(2024, 1, 1, 10, 0, 0, 123456)
    assert rows[1]["updated_at"] is None


def test_read_chunks_glob(spark, scratch):
    import os
    os.makedirs(f"{scratch}/chunks")
    for i in range(3):
        with open(f"{scratch}/chunks/chunk_{i}", "w") as f:
            f.write("supplier_id,supplier_name\n")
            f.write(f"{i},s{i}\n")
    df = io.read_chunks(spark, "suppliers", f"{scratch}/chunks/chunk_*")
    assert sorted(r["supplier_id"] for r in df.collect()) == [0, 1, 2]


def test_latest_by_key_keeps_newest(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "old", t), (1, "new", t + dt.timedelta(1)), (2, "only", t)],
                               "product_id bigint, product_name string, last_update_time timestamp_ntz")
    got = {r["product_id"]: r["product_name"] for r in
           io.latest_by_key(df, ["product_id"], ["last_update_time"]).collect()}
    assert got == {1: "new", 2: "only"}


def test_audits(spark):
    prods = spark.createDataFrame([(1,), (2,)], "product_id bigint")
    sales = spark.createDataFrame([(10, 1), (10, 3), (11, None)], "sale_id bigint, product_id bigint")
    assert [tuple(r) for r in io.audit_pk(sales, ["sale_id"]).collect()] == [(10, 2)]
    fk = io.audit_fk(sales, "product_id", prods, "product_id", "sales").collect()
    assert [(r["value"], r["n"]) for r in fk] == [(3, 1)]
    nn = {r["column_name"]: r["null_count"] for r in io.audit_not_null(sales, ["sale_id", "product_id"]).collect()}
    assert nn == {"sale_id": 0, "product_id": 1}


def test_overrides_and_defaults(spark):
    prods = spark.createDataFrame([(1, "a", Decimal("2.00")), (2, "b", Decimal("3.00"))],
                                  "product_id bigint, product_name string, base_price decimal(10,2)")
    out = {r["product_id"]: (r["product_name"], r["base_price"])
           for r in io.apply_overrides(prods, io.overrides_frame(spark, "retail")).collect()}
    assert out == {1: ("Fresh Red Delicious Apple", Decimal("0.75")), 2: ("b", Decimal("3.00"))}
    d = spark.createDataFrame([(1, None)], "product_id bigint, total_stock bigint")
    assert io.with_defaults(d, {"total_stock": 0}).collect()[0]["total_stock"] == 0


def test_data_dictionary_comments(spark):
    df = io.annotate(spark.createDataFrame([(1,)], "product_id bigint"), {"product_id": "the product"})
    dd = io.data_dictionary(spark, {"items": df}).collect()
    assert dd[0]["comment"] == "the product"


def test_write_serving_is_sorted(spark, scratch):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("product_id"))
    io.write_serving(df, "product_id", f"{scratch}/serving", partitions=4)
    back = spark.read.parquet(f"{scratch}/serving")
    assert back.count() == 1000
    per_file = back.groupBy(F.input_file_name()).agg(F.min("product_id"), F.max("product_id")).collect()
    ranges = sorted((r[1], r[2]) for r in per_file)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_global_position_matches_row_number(spark):
    df = spark.range(0, 5000, 3).select((F.col("id") * 2).alias("k"))
    pos = {r["k"]: r["position"] for r in datagen.global_position(df, ["k"], partitions=7).collect()}
    ks = sorted(pos)
    assert [pos[k] for k in ks] == list(range(1, len(ks) + 1))


def test_downsample_keeps_product_one_and_odd_positions(spark):
    prods = spark.range(0, 10).select(F.col("id").alias("product_id"))
    kept = sorted(r["product_id"] for r in datagen.downsample_products(prods).collect())
    # product 1 forced, then the rest (0,2,3,...,9) at positions 1,3,5,... -> 0,3,5,7,9
    assert kept == [0, 1, 3, 5, 7, 9]


def test_generators_are_reproducible_and_sized(spark):
    p = datagen.gen_products(spark, 100, seed=1)
    assert p.count() == 100
    a = [tuple(r) for r in p.orderBy("product_id").collect()]
    b = [tuple(r) for r in datagen.gen_products(spark, 100, seed=1).repartition(3).orderBy("product_id").collect()]
    assert a == b
    s = datagen.gen_sales(p, rounds=3, per_round=None)
    assert s.count() == 300
    hot = datagen.gen_sales(p, rounds=3, per_round=None, hot_product=7, hot_share=1 / 3)
    counts = {r[0]: r[1] for r in hot.groupBy("product_id").count().collect()}
    assert counts[7] >= 150       # one product holds about a third of all rows
    existing = p.filter("product_id <= 10").withColumn("product_name", F.lit("kept"))
    merged = datagen.gen_products(spark, 20, existing=existing)
    assert merged.filter("product_name = 'kept'").count() == 10 and merged.count() == 20


def test_bucketed_table_join_needs_no_shuffle_and_analyze(spark):
    import uuid
    name = f"bucket_{uuid.uuid4().hex[:8]}"
    df = spark.range(2000).select(F.col("id").alias("product_id"), (F.col("id") % 7).alias("v"))
    io.write_bucketed(df, f"{name}_a", "product_id", 4)
    io.write_bucketed(df, f"{name}_b", "product_id", 4)
    io.analyze(spark, f"{name}_a", ["product_id"])
    stats = spark.sql(f"DESCRIBE EXTENDED {name}_a").filter("col_name = 'Statistics'").collect()
    assert stats and "rows" in stats[0]["data_type"]
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table(f"{name}_a").join(spark.table(f"{name}_b"), "product_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 2000
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql(f"DROP TABLE IF EXISTS {name}_a")
        spark.sql(f"DROP TABLE IF EXISTS {name}_b")


def test_ingest_chunks_stream_appends_each_chunk_once(spark, scratch):
    import os
    os.makedirs(f"{scratch}/in")
    for i in range(3):
        with open(f"{scratch}/in/chunk_{i}.csv", "w") as f:
            f.write("supplier_id,supplier_name\n")
            f.write(f"{i},s{i}\n{i + 10},s{i + 10}\n")
    q = io.ingest_chunks(spark, "suppliers", f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination()
    q2 = io.ingest_chunks(spark, "suppliers", f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt")
    q2.awaitTermination()                      # restart: nothing new, nothing twice
    got = sorted(r["supplier_id"] for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == [0, 1, 2, 10, 11, 12]


def test_view_comments_attached(spark):
    from pricetide.plans.registry import QUERIES
    df = io.describe_view(QUERIES["inventory_item"](spark, "/root/testdata/sf0.001"), "inventory_item")
    assert "live price" in df.schema["live_price"].metadata["comment"].lower() or \
        "price" in df.schema["live_price"].metadata["comment"].lower()


@pytest.mark.parametrize("partitions", [4, 8])
def test_positions_are_exact_at_sf01_whatever_is_pruned(spark, partitions):
    """Positions 1..n with a second column carried; the two uses of the ranges prune different columns."""
    from pricetide.operators.ordering import global_position
    from pricetide.sources.testdata import retail_tables
    products = retail_tables(spark, "/root/testdata/sf0.1").products
    got = global_position(products.select("product_id", "product_name"), ["product_id"], partitions=partitions)
    rows = sorted((r.product_id, r.position) for r in got.collect())
    assert [p for _, p in rows] == list(range(1, len(rows) + 1)) and len(rows) > 19_000


def test_replenish_gives_distinct_ids_to_all_products(spark):
    from pricetide.operators import changes
    from pricetide.sources.testdata import retail_tables
    t = retail_tables(spark, "/root/testdata/sf0.1")
    targets = t.products.select("product_id").selectExpr("product_id", "CAST(product_id % 21 + 5 AS INT) AS stock")
    got = changes.replenish(t.inventory.where("false"), targets, "2024-02-01 00:00:00")
    n, distinct = got.selectExpr("count(*)", "count(DISTINCT inventory_id)").first()
    assert n == distinct > 19_000


def test_positions_of_text_and_of_a_running_sum_with_a_hot_group(spark):
    from pricetide.operators.ordering import global_position, running_sum
    df = spark.createDataFrame([(f"k{i:05d}", i, "all" if i % 10 else None, 2) for i in range(3000)],
                               "k string, v int, g string, w int")
    rows = sorted((r.k, r.position) for r in global_position(df, ["k"], partitions=7).collect())
    assert [p for _, p in rows] == list(range(1, 3001))
    for down in (False, True):
        got = running_sum(df, "v", "w", "s", by=["g"], descending=down, partitions=9).collect()
        for g in ("all", None):
            mine = sorted((r for r in got if r.g == g), key=lambda r: -r.v if down else r.v)
            assert [r.s for r in mine] == [2 * (i + 1) for i in range(len(mine))]
