"""Smaller operators: change rows, id parsing, picks, memory conversion, status flags, plans."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions import factors, rand
from pricetide.operators import changes, metrics


def test_full_image_changes_flatten_and_weights(spark):
    row = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    schema = changes.change_schema(row)
    df = spark.createDataFrame([("I", 1, None, (1, "a")), ("U", 2, (1, "a"), (1, "b")), ("D", 3, (1, "b"), None)],
                               schema)
    flat = [tuple(r) for r in changes.flatten_changes(df).orderBy("seq").collect()]
    assert flat == [("I", 1, 1, "a"), ("U", 2, 1, "b"), ("D", 3, 1, "b")]
    w = sorted(tuple(r) for r in changes.weighted(df).collect())
    assert w == [(-1, 1, "a"), (-1, 1, "b"), (1, 1, "a"), (1, 1, "b")]
    # the weights of a whole history cancel out
    assert changes.apply_changes_bag(spark.createDataFrame([], "k bigint, v string"),
                                     changes.weighted(df)).count() == 0


def test_parse_ids(spark):
    df = spark.createDataFrame([("1, 2,x,,003",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(factors.parse_ids("t")).collect()]
    assert got == [[1, 2, 3], [], []]


def test_money_rounds_half_up(spark):
    got = spark.range(1).select(factors.money(F.lit(Decimal("2.345")))).collect()[0][0]
    assert got == Decimal("2.35")


def test_random_row_and_sample_are_reproducible(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = rand.random_row(df, 7, ["k"]).collect()
    b = rand.random_row(df.repartition(5), 7, ["k"]).collect()
    assert a == b
    assert rand.random_row(df, 7, ["k"], smallest=True).collect()[0]["k"] == 0
    s1 = sorted(r["k"] for r in rand.sample_n(df, 50, 3, ["k"]).collect())
    s2 = sorted(r["k"] for r in rand.sample_n(df.repartition(3), 50, 3, ["k"]).collect())
    assert s1 == s2 and len(set(s1)) == 50


def test_to_gb_and_flags(spark):
    samples = spark.createDataFrame([("source_db", 50.0), ("view_engine", 25.0)], "service string, memory_pct double")
    limits = spark.createDataFrame(list(metrics.MEMORY_LIMIT_GB.items()), "service string, limit_gb double")
    got = {r["service"]: r["memory_gb"] for r in metrics.to_gb(samples, limits).collect()}
    assert got == {"source_db": 2.0, "view_engine": 1.0}
    status = spark.createDataFrame([("a", True, False), ("b", False, True)], "source string, hydrated boolean, failed boolean")
    assert metrics.is_hydrated(status).collect()[0][0] is False
    srcs = spark.createDataFrame([("a",)], "source string")
    assert metrics.any_failed(status, srcs).collect()[0][0] is False
    assert metrics.any_failed(status, status.select("source")).collect()[0][0] is True


def test_newest_and_lag_band(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (3, t), (2, t + dt.timedelta(1))], "id bigint, ts timestamp_ntz")
    assert metrics.newest(df, ["id"]).collect()[0]["id"] == 3
    assert metrics.newest(df, ["ts"]).collect()[0]["id"] == 2
    bands = spark.createDataFrame([(None,), (0.5,), (1.0,), (4.9,), (5.0,)], "s double")
    got = [r[0] for r in bands.select(factors.lag_band("s")).collect()]
    assert got == ["Unknown", "Low", "Medium", "Medium", "High"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_has_no_python_and_partial_limits(spark):
    from pricetide.plans.registry import QUERIES
    plan = _plan(QUERIES["inventory_item"](spark, "/root/testdata/sf0.001"))
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # the top-N per product and the per-category thresholds are cut before the shuffle
    assert plan.count("WindowGroupLimit") >= 4 and "Partial" in plan
    # no window without a partition key except over the bounded top-10 of stock totals
    assert "TakeOrderedAndProject(limit=10" in plan


def test_no_python_udf_anywhere(spark):
    from pricetide.plans.registry import QUERIES
    for key in ("dynamic_cart", "category_totals_closure", "latency_stats", "rolling_qps", "apply_changes",
                "stock_jitter", "downsample_products"):
        plan = _plan(QUERIES[key](spark, "/root/testdata/sf0.001"))
        assert "PythonUDF" not in plan and "EvalPython" not in plan, key


def test_global_order_statistics_and_rank(spark):
    from pricetide.operators import pricing
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 3, 9, 7, 3, 2, 8, 6]], "v double")
    st = metrics.sample_stats(df, [], "v").collect()[0]
    assert st["n"] == 10 and st["max"] == 9.0 and st["p99"] == 9.0
    med = metrics.median_by(df, [], "v").collect()[0]["median"]
    assert med == 4.0
    ranks = sorted((r["v"], r["rank"]) for r in pricing.rank_desc(df, "v").collect())
    by_value = dict(ranks)
    assert by_value[9.0] == 1 and by_value[3.0] == 6 and by_value[1.0] == 10


def test_views_append_and_distinct(spark):
    from pricetide.sources import io
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k bigint, v string")
    b = spark.createDataFrame([(3, "z")], "k bigint, v string")
    io.register_views({"misc_a": io.append(a, b)})
    assert spark.sql("SELECT COUNT(*) FROM misc_a").collect()[0][0] == 4
    assert sorted(r["k"] for r in io.distinct_keys(spark.table("misc_a"), ["k"]).collect()) == [1, 2, 3]
