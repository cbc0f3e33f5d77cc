"""Property tests: the threshold form of the RANK bands equals the RANK form on random multisets."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pricetide.functions import factors as fx
from pricetide.operators import pricing

groups = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12)), min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(groups)
def test_threshold_bands_equal_rank_bands(spark, rows):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id bigint, g bigint, v bigint")
    ks = [k for k, _ in fx.POPULARITY_BANDS]
    th = pricing.kth_largest(df, "v", ks, ["g"])
    by_threshold = (df.join(th, "g").select(
        "id", fx.band_by_threshold("v", [f"t{k}" for k in ks], [f for _, f in fx.POPULARITY_BANDS],
                                   fx.POPULARITY_OTHERWISE).alias("b")))
    by_rank = pricing.rank_desc(df, "v", ["g"], "r").select("id", fx.popularity_factor("r").alias("b"))
    got = {r["id"]: r["b"] for r in by_threshold.collect()}
    expect = {r["id"]: r["b"] for r in by_rank.collect()}
    assert got == expect


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30))
def test_global_rank_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v bigint")
    got = {r["id"]: r["r"] for r in pricing.rank_desc(df, "v", rank_col="r").collect()}
    for i, v in enumerate(values):
        assert got[i] == 1 + sum(1 for w in values if w > v)
