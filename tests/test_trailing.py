"""Live rates and statistics against the batch operators over the rows that have come."""

import datetime as dt
import random

from pricetide import schemas
from pricetide.operators import metrics
from pricetide.streaming.trailing import LiveMetrics

T0 = dt.datetime(2024, 1, 1)


def _log(n, seed):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(milliseconds=rng.choice((0, 250, 1000)) + 137 * i), "a" if i % 3 else "b",
             float(rng.randint(1, 90)), i % 7) for i in range(n)]


def _come(spark, root, rows, views, schema=schemas.QUERY_LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/log")
    streams = views.start(f"{root}/log")
    for s in streams:
        s.awaitTermination()
    return streams


def test_counts_and_newest_equal_the_batch_after_each_part(spark, scratch):
    rows, rng = _log(400, 1), random.Random(2)
    views = LiveMetrics(spark, f"{scratch}/out", window_s=1.0, bucket_s=5.0, delay="30 seconds", cap=20, buckets=2)
    order = sorted(rows, key=lambda r: r[0] + rng.random() * 60)              # late by up to eight seconds
    for lo in range(0, 400, 100):
        _come(spark, scratch, order[lo:lo + 100] + order[:lo][-10:], views)   # some rows are delivered twice
        log = spark.createDataFrame(order[:lo + 100], schemas.QUERY_LOG)
        want = {(r.source, r.seq): (r.n_window, r.qps) for r in metrics.rolling_qps(log).collect()}
        got = views.trailing().collect()
        assert {(r.source, r.seq): (r.n_window, r.qps) for r in got} == want and len(got) == len(want)
        base = metrics.last_n(metrics.skip_warmup(views.newest()), ["source"], ["ts", "seq"], 20)
        whole = metrics.last_n(metrics.skip_warmup(log), ["source"], ["ts", "seq"], 20)
        assert sorted(map(tuple, base.collect())) == sorted(map(tuple, whole.collect()))
        assert views.newest().count() <= 2 * 22


def test_state_stays_bounded_and_late_rows_are_reported(spark, scratch):
    views = LiveMetrics(spark, f"{scratch}/out", window_s=1.0, bucket_s=5.0, delay="10 seconds", buckets=2)
    held, dropped = [], 0
    for hour in range(4):
        rows = [(1000 * hour + i, T0 + dt.timedelta(hours=hour, milliseconds=400 * i), "a", 1.0, 1) for i in range(100)]
        counts = _come(spark, scratch, rows, views)[0]
        held.append(counts.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(held[1:]) <= held[0] + 3                                         # stretches before the watermark are gone
    counts = _come(spark, scratch, [(9999, T0, "a", 1.0, 1)], views)[0]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in counts.recentProgress for op in p["stateOperators"])
    assert dropped == 1 and views.trailing().count() == 400


def test_rows_without_key_and_empty_parts(spark, scratch):
    views = LiveMetrics(spark, f"{scratch}/out", delay="1 hour", buckets=1)
    loose = schemas.T.StructType([schemas.T.StructField(f.name, f.dataType, True) for f in schemas.QUERY_LOG])
    _come(spark, scratch, [], views, loose)
    _come(spark, scratch, [(1, T0, "a", None, None), (None, T0, "a", 1.0, 1), (2, None, "a", 1.0, 1), (3, T0, None, 1.0, 1),
                           (4, T0, "a", 2.0, 1)], views, loose)
    assert sorted((r.seq, r.n_window) for r in views.trailing().collect()) == [(1, 2), (4, 2)]
    assert sorted(r.seq for r in views.newest().collect()) == [1, 4]
