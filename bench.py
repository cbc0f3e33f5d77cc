"""Headline queries at one scale: prints ONE JSON line with per-query seconds.

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver). A warm-up run of the flagship
query is not counted.

Besides the per-query seconds, ``stream_batch_lag_sec`` is the median
micro-batch duration of the maintained-view stream (the micro-batch lag).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_SHUFFLE_PARTITIONS
(default = BENCH_CPUS; AQE coalesces further),
BENCH_QUERIES (comma list to restrict), BENCH_REPEAT (default 1; best of N).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "inventory_item",          # D1 live price per product
    "item_factors",            # every factor of D1
    "dynamic_cart",            # D4 live cart with stock
    "category_totals",         # D5 roll-up
    "category_totals_closure", # D5, the roll-up as a second key
    "cart_snapshot",           # D6 cart page records
    "high_demand",             # A5/A6
    "popularity_score",        # W1 exact rank via histogram
    "latency_stats",           # M4
    "rolling_qps",             # M5/W6
    "price_carry_forward",     # W9
    "apply_changes",           # M1
    "apply_changes_bag",       # M1 keyless
    "downsample_sales",        # S18-S21
    "refresh_inventory_item",  # D2 refresh (write + log)
    "stream_inventory_item",   # D3 change feed -> maintained view (4 micro-batches)
]


def stream_batch_lag() -> float | None:
    """Median duration of the stream's micro-batches after the first (the first builds the aggregates)."""
    from pricetide.plans.registry import LAST_STREAM_PROGRESS
    runs = [p["durationMs"].get("triggerExecution", 0) / 1000.0 for p in LAST_STREAM_PROGRESS
            if p.get("numInputRows", 0) > 0]
    steady = sorted(runs[1:]) or sorted(runs)
    return round(steady[len(steady) // 2], 3) if steady else None


def main() -> None:
    from pricetide.plans.registry import QUERIES
    from pricetide.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = [q for q in (wanted.split(",") if wanted else HEADLINE) if q in QUERIES]

    spark = build_session(master=f"local[{cpus}]",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("inventory_item")  # warm-up: JVM, code generation, file listing
    times, errors = {}, {}
    for name in names:
        try:
            times[name] = round(min(run(name) for _ in range(repeat)), 3)
        except Exception as e:  # keep measuring the others; report the failure
            times[name] = None
            errors[name] = repr(e)[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": sf}
    lag = stream_batch_lag()
    if lag is not None:
        out["stream_batch_lag_sec"] = lag
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
