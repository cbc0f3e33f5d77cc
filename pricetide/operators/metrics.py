"""Freshness, lag, throughput and latency metrics over query / heartbeat / refresh logs.

Scale rules used throughout:

* order statistics (p99, median) come from a per-group *value histogram* with
  cumulative counts, never from sorting a group's rows in one task;
* time windows are evaluated per (group, time bucket) with the previous
  bucket's rows as read-only neighbours, so a hot source costs one bucket of
  rows per task, not its whole history;
* "carry the last value forward" is a two-level scan: last value per range of
  time (ranges of about equally many rows), carried across ranges, then inside
  each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import factors as fx
from pricetide.operators.ordering import range_bounds, range_of, running_sum

EPOCH = "1970-01-01 00:00:00"
# Fixed values of the reference's metrics: QPS window 1 s, history 3 min,
# sample cap 100 per source, stale after 2 s (10 s for resource samples),
# p99 only from 100 samples on (else the max).
QPS_WINDOW_S = 1.0
HISTORY = "3 minutes"
SAMPLE_CAP = 100
STALE_S = 2.0
STALE_RESOURCE_S = 10.0
P99_MIN_SAMPLES = 100


def micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (no time zone involved)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


# --------------------------------------------------------------------------- order statistics

def histogram(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group, the distinct non-NULL values with their count ``_c`` and the running count ``_cum``.

    The running count is taken over ranges of values, so a group that holds
    every row, all of them distinct, is still spread over all tasks.
    """
    by = list(by)
    hist = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count(F.lit(1)).alias("_c")))
    return running_sum(hist, value, "_c", "_cum", by=by)


def _at_ranks(cum: DataFrame, by: Sequence[str], value: str, ranks: dict, *more: Column) -> DataFrame:
    """Per group: n, ``more`` aggregates of a :func:`histogram`, and the values at the 1-based ranks ``f(n)``.

    Which values stand at the ranks is decided on (group, n) joined back to the
    histogram: two aggregates of it, both partial before their shuffle.
    """
    by = list(by)
    totals = cum.groupBy(*by).agg(F.max("_cum").alias("n"), *more)
    names = [F.col(c).alias(f"_by_{c}") for c in by]
    sized = cum.select(value, "_c", "_cum", *names)
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        sized = sized.join(totals.select(*by, "n"), same)
    else:
        sized = sized.crossJoin(F.broadcast(totals.select("n")))       # one row
    found = []
    for name, f in ranks.items():
        r = f(F.col("n"))
        hit = (F.col("_cum") - F.col("_c") < r) & (F.col("_cum") >= r)
        found.append(F.max(F.when(hit, F.col(value))).alias(name))
    picked = sized.groupBy(*[f"_by_{c}" for c in by]).agg(*found)
    if not by:
        return totals.crossJoin(F.broadcast(picked))                   # one row each
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return totals.join(picked, same).drop(*[f"_by_{c}" for c in by])


def values_at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict) -> DataFrame:
    """Per group: n and, for each ``name -> f(n)``, the value at 1-based ascending rank f(n)."""
    return _at_ranks(histogram(df, by, value), by, value, ranks)


def p99_rank(n: Column) -> Column:
    """1-based rank of the reference's p99: sorted[floor(0.99 n)] (0-based), in exact integer arithmetic."""
    return F.floor(n * 99 / 100).cast("bigint") + 1


def sample_stats(df: DataFrame, by: Sequence[str], value: str, *, decimals: int | None = None,
                 prefix: str = "") -> DataFrame:
    """n, max, mean and p99 per group; p99 is the max below 100 samples.

    ``decimals`` sums the values as exact decimals of that scale before the one
    division of the mean (the values must carry no more digits). All four come
    from one histogram; a group without any non-NULL value has no row.
    """
    v = F.col(value)
    exact = v.cast(f"decimal(28,{decimals})") if decimals is not None else v
    total = F.sum((exact * F.col("_c")).cast(f"decimal(38,{decimals})") if decimals is not None else exact * F.col("_c"))
    stats = _at_ranks(histogram(df, by, value), by, value, {"_p99": p99_rank},
                      F.max(v).alias(f"{prefix}max"), (total.cast("double") / F.sum("_c")).alias(f"{prefix}mean"))
    return stats.select(*by, "n", f"{prefix}max", f"{prefix}mean",
                        F.when(F.col("n") >= P99_MIN_SAMPLES, F.col("_p99"))
                        .otherwise(F.col(f"{prefix}max")).alias(f"{prefix}p99"))


def median_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median per group: the middle value, or the mean of the two middles."""
    m = values_at_ranks(df, by, value, {
        "_lo": lambda n: F.floor((n + 1) / 2).cast("bigint"),
        "_hi": lambda n: F.floor(n / 2).cast("bigint") + 1,
    })
    return m.select(*by, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = SAMPLE_CAP) -> DataFrame:
    """Newest ``n`` rows per group (planned as a partial WindowGroupLimit before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latency_stats(log: DataFrame, *, cap: int | None = None, decimals: int | None = None) -> DataFrame:
    """max / mean / p99 of latency_ms per source, over all rows or the newest ``cap``."""
    src = last_n(log, ["source"], ["ts", "seq"], cap) if cap else log
    return sample_stats(src, ["source"], "latency_ms", decimals=decimals, prefix="latency_").withColumnRenamed(
        "latency_max", "max_ms").withColumnRenamed("latency_mean", "mean_ms").withColumnRenamed(
        "latency_p99", "p99_ms")


# --------------------------------------------------------------------------- time windows

def trailing_count(df: DataFrame, by: Sequence[str], ts: str, window_s: float = QPS_WINDOW_S,
                   out: str = "n_window") -> DataFrame:
    """Rows of the same group with ts in [t - window, t] (ties included) for every row.

    Evaluated per (group, window-sized bucket) with the previous bucket's rows
    added as neighbours that are counted but not emitted.
    """
    by = list(by)
    wl = int(round(window_s * 1_000_000))
    cols = df.columns
    t = df.withColumn("_m", micros(ts)).withColumn("_b", F.floor(F.col("_m") / wl))
    real = t.withColumn("_real", F.lit(True))
    ghost = (t.select(*by, "_m", (F.col("_b") + 1).alias("_b"))
             .withColumn("_real", F.lit(False)))
    both = real.unionByName(ghost, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_b").orderBy("_m").rangeBetween(-wl, 0)
    return (both.withColumn(out, F.count(F.lit(1)).over(w))
            .filter(F.col("_real")).select(*cols, out))


def rolling_qps(log: DataFrame, window_s: float = QPS_WINDOW_S) -> DataFrame:
    """Per query: queries of its source in the trailing window / window length."""
    c = trailing_count(log, ["source"], "ts", window_s, "n_window")
    return c.withColumn("qps", F.col("n_window") / F.lit(float(window_s)))


def history_window(df: DataFrame, ts: str = "ts", span: str = HISTORY) -> DataFrame:
    """Rows within ``span`` of the newest row."""
    newest = df.agg(F.max(ts).alias("_newest"))            # one row
    return (df.crossJoin(F.broadcast(newest))
            .filter(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {span}"))
            .drop("_newest"))


def _ranged(df: DataFrame, order: str, partitions: int | None) -> DataFrame:
    """``_m``: the order in microseconds; ``_b``: its range, about equally many rows each whatever the rate."""
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.withColumn("_m", micros(order))
    return t.withColumn("_b", range_of("_m", range_bounds(t.select("_m"), "_m", n)))


def _last_before(t: DataFrame, by: Sequence[str], key: Column, value: Column) -> DataFrame:
    """Per (group, range): the last non-NULL ``value`` of all earlier ranges of the group, as ``_carry``."""
    last = t.groupBy(*by, "_b").agg(F.max(F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v")))).alias("_v"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return last.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_b").alias("_at"),
                       F.last("_v.v", ignorenulls=True).over(before).alias("_carry"))


def _with_carry(t: DataFrame, by: Sequence[str], carry: DataFrame) -> DataFrame:
    same = F.col("_b") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return t.join(carry, same)


def carry_forward(df: DataFrame, by: Sequence[str], order: str, value: str, out: str,
                  tie: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``last(value) IGNORE NULLS`` up to each row, per group, in (order, tie) order."""
    by, tie = list(by), list(tie)
    t = _ranged(df, order, partitions)
    carry = _last_before(t, by, F.struct("_m", *tie), F.col(value))
    wi = (Window.partitionBy(*by, "_b").orderBy("_m", *tie)
          .rowsBetween(Window.unboundedPreceding, 0))
    return (_with_carry(t, by, carry)
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(wi), F.col("_carry")))
            .select(*df.columns, out))


def previous_value(df: DataFrame, by: Sequence[str], order: str, value: str, out: str,
                   tie: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``lag(value)`` per group in (order, tie) order, evaluated range by range."""
    by, tie = list(by), list(tie)
    t = _ranged(df, order, partitions)
    carry = _last_before(t, by, F.struct("_m", *tie), F.struct(F.col(value).alias("x")))   # a NULL value counts as well
    wi = Window.partitionBy(*by, "_b").orderBy("_m", *tie)
    return (_with_carry(t, by, carry)
            .withColumn("_rn", F.row_number().over(wi))
            .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry.x")).otherwise(F.lag(value).over(wi)))
            .select(*df.columns, out))


def price_changed(df: DataFrame, by: Sequence[str] = ("source",), order: str = "ts", value: str = "price",
                  tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Flag rows whose value differs from the previous row's (NULL-safe; the first row counts as a change)."""
    p = previous_value(df, by, order, value, "_prev", tie)
    return p.withColumn("changed", ~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev")


def held_qps(df: DataFrame, by: Sequence[str] = ("source",), order: str = "ts", value: str = "qps",
             tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the last non-zero QPS while a reading is 0 (0 until the first non-zero)."""
    nz = df.withColumn("_nz", F.when(F.col(value) > 0, F.col(value)))
    c = carry_forward(nz, by, order, "_nz", "held_qps", tie)
    return c.withColumn("held_qps", F.coalesce("held_qps", F.col(value))).drop("_nz")


def skip_warmup(log: DataFrame, by: Sequence[str] = ("source",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Drop the first measurement of each source (min by a total order, via an aggregate)."""
    by, order = list(by), list(order)
    first = log.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"))
    return (log.join(first, by)
            .filter(F.struct(*order) != F.col("_first")).drop("_first"))


# --------------------------------------------------------------------------- freshness and lag

def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def refresh_age(log: DataFrame, as_of, view_name: str | None = None) -> DataFrame:
    """Seconds since the last refresh and the last refresh's duration, per view.

    ``age_s`` counts from the end of the refresh (as the reference does);
    ``data_age_s`` adds the duration, i.e. the age of the data itself.
    """
    src = log.filter(F.col("view_name") == view_name) if view_name else log
    latest = src.groupBy("view_name").agg(F.max(F.struct("last_refresh", "refresh_duration")).alias("_l"))
    age = fx.seconds_between(_ts(as_of), F.col("_l.last_refresh"))
    return latest.select("view_name", age.alias("age_s"),
                         F.col("_l.refresh_duration").alias("refresh_duration"),
                         (age + F.col("_l.refresh_duration")).alias("data_age_s"))


def newest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the newest by ``order`` (max over a struct: a global partial aggregate)."""
    packed = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.agg(F.max(packed).alias("_n")).select(*[F.col(f"_n.{c}").alias(c) for c in df.columns])


def heartbeat_lag(source: DataFrame, replica: DataFrame, as_of) -> DataFrame:
    """Replication lag from heartbeats: 0 when the replica has the newest id, else
    (src.ts - rep.ts) + (as_of - src.ts) floored at 0 (= as_of - rep.ts)."""
    s = newest(source, ["id"]).select(F.col("id").alias("source_id"), F.col("ts").alias("source_ts"))
    r = newest(replica, ["ts"]).select(F.col("id").alias("replica_id"), F.col("ts").alias("replica_ts"))
    lag = (fx.seconds_between("source_ts", "replica_ts") + fx.seconds_between(_ts(as_of), "source_ts"))
    return s.crossJoin(r).select(
        "source_id", "replica_id", "source_ts", "replica_ts",
        F.when(F.col("source_id") > F.col("replica_id"), F.greatest(F.lit(0.0), lag))
        .otherwise(F.lit(0.0)).alias("lag_s"))


def reaction_time(log: DataFrame, items: DataFrame) -> DataFrame:
    """End-to-end ms: read time minus the product's last_update_time."""
    return (log.join(items.select("product_id", "last_update_time"), "product_id")
            .select("seq", "source", "ts", "product_id",
                    fx.millis_between("ts", "last_update_time").alias("end_to_end_ms")))


def gate_stale(df: DataFrame, as_of, last_col: str, value_cols: Sequence[str],
               limit_s: float = STALE_S) -> DataFrame:
    """Metrics become NULL when the reading is older than ``limit_s``."""
    fresh = fx.seconds_between(_ts(as_of), F.col(last_col)) <= F.lit(limit_s)
    return df.select(*[F.when(fresh, F.col(c)).alias(c) if c in value_cols else F.col(c) for c in df.columns])


def extrapolate_age(df: DataFrame, as_of, age_col: str, last_age_col: str, last_ts_col: str,
                    out: str = "age_ms") -> DataFrame:
    """Age shown when no new reading: the last age plus the time since it was taken (ms)."""
    return df.withColumn(out, F.coalesce(F.col(age_col),
                                         F.col(last_age_col) + fx.millis_between(_ts(as_of), F.col(last_ts_col))))


def with_lag_band(df: DataFrame, lag_col: str, out: str = "lag_band") -> DataFrame:
    return df.withColumn(out, fx.lag_band(lag_col))


# Memory limit per service in GB used to turn percentages into GB.
MEMORY_LIMIT_GB = {"source_db": 4.0, "view_engine": 4.0}


def to_gb(samples: DataFrame, limits: DataFrame, pct_col: str = "memory_pct", by: str = "service") -> DataFrame:
    """Percent of the service's memory limit -> GB (limits: (service, limit_gb), one row per service)."""
    return (samples.join(limits, by, "left")
            .withColumn("memory_gb", F.col(pct_col) / 100.0 * F.col("limit_gb")).drop("limit_gb"))


def resource_stats(samples: DataFrame, by: str = "service", measures: Sequence[str] = ("cpu_pct", "memory_pct"),
                   order: Sequence[str] = ("ts",), decimals: int | None = None, as_of=None,
                   limit_s: float = STALE_RESOURCE_S) -> DataFrame:
    """Per service and measure: last reading, max, mean, p99.

    With ``as_of``, they are NULL for a service whose newest sample (``last_ts``) is older than ``limit_s``.
    """
    out = samples.groupBy(by).agg(*[F.max_by(F.col(m), F.struct(*order)).alias(f"{m}_last") for m in measures],
                                  F.max(order[0]).alias("last_ts"))
    for m in measures:
        out = out.join(sample_stats(samples, [by], m, decimals=decimals, prefix=f"{m}_").drop("n"), by, "left")
    if as_of is None:
        return out.drop("last_ts")
    return gate_stale(out, as_of, "last_ts", [c for c in out.columns if c not in (by, "last_ts")], limit_s)


def is_hydrated(status: DataFrame, flag: str = "hydrated") -> DataFrame:
    """One row: every status row true (FALSE on any false, NULL on an empty table)."""
    return status.agg(F.bool_and(F.col(flag)).alias("hydrated"))


def any_failed(status: DataFrame, sources: DataFrame, key: str = "source", flag: str = "failed") -> DataFrame:
    """One row: whether any of ``sources`` has a failed status row."""
    hit = status.filter(F.col(flag)).join(sources.select(key), key, "left_semi")
    return hit.agg((F.count(F.lit(1)) > 0).alias("any_failed"))


def metrics_snapshot(log: DataFrame, items: DataFrame, refreshes: DataFrame, beats: DataFrame, replica_beats: DataFrame,
                     as_of, *, batch_source: str, live_source: str, window_s: float = QPS_WINDOW_S,
                     limit_s: float = STALE_S, cap: int = SAMPLE_CAP, decimals: int | None = None) -> DataFrame:
    """One row per source: last reading, statistics of its newest readings, and how fresh its data is.

    A source's first measurement is skipped. Latencies count while they are in
    the trailing window of its newest reading, at most the newest ``cap``;
    end-to-end times are the newest ``cap``. The batch source also has the age,
    duration and duration statistics of its refreshes (``refreshes``: view_name
    = source, last_refresh, refresh_duration), the live source the replication
    lag. Everything but ``last_ts`` is NULL for a source whose newest reading is
    older than ``limit_s``.
    """
    base = skip_warmup(log)
    order = F.struct("ts", "seq")
    last = (base.groupBy("source").agg(F.max_by(F.struct("ts", "latency_ms"), order).alias("_l"))
            .select("source", F.col("_l.ts").alias("last_ts"), F.col("_l.latency_ms").alias("latency_ms")))
    in_window = F.col("ts") >= F.timestamp_add("MICROSECOND", F.lit(-int(window_s * 1_000_000)), F.col("last_ts"))
    recent = last_n(base, ["source"], ["ts", "seq"], cap).join(last.select("source", "last_ts"), "source").where(in_window)
    lat = sample_stats(recent, ["source"], "latency_ms", decimals=decimals).select(
        "source", "n", F.col("max").alias("max_ms"), F.col("mean").alias("mean_ms"), F.col("p99").alias("p99_ms"))
    qps = (base.join(last.select("source", "last_ts"), "source").where(in_window)
           .groupBy("source").agg((F.count(F.lit(1)) / F.lit(float(window_s))).alias("qps")))
    reads = reaction_time(base, items)
    now = reads.groupBy("source").agg(F.max_by("end_to_end_ms", order).alias("end_to_end_ms"))
    # end-to-end values are whole microseconds / 1000: exact at 3 decimals
    e2e = sample_stats(last_n(reads, ["source"], ["ts", "seq"], cap), ["source"], "end_to_end_ms", prefix="e2e_",
                       decimals=None if decimals is None else 3).drop("n")
    price = (base.join(items.where("live_price IS NOT NULL").select("product_id", "live_price"), "product_id")
             .groupBy("source").agg(F.max_by("live_price", order).alias("price")))
    mine = refreshes.where(F.col("view_name") == batch_source)
    age = refresh_age(mine, as_of).select(F.col("view_name").alias("source"), F.col("age_s").alias("refresh_age_s"),
                                          "refresh_duration")
    runs = sample_stats(mine, ["view_name"], "refresh_duration", decimals=decimals and decimals + 3, prefix="refresh_") \
        .drop("n").withColumnRenamed("view_name", "source")
    lag = heartbeat_lag(beats, replica_beats, as_of).select(F.lit(live_source).alias("source"), "lag_s")
    snap = last.join(lat, "source")
    for part in (qps, now, e2e, price, age, runs, lag):
        snap = snap.join(part, "source", "left")
    return gate_stale(snap, as_of, "last_ts", [c for c in snap.columns if c not in ("source", "last_ts")], limit_s)


def compare_sources(view: DataFrame, batch: DataFrame, live: DataFrame, key: str = "product_id",
                    price: str = "live_price") -> DataFrame:
    """Prices of the three paths side by side (full outer join) and their differences to the view."""
    v = view.select(key, F.col(price).alias("view_price"))
    b = batch.select(key, F.col(price).alias("batch_price"))
    lv = live.select(key, F.col(price).alias("live_price"))
    j = v.join(b, key, "full").join(lv, key, "full")
    return j.select(key, "view_price", "batch_price", "live_price",
                    (F.col("batch_price") - F.col("view_price")).alias("batch_diff"),
                    (F.col("live_price") - F.col("view_price")).alias("live_diff"))


def readings_at(moments: DataFrame, log: DataFrame, sources: Sequence[str], *, value: str = "latency_ms", ts: str = "ts",
                source: str = "source", tie: Sequence[str] = ("seq",), partitions: int | None = None) -> DataFrame:
    """Every moment (all columns, time ``ts``) with the newest reading of each source at or before it.

    Adds ``<source>_<value>`` and ``<source>_age_s`` for each of ``sources`` (null
    before a source's first reading; a reading without a time counts nowhere). One pass over moments and readings in
    the order of time, cut into ranges of about equally many rows: what each
    range begins with is carried from the ranges before it, one row a range, so
    there is no join on an inequality and a frequent source is spread like any other.
    """
    kept = F.struct(*moments.columns)
    reading = F.struct(F.col(value).alias("v"), F.col(ts).alias("at"))
    rows = (log.where(F.col(source).isin(list(sources)) & F.col(ts).isNotNull()).select(
                F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), F.struct(*tie).alias("_tie"), F.col(source).alias("_source"),
                reading.alias("_reading"), F.lit(None).cast(moments.select(kept.alias("m")).schema["m"].dataType).alias("_moment"))
            .unionByName(moments.select(F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), kept.alias("_moment")), allowMissingColumns=True))
    t = _ranged(rows, "_ts", partitions)
    inside = Window.partitionBy("_b").orderBy("_m", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found, names = [], {}
    for i, name in enumerate(sources):
        own = F.when(F.col("_source") == name, F.col("_reading"))
        carry = _last_before(t, [], F.struct("_m", "_kind", "_tie"), own).select(F.col("_at").alias(f"_at{i}"), F.col("_carry").alias(f"_carry{i}"))
        found.append((carry, f"_b = _at{i}"))
        names[name] = F.coalesce(F.last(own, ignorenulls=True).over(inside), F.col(f"_carry{i}"))
    for carry, same in found:
        t = t.join(F.broadcast(carry), F.expr(same))                      # one row per range
    out = t.withColumns({f"_of_{n}": c for n, c in names.items()}).where("_kind = 1")
    more = []
    for n in sources:
        more += [F.col(f"_of_{n}.v").alias(f"{n}_{value}"), fx.seconds_between(F.col("_ts"), F.col(f"_of_{n}.at")).alias(f"{n}_age_s")]
    return out.select("_moment.*", *more)


def compare_latency(moments: DataFrame, log: DataFrame, view: str, batch: str, live: str, **options) -> DataFrame:
    """Latency of the three paths at the same moments (all columns of ``moments``), and their differences to the view."""
    at = readings_at(moments, log, [view, batch, live], value="latency_ms", **options)
    named = at.withColumnsRenamed({f"{s}_{c}": f"{role}_{c}" for role, s in (("view", view), ("batch", batch), ("live", live))
                                   for c in ("latency_ms", "age_s")})
    return (named.withColumn("batch_diff_ms", F.col("batch_latency_ms") - F.col("view_latency_ms"))
            .withColumn("live_diff_ms", F.col("live_latency_ms") - F.col("view_latency_ms")))
