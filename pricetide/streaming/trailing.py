"""Live rates and statistics of a query log: the trailing window of every reading (W6) and the snapshot per source.

Two streams follow the same log. One counts, for every reading, its source's
readings in the trailing window; a count that later or late rows change is
written again, so the table always equals ``metrics.trailing_count`` of the rows
that have come. The other keeps each source's first and newest readings, from
which the exact statistics of the newest ``cap`` follow: what has left the
newest ``cap`` is gone, so nothing has to be subtracted.

State: a group is a source and a stretch of ``bucket_s`` of event time, so a source
that holds every row is spread over its stretches. It holds the readings (number
and time) of its stretch and of the window before it, and an event-time timer
drops it when the watermark passes its end. Rows later than the watermark are
dropped by Spark and show in the query's progress
(``numRowsDroppedByWatermark``). A reading is known by source and seq: delivered
twice, it counts once, also across restarts, while its stretch is held.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricetide.operators import metrics
from pricetide.schemas import QUERY_LOG
from pricetide.streaming.buckets import LoggedTable
from pricetide.streaming.qps import _as_instant

COUNTS = "source string, seq bigint, n_window bigint"
#: Batches for which a frame that was read stays readable.
READERS = 16
_STATE = "at binary, seq binary, own binary"


def _counter(window: int, bucket: int):
    """Readings of one (source, stretch) and its state -> counts that are new or have changed."""

    def count(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [np.frombuffer(x, k) for x, k in zip(state.get, ("<i8", "<i8", "?"))] if state.exists else \
            [np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0, bool)]
        came = pd.concat(list(frames))[["at", "seq", "own"]].drop_duplicates("seq")
        came = came[~came["seq"].isin(held[1])]
        if len(came):
            fresh = np.sort(came["at"].to_numpy("<i8"))
            at, seq, own = (np.concatenate([a, came[c].to_numpy(a.dtype)]) for a, c in zip(held, ("at", "seq", "own")))
            order = np.argsort(at, kind="stable")
            at, seq, own = at[order], seq[order], own[order]
            n = np.searchsorted(at, at, "right") - np.searchsorted(at, at - window, "left")
            moved = own & (np.searchsorted(fresh, at, "right") > np.searchsorted(fresh, at - window, "left"))
            state.update((at.tobytes(), seq.tobytes(), own.tobytes()))
            yield pd.DataFrame({"source": key[0], "seq": seq[moved], "n_window": n[moved]})
        if state.exists:
            end = (key[1] + 1) * bucket // 1000
            state.setTimeoutTimestamp(int(max(end, state.getCurrentWatermarkMs() + 1)))

    return count


class LiveMetrics:
    """Rates and statistics kept up to date under ``root`` from a log folder (see :data:`schemas.QUERY_LOG`).

    ``bucket_s`` bounds a group's state to a source's readings in that time: take
    less for fast sources, more for sparse ones (fewer groups). ``delay`` is how
    late a row may be. ``buckets`` are those of the stored counts.
    """

    def __init__(self, spark: SparkSession, root: str, *, window_s: float = metrics.QPS_WINDOW_S, bucket_s: float = 60.0,
                 delay: str = "10 seconds", cap: int = metrics.SAMPLE_CAP, buckets: int = 16):
        self.spark, self.root, self.window_s, self.delay, self.cap = spark, root.rstrip("/"), window_s, delay, cap
        self.window, self.bucket = (int(round(s * 1_000_000)) for s in (window_s, bucket_s))
        self.counted = LoggedTable(spark, f"{self.root}/counts", COUNTS, "seq", self._largest, buckets)
        self.kept = LoggedTable(spark, f"{self.root}/newest", QUERY_LOG.toDDL(), "source", self._newest, 1)

    @staticmethod
    def _largest(rows: DataFrame) -> DataFrame:
        """Counts only grow, so the largest written is the newest."""
        return rows.groupBy("source", "seq").agg(F.max("n_window").alias("n_window"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The first reading of each source (the warm-up) and the newest ``cap`` + 1."""
        rows = rows.distinct()
        order = F.struct("ts", "seq")
        first = rows.groupBy("source").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "source"]), order).alias("_f")) \
            .select("source", "_f.*").select(*rows.columns)
        return metrics.last_n(rows, ["source"], ["ts", "seq"], self.cap + 1).select(*rows.columns).unionByName(first).distinct()

    def _log(self, path: str, max_files: int | None) -> DataFrame:
        reader = self.spark.readStream.schema(QUERY_LOG)
        return (reader.option("maxFilesPerTrigger", int(max_files)) if max_files else reader).parquet(path)

    def _into(self, table: LoggedTable, prepare):
        def add(batch: DataFrame, batch_id: int) -> None:
            if not table._parts():
                table.load(self.spark.createDataFrame([], table.schema))
            table.prune(batch_id - READERS)                # versions are batch numbers + 1
            table.append(prepare(batch), batch_id + 1)
            table.compact(batch_id + 1)
        return add

    def start(self, log_path: str, *, max_files_per_trigger: int | None = None,
              available_now: bool = True) -> list[StreamingQuery]:
        """Follow the log: both streams, each with its own checkpoint under ``root``."""
        at = F.unix_micros(_as_instant(F.col("ts")))
        rows = (self._log(log_path, max_files_per_trigger).where("source IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL")
                .select("source", "seq", at.alias("at"), _as_instant(F.col("ts")).alias("et")).withWatermark("et", self.delay))
        mine = F.floor(F.col("at") / self.bucket)
        dealt = (rows.withColumn("stretch", F.explode(F.sequence(mine, F.floor((F.col("at") + self.window) / self.bucket))))
                 .withColumn("own", F.col("stretch") == mine))
        counts = dealt.groupBy("source", "stretch").applyInPandasWithState(
            _counter(self.window, self.bucket), COUNTS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
        newest = self._log(log_path, max_files_per_trigger).where("source IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL")
        out = []
        for name, df, table, prepare in (("counts", counts, self.counted, lambda b: b),
                                         ("newest", newest, self.kept, self._newest)):
            writer = (df.writeStream.outputMode("update").foreachBatch(self._into(table, prepare))
                      .option("checkpointLocation", f"{self.root}/_{name}_ckpt"))
            writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
            out.append(writer.start())
        return out

    def trailing(self) -> DataFrame:
        """source, seq, n_window and qps of every reading so far."""
        return self.counted.now(1 << 31).withColumn("qps", F.col("n_window") / F.lit(float(self.window_s)))

    def newest(self) -> DataFrame:
        """The first and the newest readings of each source, as rows of the log."""
        return self._newest(self.kept.read(1 << 31))

    def snapshot(self, items: DataFrame, refreshes: DataFrame, beats: DataFrame, replica_beats: DataFrame, as_of,
                 **options) -> DataFrame:
        """``metrics.metrics_snapshot`` of all that has come, from the kept readings and counts alone.

        End-to-end times and the price are those of the kept readings whose product is in ``items``."""
        log = self.newest()
        snap = metrics.metrics_snapshot(log, items, refreshes, beats, replica_beats, as_of, window_s=self.window_s,
                                        cap=self.cap, **options)
        # the rate counts more readings than are kept: that of the newest one, without the warm-up
        order = F.struct("ts", "seq")
        ends = log.groupBy("source").agg(F.max_by("seq", order).alias("seq"), F.max("ts").alias("_hi"), F.min("ts").alias("_lo"))
        warm = F.col("_lo") >= F.timestamp_add("MICROSECOND", F.lit(-self.window), F.col("_hi"))
        rate = (ends.join(self.counted.of(ends.select("seq"), 1 << 31), ["source", "seq"])
                .select("source", ((F.col("n_window") - warm.cast("int")) / F.lit(float(self.window_s))).alias("_rate")))
        return (snap.join(rate, "source", "left").withColumn("qps", F.when(F.col("qps").isNotNull(), F.col("_rate")))
                .select(*snap.columns))
