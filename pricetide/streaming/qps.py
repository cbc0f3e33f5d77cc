"""Event-time streams: windowed query rates (M5) and the heartbeat writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetide.schemas import QUERY_LOG
from pricetide.streaming.buckets import BUCKETS, BucketedTable

QPS_SCHEMA = "source string, window_start timestamp_ntz, window_end timestamp_ntz, n bigint, qps double"


def _epoch_ntz() -> F.Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _as_instant(ntz) -> F.Column:
    """TIMESTAMP_NTZ read as UTC -> TIMESTAMP (windows need the latter); no session zone involved."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch_ntz(), ntz))


def _as_ntz(instant) -> F.Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch_ntz())


def windowed_counts(log: DataFrame, window: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Queries per source and tumbling window.

    Without a watermark every row counts however late, and the state keeps one
    number per source and window. With one, the state is bounded by it and rows
    later than that are dropped (``numRowsDroppedByWatermark`` in the progress).
    """
    timed = log.withColumn("_et", _as_instant(F.col("ts")))
    timed = timed.withWatermark("_et", watermark) if watermark else timed
    return (timed.groupBy("source", F.window("_et", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("source", _as_ntz(F.col("w.start")).alias("window_start"),
                    _as_ntz(F.col("w.end")).alias("window_end"), "n"))


def rates(spark: SparkSession, root: str, buckets: int = BUCKETS) -> BucketedTable:
    """The table that :func:`stream_qps` maintains; windows are bucketed by their start."""
    return BucketedTable(spark, f"{root}/rates", QPS_SCHEMA, "window_start", buckets)


def read_qps(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    return rates(spark, root, buckets).read(1 << 31)


def stream_qps(spark: SparkSession, log_path: str, root: str, *, window: str = "1 minute",
               window_seconds: float = 60.0, watermark: str | None = None, buckets: int = BUCKETS,
               max_files_per_trigger: int | None = None, trigger: str = "availableNow") -> StreamingQuery:
    """Windowed counts in *update* mode: a batch replaces the rows of the windows it changed."""
    reader = spark.readStream.schema(QUERY_LOG)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    counts = windowed_counts(reader.parquet(log_path), window, watermark)
    table = rates(spark, root, buckets)

    def replace(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("qps", F.col("n") / F.lit(float(window_seconds))).persist()
        table.prune(batch_id - 1)
        touched = table.touched(fresh)
        if touched:
            old = table.read(batch_id - 1, touched).join(fresh, ["source", "window_start"], "left_anti")
            table.write(old.unionByName(fresh.select(*old.columns)), batch_id, touched)
        fresh.unpersist()

    w = (counts.writeStream.outputMode("update").foreachBatch(replace)
         .option("checkpointLocation", f"{root.rstrip('/')}/_qps_ckpt"))
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime="1 second")
    return w.start()


def heartbeat_stream(spark: SparkSession, path: str, checkpoint: str, *, rows_per_second: int = 1,
                     interval: str = "1 second") -> StreamingQuery:
    """Write one heartbeat (id, ts) per tick to parquet — the source side of the lag metric."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    hb = ticks.select(F.col("value").alias("id"), F.col("timestamp").cast("timestamp_ntz").alias("ts"))
    return (hb.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(processingTime=interval).start())
