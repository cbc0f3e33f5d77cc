"""Spark session helpers.

Library code never creates its own session; it takes the caller's. These
helpers exist for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "pricetide") -> SparkSession:
    """A session tuned for this library: AQE on, UTC, UI off."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


SCRATCH_KEY = "pricetide.scratch.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is used as is. Only
    when it is unset a folder is taken: the context's checkpoint folder if one
    was set, else, with a local master (tests, single-machine runs), a fresh
    scratch folder. Any other master without a shared folder is an error: what
    one machine writes to its own disk the others cannot read. The core
    setting cannot change at run time, so the choice is kept under our own key.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH_KEY, None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError(
                    f"spark.checkpoint.dir must name a shared folder on master {sc.master}")
            path = tempfile.mkdtemp(prefix="pricetide-ckpt-", dir="/tmp")
            sc.setCheckpointDir(path)
        spark.conf.set(SCRATCH_KEY, path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read as often as needed, without its lineage."""
    path = scratch_path(df.sparkSession, f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads (0 if it reads none)."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
