"""Tables that a stream maintains: Parquet folders partitioned by bucket and version.

A row belongs to a bucket by a hash of its key. A micro-batch reads and writes
only the buckets that it touches, each as a new version; a reader takes the
newest version of every bucket up to the one it asks for. A batch that runs
again finds the versions before its own and overwrites its own, so the result
is the same. Older versions go when a later batch begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.session import written

#: Buckets of a table; choose them so that a bucket's rows fit a task (the number is part of the layout).
BUCKETS = 16


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds.fields])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of ``rows``: at most ``buckets`` numbers."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def _versions(self) -> dict[int, list[int]]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.path}/bucket=*/v=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        out: dict[int, list[int]] = {}
        for status in found:
            b, v = re.search(r"bucket=(\d+)/v=(\d+)$", status.getPath().toString()).groups()
            out.setdefault(int(b), []).append(int(v))
        return out

    def read(self, upto: int, only: Iterable[int] | None = None) -> DataFrame:
        """The rows as of version ``upto``, of all buckets or of those named."""
        wanted = None if only is None else set(only)
        paths = []
        for b, versions in self._versions().items():
            old = [v for v in versions if v <= upto]
            if old and (wanted is None or b in wanted):
                paths.append(f"{self.path}/bucket={b}/v={max(old)}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col(self.key).isNotNull())

    def write(self, rows: DataFrame, version: int, touched: Iterable[int]) -> None:
        """Write ``rows``, the whole content of the buckets ``touched``, as a version of them."""
        kinds = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        # a row without a key in each touched bucket: one that has become empty has a version too
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*kinds, "bucket")
        full = rows.select(*self.schema.fieldNames(), self.bucket().alias("bucket")).unionByName(marks)
        (full.withColumn("v", F.lit(version)).repartition(self.buckets, "bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v")
         .parquet(self.path))

    def prune(self, upto: int) -> None:
        """Remove versions that no reader of ``upto`` or later needs."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for b, versions in self._versions().items():
            old = sorted(v for v in versions if v <= upto)
            for v in old[:-1]:
                path = jvm.Path(f"{self.path}/bucket={b}/v={v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class LoggedTable:
    """A table kept as a content per bucket and the rows appended to it since: a batch writes only what it adds.

    ``add_up`` turns the rows of a key, from the content and from appended rows
    in any order, into what the table holds now. Bucket folders hold
    ``kind=full`` (the whole content as of a version) and ``kind=more`` (rows
    that a version appended). A bucket with many appended parts is compacted:
    its content is written anew, as of a version, beside the old one. Nothing
    is changed in place, so a reader of an older version goes on reading it until
    :meth:`prune` is told that no one needs it. A batch that runs again
    overwrites its own parts.
    """

    #: Bytes of content that a bucket should hold, and appended parts after which it is compacted.
    BUCKET_BYTES, PARTS = 64 << 20, 8

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str,
                 add_up: Callable[[DataFrame], DataFrame], buckets: int | None = None):
        self.spark, self.path, self.key, self.add_up = spark, path, key, add_up
        kinds = T.StructType.fromDDL(schema)
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds.fields])
        self._buckets = buckets

    @property
    def buckets(self) -> int:
        """Number of buckets: part of the layout, so it is read from the folders once the table is there."""
        if self._buckets is None:
            self._buckets = len({b for b, _, _ in self._parts()})
        return self._buckets

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int")

    def _parts(self) -> list[tuple[int, int, str]]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.path}/bucket=*/v=*/kind=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        out = []
        for status in found:
            b, v, kind = re.search(r"bucket=(\d+)/v=(\d+)/kind=(\w+)$", status.getPath().toString()).groups()
            out.append((int(b), int(v), kind))
        return out

    def _versions(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for b, v, _ in self._parts():
            out.setdefault(b, []).append(v)
        return out

    def load(self, rows: DataFrame, size: int = 0) -> None:
        """The content as of version 0; without a number of buckets, there is one for every BUCKET_BYTES of it.

        ``size`` is about how many bytes it has; if not given, it is written once to know.
        """
        rows = rows.select(*self.schema.fieldNames())
        if self._buckets is None and size:
            self._buckets = -(-size // self.BUCKET_BYTES)
        elif self._buckets is None:
            staged = written(rows, "loading")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(staged.inputFiles()[0]).getParent() if staged.inputFiles() else None
            size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() if path else 0
            self._buckets, rows = max(1, -(-size // self.BUCKET_BYTES)), staged
        self._write(rows, 0, "full", range(self._buckets))

    def _write(self, rows: DataFrame, version: int, kind: str, marked: Iterable[int] = ()) -> None:
        full = rows.select(*self.schema.fieldNames(), self.bucket().alias("bucket"))
        if marked:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            # a row without a key in each bucket, so that an empty one has a folder too
            marks = self.spark.range(self.buckets).select(*nothing, F.col("id").cast("int").alias("bucket"))
            full = full.unionByName(marks.where(F.col("bucket").isin(*marked)))
        # by bucket, several small buckets a task and several tasks a large one
        (full.hint("rebalance", F.col("bucket")).withColumns({"v": F.lit(version), "kind": F.lit(kind)}).sortWithinPartitions("bucket", self.key)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v", "kind")
         .parquet(self.path))

    def append(self, rows: DataFrame, version: int) -> None:
        """Rows that ``version`` adds, however many."""
        self._write(rows, version, "more")

    def read(self, upto: int, only: Iterable[int] | None = None) -> DataFrame:
        """All rows that count as of version ``upto``, not added up, of all buckets or of those named."""
        wanted, parts = None if only is None else set(only), self._parts()
        paths = []
        for b in {b for b, _, _ in parts}:
            if wanted is not None and b not in wanted:
                continue
            base = max(v for x, v, kind in parts if x == b and kind == "full" and v <= upto)
            paths.append(f"{self.path}/bucket={b}/v={base}/kind=full")
            paths += [f"{self.path}/bucket={b}/v={v}/kind=more" for x, v, kind in parts
                      if x == b and kind == "more" and base < v <= upto]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col(self.key).isNotNull())

    def now(self, upto: int) -> DataFrame:
        return self.add_up(self.read(upto))

    def added(self, version: int) -> DataFrame:
        """The rows that ``version`` appended, not added up."""
        paths = [f"{self.path}/bucket={b}/v={v}/kind=more" for b, v, kind in self._parts() if v == version and kind == "more"]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col(self.key).isNotNull())

    def beside(self, keys: DataFrame, upto: int) -> DataFrame:
        """All rows, not added up, of the buckets that hold ``keys`` (one column)."""
        name = keys.columns[0]
        if self.buckets > 1:
            only = [r[0] for r in keys.select(self.bucket(name).alias("b")).distinct().collect()]   # at most `buckets`
            return self.read(upto, only)
        return self.read(upto)

    def rows_of(self, keys: DataFrame, upto: int) -> DataFrame:
        """The rows whose key is in ``keys`` (one column), not added up: only their buckets are read."""
        wanted = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        return self.beside(keys, upto).join(wanted, self.key, "left_semi")

    def of(self, keys: DataFrame, upto: int) -> DataFrame:
        """What the table holds of the rows whose key is in ``keys`` (one column)."""
        return self.add_up(self.rows_of(keys, upto))

    def compact(self, version: int) -> list[int]:
        """Write the content of buckets with many appended parts anew, as of ``version``; the buckets so written."""
        parts, due = self._parts(), []
        for b in sorted({b for b, _, _ in parts}):
            base = max((v for x, v, kind in parts if x == b and kind == "full" and v <= version), default=0)
            if sum(x == b and kind == "more" and base < v <= version for x, v, kind in parts) >= self.PARTS:
                due.append(b)
        if due:
            self._write(self.add_up(self.read(version, due)), version, "full", due)
        return due

    def prune(self, upto: int) -> None:
        """Remove what no reader of ``upto`` or later needs."""
        jvm, parts = self.spark._jvm.org.apache.hadoop.fs, self._parts()
        for b in {b for b, _, _ in parts}:
            base = max((v for x, v, kind in parts if x == b and kind == "full" and v <= upto), default=0)
            for x, v, kind in parts:
                if x == b and (v < base or (v == base and kind == "more")):
                    path = jvm.Path(f"{self.path}/bucket={b}/v={v}/kind={kind}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
