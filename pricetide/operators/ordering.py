"""Whole-table order without a single-partition window.

``ROW_NUMBER() OVER (ORDER BY ..)`` and ``SUM(..) OVER (ORDER BY ..)`` with no
PARTITION BY (or with one very large partition) move every row into one task.
Here the first order column is cut into ranges at fixed bounds: its quantiles,
computed once and used as literals. Every row finds its range from its own
value, so whatever a plan prunes, reuses or runs again, a row is always in the
same range. Ranges are numbered (or summed) on their own; a range's offset is
the sum over the ranges before it, one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accuracy of the quantiles per range: a range holds its share of rows up to about a hundredth.
_ACCURACY = 100


def range_bounds(df: DataFrame, value: str, n: int) -> list:
    """At most ``n - 1`` ascending values that cut ``df`` into ranges of about equal size.

    Quantiles for numbers, dates and timestamps (one row is collected); for
    other types the largest value of each of ``n`` range partitions.
    """
    if n < 2:
        return []
    if not isinstance(df.schema[value].dataType, (T.NumericType, T.DatetimeType)):
        top = (df.select(F.col(value).alias("v")).repartitionByRange(n, "v").groupBy(F.spark_partition_id())
               .agg(F.max("v").alias("v")).where("v IS NOT NULL").collect())       # at most n rows
        return sorted({r["v"] for r in top})[:-1]
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(value, shares, _ACCURACY * n).alias("b")).first()["b"]
    return sorted(set(found or []))


#: Bounds that one tree of comparisons decides; beyond, a tree picks a stretch of bounds and the rest is looked up in it.
_TREE = 128


def range_of(value: str, bounds: Sequence) -> Column:
    """Number of bounds below the value: 0 for the first range (and for NULL), len(bounds) for the last.

    Up to _TREE bounds are a binary tree of compiled comparisons. With more, the
    tree finds the stretch between every k-th bound, k about the square root of
    their number, and only that stretch is searched.
    """
    col = F.col(value)

    def tree(edges: Sequence, results: Sequence[Column]) -> Column:
        if not edges:
            return results[0]
        mid = len(edges) // 2
        return F.when(col > F.lit(edges[mid]), tree(edges[mid + 1:], results[mid + 1:])).otherwise(
            tree(edges[:mid], results[:mid + 1]))

    if len(bounds) <= _TREE:
        return tree(bounds, [F.lit(i) for i in range(len(bounds) + 1)])
    step = max(-(-len(bounds) // _TREE), int(len(bounds) ** 0.5))
    edges = bounds[step - 1::step]
    # each stretch without the bound that ends it, which the tree has compared; the last may be empty
    listed = F.array(*[F.array(*[F.lit(b) for b in bounds[i * step:(i + 1) * step - 1] or bounds[-1:]]) for i in range(len(edges) + 1)])
    at = tree(edges, [F.lit(i) for i in range(len(edges) + 1)])
    inside = F.filter(F.get(listed, at), lambda b: b < col)
    return at * step + F.size(inside)


def _ranges(df: DataFrame, partitions: int | None) -> int:
    return int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_position(df: DataFrame, order: Sequence[str], *, partitions: int | None = None,
                    descending: bool = False, out: str = "position") -> DataFrame:
    """1-based position of each row in ``order`` (which must be a total order, e.g. a key).

    ``descending`` turns the first column round (NULL last), as in "most expensive first".
    """
    order = list(order)
    bounds = range_bounds(df, order[0], _ranges(df, partitions))
    place = range_of(order[0], bounds)
    ranged = df.withColumn("_range", F.lit(len(bounds)) - place if descending else place)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    first = F.col(order[0]).desc_nulls_last() if descending else F.col(order[0])
    inside = Window.partitionBy("_range").orderBy(first, *order[1:])
    return (ranged.withColumn("_nth", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_range")                # one row per range
            .withColumn(out, F.col("_off") + F.col("_nth"))
            .drop("_range", "_nth", "_off"))


def running_sum(df: DataFrame, value: str, weight: str, out: str, *, by: Sequence[str] = (),
                descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Inclusive running SUM(weight) in the order of ``value``, for each group of ``by`` (ties: each row its own step).

    A group is cut into ranges too, so one that holds all rows is still spread over all tasks.
    """
    by = list(by)
    bounds = range_bounds(df, value, _ranges(df, partitions))
    place = range_of(value, bounds)
    ranged = df.withColumn("_range", F.lit(len(bounds)) - place if descending else place)
    step = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*by, "_range").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_tot"))
    offsets = totals.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_at"),
                            F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    if not by:
        offsets = F.broadcast(offsets)                           # one row per range
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (ranged.withColumn("_local", F.sum(weight).over(inside)).join(offsets, same)
            .withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_range", "_at", "_local", "_off", *[f"_of_{c}" for c in by]))
