"""Mixing sources to target weights by weighted sampling without replacement.

A document's size is its number of words. Every source has a weight and gets
that share of all words, but at most ``max_epochs`` times its own size; what
it can't take goes to the others by weight, until none is above its limit.

Inside a source the order is that of Efraimidis and Spirakis: an exponential
key -ln(u) / quality per document, u from a hash of the document's id, smallest
first. A target of 2.4 times the source is two complete epochs, then the
documents at the front of that order up to 0.4 of the source's words; the
document on the edge is taken if at least half of it fits.

No source is sorted whole. 1 - exp(-key) lies in [0, 1), which is cut into
equal buckets; sums per source and bucket (a partial aggregate) tell which
bucket holds the edge, all buckets before it are taken, and only the rows of
the edge's bucket are sorted.

Null text counts no words; a null source is a source of its own, last in the
order; documents of size 0 are never taken in a fraction, but in every epoch;
repeated rows (equal ids) have equal keys and stand together, ordered by size;
a null or non-positive quality counts as 1. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.functions.rand import hash32, hash32_sql

from .common import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 20
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
_SPAN = float(1 << 32)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with the target of each source.

    With the sources in order of limit / weight, the first k are at their
    limit and the rest share what is left by weight; k is the first for which
    that share keeps the next source within its limit.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_limit = Window.orderBy("ratio", "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sources.withColumn("rank", F.row_number().over(by_code))
              .withColumn("weight", F.element_at(listed, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
              .withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
              .withColumn("ratio", F.col("limit") / F.col("weight")))
    levels = (ranked.withColumn("place", F.row_number().over(by_limit)).crossJoin(F.broadcast(sources.agg(F.sum("source_size").alias("all_size"))))  # one row
              .withColumn("level", (F.col("all_size") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                          / F.sum("weight").over(rest)))
    fits = F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))
    return (levels.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
            .select("source", "source_size",
                    F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target")))


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS,
        max_epochs: float = MAX_EPOCHS, quality: str | None = None, seed: int = SEED) -> DataFrame:
    """Every document of ``docs`` (doc_id, text, source) once, with its size, its source's size and target,
    ``times`` (how often the mix takes it) and ``taken`` (words: size x times).

    ``quality`` names a numeric column that scales the keys; without it
    :func:`text_quality` does.
    """
    scratch = Scratch(spark, "mixing")
    worth = F.col(quality).cast("double") if quality else text_quality(F.col("text"))
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        words(F.col("text")).alias("size"), worth.alias("worth"))
    u = (hash32(seed, F.coalesce("doc_id", F.lit(-1))).cast("double") + 0.5) / _SPAN
    worth = F.when((F.col("worth") > 0) & ~F.isnan("worth"), F.col("worth")).otherwise(1.0)
    rows = scratch.write(
        sized.withColumn("key", -F.ln(u) / worth)
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")).drop("worth"), "rows")
    sums = scratch.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    goal = scratch.write(goal, "goal")
    size, epochs = F.col("source_size"), F.col("epochs")
    goal = (goal.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("bigint"))
            .withColumn("budget", F.col("target") - epochs * size))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("source").eqNullSafe(F.col("of"))
    edges = (sums.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0)))
             .join(goal.withColumnRenamed("source", "of"), same)
             .where(F.col("base") + F.col("words") > F.col("budget"))
             .groupBy("of").agg(F.min(F.struct("bucket", "base")).alias("edge")))
    goal = scratch.write(goal.withColumnRenamed("source", "of").join(
        edges.withColumnRenamed("of", "at"), F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), "edges")
    joined = rows.join(goal, same).drop("of")
    bucket, edge = F.col("bucket"), F.col("edge.bucket")
    sure = joined.where(edge.isNull() | (bucket != edge)).withColumn(
        "more", ((edge.isNull() | (bucket < edge)) & (F.col("size") > 0)).cast("int"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    close = (joined.where(bucket == edge)
             .withColumn("base", F.col("edge.base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
             .withColumn("more", ((F.col("base") + F.col("size") / 2.0 <= F.col("budget"))
                                  & (F.col("size") > 0)).cast("int")).drop("base"))
    times = F.col("epochs") + F.when(F.col("budget") > 0, F.col("more")).otherwise(0)
    return (sure.unionByName(close).withColumn("times", times)
            .select("doc_id", "source", "size", "source_size", "target", "times",
                    (F.col("size") * F.col("times")).alias("taken")))


#: Symbols and digits that mark a text as something other than prose.
_NOT_PROSE = "0123456789#$%&*+<=>@[]^_{|}~\\/"


def text_quality(text: Column) -> Column:
    """Share of characters that are not digits or symbols, squared; at least 0.01. Empty text: 1."""
    n = F.length(text)
    clean = F.length(F.translate(text, _NOT_PROSE, ""))
    return F.when(n > 0, F.greatest(F.lit(0.01), F.pow(clean / n, F.lit(2)))).otherwise(1.0)


def repeated(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it (all columns kept).

    Rows with equal doc_id are taken alike (the least ``times`` among them).
    """
    times = (mix(spark, docs, **options).groupBy(F.col("doc_id").alias("_mix_id"))
             .agg(F.min("times").cast("int").alias("_mix_times")).where("_mix_times > 0"))
    names = [F.col(f"_mix_row.{c}") for c in docs.columns]
    return (docs.select(F.struct("*").alias("_mix_row"))
            .join(times, F.col("_mix_row.doc_id").cast("bigint").eqNullSafe(F.col("_mix_id")))
            .select("_mix_row", F.explode(F.sequence(F.lit(1), "_mix_times")).alias("_mix_nth"))
            .select(*names))


# --------------------------------------------------------------------------- the same in DuckDB SQL

def oracle_sql(weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> str:
    symbols = _NOT_PROSE.replace("'", "''")
    return f"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS size,
         length(text) AS n, length(translate(text, '{symbols}', '')) AS clean
  FROM documents),
keyed AS (
  SELECT doc_id, source, size::BIGINT AS size,
         -ln(({hash32_sql(seed, 'coalesce(doc_id, -1)')} + 0.5) / {_SPAN})
           / CASE WHEN n > 0 THEN greatest(0.01, pow(clean::DOUBLE / n, 2)) ELSE 1.0 END AS key
  FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, {list(weights)}[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(weights)} + 1] AS weight FROM src),
stepped AS (
  SELECT *, {max_epochs} * source_size AS lim, sum(source_size) OVER () AS all_size,
         {max_epochs} * source_size / weight AS ratio FROM ranked),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place, (all_size - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM stepped),
goal AS (
  SELECT source, source_size, least(lim, coalesce(
    (SELECT arg_min(level, place) FROM levels l2 WHERE l2.ratio >= l2.level) * weight, lim))::DOUBLE AS target FROM levels),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
placed AS (
  SELECT k.doc_id, k.source, k.size, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM keyed k JOIN split s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, size, source_size, target,
       (epochs + CASE WHEN budget > 0 AND size > 0 AND base + size / 2.0 <= budget THEN 1 ELSE 0 END)::BIGINT AS times,
       (size * (epochs + CASE WHEN budget > 0 AND size > 0 AND base + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""
