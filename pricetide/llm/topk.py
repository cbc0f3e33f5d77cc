"""Exact top-k search by inner product with MaxScore over sharded postings.

A vector's components are its terms and their integer values; a posting list
is one component of all vectors of a shard. Candidates are dealt to shards by
a hash of their id, queries to blocks, and every block meets every shard in a
task (all vectors are copied to each block of queries, as each is searched in all). There the postings are walked in blocks of candidates:

* each query term has a bound, the most it can add in this block;
* terms with the smallest bounds whose sum stays below the k-th best score so
  far are non-essential: they alone can't lift a candidate into the result;
* essential postings are summed for the whole block; candidates whose sum plus
  the bounds left can still reach the k-th best score are probed in the other
  postings, largest bounds first, and leave as soon as they can't.

Every shard returns its k best of each query, and a ranking over the shards
merges them. Nothing is approximate: ties in the score go to the smaller id.

Vectors that are null or hold a null or non-finite component take no part, nor
do rows without an id; a missing component of a shorter vector is 0; rows equal
in id and vector count once. Extra columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

K, EVERY, SCALE = 20, 20, 64
#: Candidates in a shard (about): at most, at least; queries in a block.
SHARD, LEAST, QUERIES = 4096, 512, 512
#: Shards that the rows are dealt to if that leaves at least LEAST in each; blocks of a shard's postings.
SHARDS, BLOCKS = 16, 8
#: Non-essential postings probed before candidates are looked at again.
PROBE = 6


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    size = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def size_of_shards(rows: int, shard: int = SHARD) -> int:
    """Candidates in a shard: several blocks of postings in each, however few the rows."""
    return min(shard, max(LEAST, -(-rows // SHARDS)))


def non_essential(total: np.ndarray, goal) -> int:
    """How many terms, smallest bounds first with running sums ``total``, can't lift a candidate to ``goal``."""
    return int(np.searchsorted(np.maximum.accumulate(total), goal, "left"))


def best(query: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray,
         k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of one query, ids other than ``own``, by MaxScore.

    ``postings``: terms x candidates; ``high`` and ``low``: their extremes per term and block of ``step`` candidates.
    """
    top, who, goal = np.zeros(0, postings.dtype), np.zeros(0, np.int64), None
    terms = np.flatnonzero(query)
    for b in range(high.shape[1]):
        part = postings[:, b * step:(b + 1) * step]
        bound = np.maximum(query[terms] * high[terms, b], query[terms] * low[terms, b])
        order = np.argsort(bound, kind="stable")
        total = np.cumsum(bound[order])
        split = 0 if goal is None else non_essential(total, goal)
        rest = total[split - 1] if split else 0
        main = terms[order[split:]]
        score = query[main] @ part[main]
        at = np.arange(part.shape[1])
        left = order[:split][::-1]
        for lo in range(0, split, PROBE):
            keep = score + rest >= goal
            at, score = at[keep], score[keep]
            if not len(at):
                break
            some = left[lo:lo + PROBE]
            score = score + query[terms[some]] @ part[np.ix_(terms[some], at)]
            rest = rest - bound[some].sum()
        if goal is not None:
            keep = score >= goal
            at, score = at[keep], score[keep]
        found = ids[b * step + at]
        other = found != own
        top, who = np.concatenate([top, score[other]]), np.concatenate([who, found[other]])
        if len(top) > k:
            order = np.lexsort((who, -top))[:k]
            top, who = top[order], who[order]
        if len(top) == k:
            goal = top.min()
    order = np.lexsort((who, -top))
    return top[order], who[order]


def _search(k: int, step: int):
    def run(cell: pa.Table) -> pa.Table:
        is_query = cell.column("is_query").to_numpy()
        width = int(max(cell.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(), 1))
        matrix, ids = _matrix(cell.column("vector"), width), cell.column("vec_id").to_numpy()
        order = np.argsort(ids[~is_query], kind="stable")
        held, names = matrix[~is_query][order], ids[~is_query][order]
        out = [np.zeros((0, 3), np.int64)]
        if len(names):
            most = width * np.abs(matrix[is_query]).max(initial=0) * np.abs(held).max()
            kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object   # sums stay exact
            whole = [[int(x) for x in r] for r in held] if kind is object else held
            postings = np.ascontiguousarray(np.array(whole, kind).T)
            cuts = range(0, len(names), step)
            high = np.stack([postings[:, c:c + step].max(1) for c in cuts], 1)
            low = np.stack([postings[:, c:c + step].min(1) for c in cuts], 1)
            for own, row in zip(ids[is_query].tolist(), matrix[is_query]):
                query = np.array([int(x) for x in row], object) if kind is object else row.astype(kind)
                score, who = best(query, own, names, postings, high, low, k, step)
                out.append(np.stack([np.full(len(who), own), who, score.astype(np.int64)], 1))
        found = np.concatenate(out)
        return pa.Table.from_arrays([pa.array(found[:, i]) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def search(spark: SparkSession, vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE,
           shard: int = SHARD, queries: int = QUERIES, step: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (vec_id, embedding) for those with
    vec_id divisible by ``every``, by the inner product of floor(scale * component)."""
    scratch = Scratch(spark, "topk")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    rows = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
            .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select("vec_id", whole.alias("vector")).distinct())
    rows = scratch.write(rows, "rows")
    asked = F.col("vec_id") % every == 0
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    size = size_of_shards(n, shard)
    shards, blocks = max(1, -(-n // size)), max(1, -(-n_asked // queries))
    step = step or max(1, size // BLOCKS)
    deal = lambda c, m, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select(deal("vec_id", shards, 1).alias("shard"), each(blocks).alias("block"), "vec_id", "vector",
                       F.lit(False).alias("is_query"))
    want = rows.where(asked).select(each(shards).alias("shard"), deal("vec_id", blocks, 2).alias("block"), "vec_id",
                                    "vector", F.lit(True).alias("is_query"))
    found = (held.unionByName(want).groupBy("shard", "block")
             .applyInArrow(_search(k, step), "query_id bigint, vec_id bigint, score bigint"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def oracle_sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= {k}"""
