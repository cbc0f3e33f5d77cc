"""Importance resampling towards a target distribution, on hashed word and word-pair features.

Words are runs of letters, digits and non-ASCII characters in the text with
A-Z lower-cased. A text's features are its words and its pairs of neighbouring
words (joined by one space), repeats counted; a feature's bucket is the CRC-32
of its bytes modulo ``buckets``. What a bucket is worth follows from its share
in the target texts and in the corpus; a document's weight is the mean worth of
its features, and Gumbel noise from a hash of its id turns weights into a draw
without replacement.

CRC-32 is linear: a feature's checksum is the XOR of what each byte contributes
at its distance from the feature's end (a table of position x byte) and of a
constant of the length. So all features of a slice are hashed at once: their
bytes are looked up side by side and folded with ``bitwise_xor.reduceat`` over
the features. Features longer than the table are cut into blocks from their
end, and the blocks' checksums folded one after another, each moved on by a
block of zero bytes (again the table).

Two passes read the texts: one counts features per bucket (each task sends its
counts once, Spark adds them up), one scores. Collected are the bucket counts
(``buckets`` numbers). The draw cuts the scores into ranges, so nothing is
sorted in one task.

Null and empty texts have no features, weight 0 and are not drawn. Repeated
rows are scored each for itself and take ranks one after another; a null doc_id
counts as the empty text in the noise and comes last among ties. Without
documents the result is empty; without target texts all gains follow from the
corpus alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.ordering import global_position

from .common import Scratch, bytes_of, ranges, runs_of, slices

BUCKETS = 10_000
SHARE = 25
LEAST_WORDS = 20
SALT = "7:"
PIECE = 1 << 20

#: Bytes that the table covers; a longer feature is folded in blocks of so many.
REACH = 64
_POLYNOMIAL = 0xEDB88320

#: Digits, lower case letters and all bytes beyond ASCII.
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --------------------------------------------------------------------------- checksums

def _position_table(reach: int) -> np.ndarray:
    """Row d: what a byte adds to the raw remainder when d bytes follow it."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), first >> np.uint32(1))
    table = np.empty((reach, 256), np.uint32)
    table[0] = first
    for d in range(1, reach):
        table[d] = first[table[d - 1] & 0xFF] ^ (table[d - 1] >> np.uint32(8))
    return table


_TABLE = _position_table(REACH)
_FLAT = _TABLE.ravel()


def _moved(rest: np.ndarray, by: int) -> np.ndarray:
    """Raw remainders behind which ``by`` (4 to REACH) zero bytes follow."""
    return (_TABLE[by - 1][rest & 0xFF] ^ _TABLE[by - 2][(rest >> np.uint32(8)) & 0xFF]
            ^ _TABLE[by - 3][(rest >> np.uint32(16)) & 0xFF] ^ _TABLE[by - 4][rest >> np.uint32(24)])


def _constants(longest: int) -> np.ndarray:
    """By length: the initial and the final inversion in a checksum of so many bytes."""
    out = np.empty(longest + 1, np.uint32)
    rest = np.uint32(0xFFFFFFFF)
    for n in range(longest + 1):
        out[n] = rest ^ np.uint32(0xFFFFFFFF)
        rest = _FLAT[rest & np.uint32(0xFF)] ^ (rest >> np.uint32(8))
    return out


_CONSTANT = _constants(1 << 12)


def _block(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Raw remainders of the spans data[start:start + size], 1 to REACH bytes each."""
    at = ranges(start.astype(np.int64), size.astype(np.int64))
    first = np.cumsum(size, dtype=np.int64) - size
    after = np.repeat((first + size - 1).astype(np.int32), size)
    after -= np.arange(len(at), dtype=np.int32)
    after <<= 8
    after += data[at]
    return np.bitwise_xor.reduceat(_FLAT[after], first)


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each non-empty span data[start:end]."""
    global _CONSTANT
    size = (end - start).astype(np.int64)
    if not len(size):
        return np.zeros(0, np.uint32)
    longest = int(size.max())
    if longest >= len(_CONSTANT):
        _CONSTANT = _constants(2 * longest)
    out = np.empty(len(size), np.uint32)
    short = size <= REACH
    if short.all():
        out = _block(data, start, size)
    else:
        if short.any():
            out[short] = _block(data, start[short], size[short])
        long = np.flatnonzero(~short)
        head = (size[long] - 1) % REACH + 1                     # the first block is the odd one, the rest are full
        begin = start[long].astype(np.int64)
        rest, at = _block(data, begin, head), begin + head
        live = np.arange(len(long))
        while True:
            live = live[at[live] < end[long[live]]]
            if not len(live):
                break
            rest[live] = _moved(rest[live], REACH) ^ _block(data, at[live], np.full(len(live), REACH))
            at[live] += REACH
        out[long] = rest
    return out ^ _CONSTANT[size]


# --------------------------------------------------------------------------- features

def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of all texts, the text that it is in, and the words of each text."""
    data, offsets = bytes_of(texts)
    data = _LOWER[data]
    start, end = runs_of(_WORD[data], offsets)
    owner = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
    words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    # the words again, each with one space behind it: a pair is one stretch of that
    size = end - start + 1
    spaced_end = np.cumsum(size)
    spaced = np.full(int(spaced_end[-1]) if len(size) else 0, 32, np.uint8)
    begin = spaced_end - size
    spaced[ranges(begin, size - 1)] = data[ranges(start, size - 1)]
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    one = checksums(spaced, begin, spaced_end - 1)
    two = checksums(spaced, begin[pair], spaced_end[pair + 1] - 1)
    return (np.concatenate([one, two]) % np.uint32(buckets)).astype(np.int32), np.concatenate([owner, owner[pair]]), words


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts of ``docs`` (column text) per bucket; each task sends its counts once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", PIECE):
            total += np.bincount(features(batch.column("text"), buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    all_c, all_t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (all_c + float(buckets))
                                                / ((corpus.get(b, 0) + 1.0) * (all_t + float(buckets)))))
                     for b in range(buckets)], np.int64)


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, share: int = SHARE,
             least_words: int = LEAST_WORDS, salt: str = SALT) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs`` (doc_id, text) against ``target`` (text).

    ``share`` percent of the documents with at least ``least_words`` words are
    drawn; rank is null for all others.
    """
    scratch = Scratch(spark, "resample")
    each = [{r["bucket"]: r["n"] for r in bucket_counts(df, buckets).collect()}      # at most `buckets` rows each
            for df in (docs, target)]
    worth = gains(*each, buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            bucket, owner, words = features(batch.column("text"), buckets)
            n = np.bincount(owner, minlength=batch.num_rows).astype(np.int64)
            gain = worth[bucket]
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner, gain)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                ["doc_id", "words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = scratch.write(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(weigh, "doc_id bigint, words bigint, n_features bigint, weight bigint")
        .withColumn("score", F.col("weight") + noise), "scored")
    fit = scored.where(F.col("words") >= least_words)
    drawn = fit.agg((F.count(F.lit(1)) * share / 100).cast("bigint").alias("n")).first()["n"]
    # higher scores first, then smaller ids: both ascending; equal rows are interchangeable
    placed = global_position(fit.withColumn("_order", -F.col("score")).withColumn("_last", F.col("doc_id").isNull()),
                             ["_order", "_last", "doc_id", "n_features", "weight"], out="rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint")
    names = ["doc_id", "n_features", "weight", "score"]
    return (placed.select(*names, rank.alias("rank"))
            .unionByName(scored.where(F.col("words") < least_words)
                         .select(*names, F.lit(None).cast("bigint").alias("rank"))))


# --------------------------------------------------------------------------- the same in DuckDB SQL

def oracle_sql(buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, salt: str = SALT) -> str:
    def listed(table: str, key: str) -> str:
        return (f"SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                f"'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}")

    features_of = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    step = "list_reduce(list_prepend(c, range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, id AS doc_id, w FROM ({listed('documents', 'doc_id')})),
goal AS ({listed('benchmark', 'item_id')}),
one AS MATERIALIZED (SELECT row, unnest({features_of}) AS f FROM docs),
two AS MATERIALIZED (SELECT unnest({features_of}) AS f FROM goal),
steps AS (SELECT list({step} ORDER BY c) AS t FROM (SELECT unnest(range(256)) AS c)),
crc AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(f) + 1),
           lambda i: ('0x' || substr(hex(f), 2 * i - 1, 2))::BIGINT)),
         lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS b
  FROM (SELECT f FROM one UNION SELECT f FROM two), steps),
s AS (SELECT b, count(*) AS s FROM one JOIN crc USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM two JOIN crc USING (f) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets})::DOUBLE
                / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (b)),
weighed AS (
  SELECT row, count(*) AS n, sum(g)::BIGINT AS total FROM one JOIN crc USING (f) JOIN gain USING (b) GROUP BY row),
scored AS (
  SELECT d.row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight
  FROM docs d LEFT JOIN weighed USING (row)),
noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{salt}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                                           + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= {least_words}
                               ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
         count(*) FILTER (words >= {least_words}) OVER () AS n FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN words >= {least_words} AND place <= ({share} * n) // 100 THEN place END AS rank
FROM ranked"""
