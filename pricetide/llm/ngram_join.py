"""Similarity join of documents on their sets of word n-grams.

Two documents are linked when the Jaccard similarity of their n-gram sets is
at least ``threshold``. Words are runs between ASCII white space of the lower
case text; a text of fewer than n words has one n-gram, all its words; a null
or empty text has none and links with nothing.

1. One pass gives every document its MinHash bands. The rows of a band are as
   many as the budget of hashes allows while a pair at the threshold still
   shares a band with probability ``recall``.
2. Texts with the same words are one class; from here on one document, the one
   with the smallest id, stands for it.
3. Classes are shuffled on band hashes. Within a hash every class is tied to
   the smallest id there, so a hash costs as many rows as it has classes. The
   components of these ties are clusters, outside which there is no candidate.
4. A cluster is dealt out in blocks of bounded classes and n-grams, every two blocks
   meet in a task with their full n-gram sets, and pairs that share a band are
   compared exactly. A task returns, for each class, how many documents it
   links to there and one tie to a linked class, enough for the components.
   Pairs themselves are never rows, and none is left out.

Rows with equal doc_id are the same document. Rows with a null doc_id are
returned unlinked. Copies count as links of each other. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, hash_runs, mix64, released, slices, words_of

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hashes of a signature at most.
HASHES = 128
#: Classes and n-grams of a block, about.
BLOCK, BLOCK_GRAMS = 128, 1 << 18
HASH_SLICE = 1 << 20


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows that reach the recall at the threshold with so many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def ngram_sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each text: its different n-grams as sorted 64-bit hashes, and two hashes of all its words in order."""
    data, start, end, first = words_of(texts)
    word = hash_runs(data, start, end)
    odd = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        grams += word[i:i + len(grams)] * odd[i]
    grams = mix64(grams)
    place = (np.arange(len(word), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        w, k = word[lo:hi], hi - lo
        one, two = (mix64(w ^ mix64(place[:k] + np.uint64(salt))).sum(dtype=np.uint64) for salt in (11, 13))
        if k >= n:
            own = np.unique(grams[lo:hi - n + 1])
        else:
            own = np.array([one], np.uint64)[:min(k, 1)]
        yield own, int(np.int64(one)), int(np.int64(two))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2 (the text's words), grams (how many), bands (one hash each)."""
    times, plus = _seeds(bands * rows)
    fold = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HASH_SLICE):
            one, two, count, hashes = [], [], [], []
            for own, k1, k2 in ngram_sets(batch.column("text"), n):
                least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(own), 4096):
                    least = np.minimum(least, (own[at:at + 4096, None] * times + plus).min(0))
                one.append(k1)
                two.append(k2)
                count.append(len(own))
                hashes.append(mix64((mix64(least).reshape(bands, rows) * fold).sum(1, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(count, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1) * bands, pa.int32()),
                                          pa.array(np.concatenate(hashes), pa.int64()))],
                ["doc_id", "k1", "k2", "grams", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, grams bigint, bands array<bigint>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """The columns of ``docs`` but its text, and the text's n-gram set."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HASH_SLICE):
            sets = [own.tobytes() for own, _, _ in ngram_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "grams"])

    names = [f.name for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", grams binary"
    return docs.mapInArrow(run, schema)


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams the sets left[i] and right[i] share, for each i."""
    size = np.array([len(s) for s in sets])
    each, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    if 30 * (size[left] + size[right]).sum() < len(sets) ** 2 * len(each) // 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                         for a, b in zip(left.tolist(), right.tolist())], np.int64)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, len(each), 1 << 14):
        a, b = np.searchsorted(code, [lo, lo + (1 << 14)])
        has = np.zeros((len(sets), 1 << 14), np.float32)
        has[row[a:b], code[a:b] - lo] = 1
        total += has @ has.T
    return total[left, right].astype(np.int64)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, for members 0 .. n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(cell: pa.Table) -> pa.Table:
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        ids, words = (cell.column(c).to_numpy() for c in ("doc_id", "k1"))
        order = np.lexsort((words, ids))
        order = order[np.append(True, (np.diff(ids[order]) != 0) | (np.diff(words[order]) != 0))]       # rows of a lost task once
        cell = cell.take(pa.array(order)).combine_chunks()
        ids, block, size = (cell.column(c).to_numpy() for c in ("doc_id", "block", "size"))
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in cell.column("grams")]
        bands = np.stack([np.asarray(b.values) for b in cell.column("bands")])
        same = np.zeros((len(ids), len(ids)), bool)
        for b in range(bands.shape[1]):
            same |= bands[:, b, None] == bands[None, :, b]
        same &= ids[:, None] < ids[None, :]
        if i != j:
            same &= block[:, None] != block[None, :]
        left, right = np.nonzero(same)
        n = np.array([len(s) for s in sets])
        if len(left):
            shared = shared_counts(sets, left, right)
            linked = shared >= threshold * (n[left] + n[right] - shared) - 1e-9
            left, right = left[linked], right[linked]
        links = np.bincount(left, size[right], len(ids)) + np.bincount(right, size[left], len(ids))
        tie = ids[roots(len(ids), left, right)]
        has = links > 0
        out = pa.table({"a": tie[has], "b": ids[has], "links": links[has].astype(np.int64)})
        del cell, sets, bands, same
        released()
        return out

    return run


def join(spark: SparkSession, docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD,
         recall: float = RECALL) -> DataFrame:
    """doc_id, n_links (other documents linked directly), class_id (smallest doc_id reachable by links)
    and kept (doc_id = class_id) for every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(spark, "ngram-join")
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    signed = scratch.write(signatures(texts, n, bands, rows), "signed")
    known = signed.where("doc_id IS NOT NULL AND grams > 0")
    classes = scratch.write(known.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"),
        F.first("grams").alias("n_grams")), "classes")
    banded = scratch.write(classes.select("id", F.explode("bands").alias("h")), "banded")
    shared = scratch.write(banded.groupBy("h").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
                           .where("n > 1").drop("n"), "shared")
    ties = banded.join(shared, "h").where("a < id").select("a", F.col("id").alias("b")).distinct()
    clusters = scratch.write(components(spark, scratch.write(ties, "ties"), scratch, "cluster"), "clusters")
    # blocks of about BLOCK classes, smaller where the sets are large: two of them meet in a task
    blocks = (classes.join(clusters, "id").groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    members = (classes.join(clusters, "id").join(blocks, "component")
               .select("id", "k1", "size", "bands", "component", "blocks",
                       F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")))
    members = scratch.write(members, "members")
    sets = full_sets(texts.withColumnRenamed("doc_id", "id").join(members, "id"), n)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (sets.withColumnRenamed("id", "doc_id").withColumn("o", other)
             .withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
             .drop("o", "blocks"))
    verified = scratch.write(cells.groupBy("component", "i", "j").applyInArrow(
        _compare(threshold), "a bigint, b bigint, links bigint"), "verified")
    linked = components(spark, scratch.write(verified.where("a < b").select("a", "b").distinct(), "links"),
                        scratch, "component")
    counted = verified.groupBy(F.col("b").alias("id")).agg(F.sum("links").alias("links"))
    result = scratch.write(
        classes.select("id", "k1", "k2", "size").join(counted, "id", "left").join(linked, "id", "left")
        .select("k1", "k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "id").alias("class_id")), "result")
    alone = (signed.where("doc_id IS NULL OR grams = 0")
             .select("doc_id", F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("class_id")))
    found = (known.select("doc_id", "k1", "k2").join(result, ["k1", "k2"])
             .select("doc_id", "n_links", "class_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when one document of each class does; of equal rows, one."""
    kept = (join(spark, docs, **options).where("kept AND doc_id IS NOT NULL")
            .select(F.col("doc_id").alias("_kept_id")).distinct())
    whole = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lower("text")).alias("_text"))
    stay = (whole.join(kept, F.col("_row.doc_id").cast("bigint") == F.col("_kept_id"))
            .dropDuplicates(["_kept_id", "_text"]).select("_row.*"))
    return stay.unionByName(docs.where("doc_id IS NULL"))


def oracle_sql(n: int = N, threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda v: v <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE s >= {threshold} * (x.n + y.n - s)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_links, c.class_id, d.doc_id = c.class_id AS kept
FROM documents d
JOIN (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) k USING (doc_id)"""
