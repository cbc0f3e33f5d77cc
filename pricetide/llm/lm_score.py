"""Cross-entropy difference of documents under a target and a background language model.

Both are bigram models over one vocabulary, all different words of all
documents, with the same interpolation and smoothing; the background's
smoothing is scaled to its size, so the models are matched. A document's score
is its loss per word under the target model minus that under the background
model: the lower, the more like the target. Words that no document holds share
one unknown word's smoothing.

The background is every document, the target every document of the labelled
choice; counts cover all of them. Texts become 64-bit word hashes once, in
chunks of some megabytes that list their different words. A chunk sends its
different bigrams, words and contexts with their counts to buckets of their
keys' hash; a bucket adds them up over all chunks and sends every chunk the
totals of its own back, by which the chunk scores its documents. A chunk sends
nothing to a bucket that it has no key for, so messages never outnumber the
chunks' different keys; the models' sizes (different words, tokens) are three
numbers counted beforehand. So no model is ever in one place, a frequent bigram
costs one entry a chunk, and what is shuffled grows with the different bigrams
of the chunks.

Null and empty texts have no words: losses and score are null. Rows with equal
doc_id are scored each for itself, and are target documents together. Without
target documents the target model is uniform. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_runs, mix64, released, slices, words_of

#: Weight of the bigram's relative frequency; the rest is the smoothed word frequency.
LAMBDA, ALPHA = 0.7, 0.5
UNKNOWN, START = 0, 1                                 # in place of a word's hash
PIECE, PIECES = 1 << 20, 16                           # bytes hashed at once, pieces in a chunk
BUCKET_WORDS, BUCKETS = 4_000_000, 48


def _packed(values: np.ndarray, steps: bool = False) -> bytes:
    """Whole numbers (or the steps between them) byte by byte: all first bytes, all second ones, ..., compressed."""
    if not len(values):
        return np.zeros(2, "<i8").tobytes()
    values = np.diff(values, prepend=values.dtype.type(0)) if steps else values
    kind = "<u8" if values.max(initial=0) >> 32 else "<u4"
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T)
    head = np.array([len(values), planes.nbytes], "<i8").tobytes()
    return head + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpacked(blob: bytes, steps: bool = False) -> np.ndarray:
    n, size = np.frombuffer(blob[:16], "<i8").tolist()
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(blob[16:], size, asbytes=True), np.uint8).reshape(-1, n)
    values = np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if steps else values


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, start, end, first = words_of(texts)
    return hash_runs(data, start, end).view(np.int64), first


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the most frequent words of all documents, most frequent first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            word, n = np.unique(_hashes(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "word").limit(size).collect()      # at most `size` rows
    return np.array([r["word"] for r in best], np.int64)


def encoded(docs: DataFrame, kept: np.ndarray | None = None) -> DataFrame:
    """chunk, n, doc_ids, sizes, words, ids: chunks of n words as numbers in the list of their different words' hashes,
    roughly by frequency; with ``kept`` all other words are one unknown word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held_ids, held_sizes, held_words, have = TaskContext.get().partitionId() << 32, [], [], [], 0

        def out() -> pa.RecordBatch:
            words, ids, count = np.unique(np.concatenate(held_words), return_inverse=True, return_counts=True)
            order = np.argsort(-np.frexp(count)[1], kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())),
                 pa.array([np.concatenate(held_sizes).tolist()], pa.list_(pa.int64())),
                 pa.array([_packed(words[order], True)], pa.binary()),
                 pa.array([_packed(rank[ids])], pa.binary())], ["chunk", "n", "doc_ids", "sizes", "words", "ids"])

        for batch in slices(batches, "text", PIECE):
            hashes, first = _hashes(batch.column("text"))
            held_ids += batch.column("doc_id").to_pylist()
            held_sizes.append(np.diff(first))
            held_words.append((hashes if kept is None else np.where(np.isin(hashes, kept), hashes, UNKNOWN)).view(np.uint64))
            have += batch.column("text").nbytes
            if have >= PIECE * PIECES:
                yield out()
                chunk, held_ids, held_sizes, held_words, have = chunk + 1, [], [], [], 0
        if held_ids:
            yield out()

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .mapInArrow(run, "chunk bigint, n bigint, doc_ids array<bigint>, sizes array<bigint>, words binary, ids binary"))


def _word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of words are odd, those of bigrams and contexts even."""
    return mix64(words) | np.uint64(1)


def _buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (ranges of keys) that have any of the sorted keys, and where each begins."""
    held, first = np.unique((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
    return held.astype(np.int64), first


class _Chunk:
    """A chunk's keys (of its different bigrams, then words, then contexts), and each word's bigram."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        words, ids = _unpacked(row["words"], True), _unpacked(row["ids"]).astype(np.int64)
        self.n_words = m = len(words)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = m          # START is behind the words
        before *= m + 1
        before += ids
        del ids
        pairs, pair = np.unique(before, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del before, pair
        self.context, self.word = pairs // (m + 1), pairs % (m + 1)
        context = mix64(np.append(words, np.uint64(START)) ^ np.uint64(0xC2B2AE3D27D4EB4F))
        bigram = mix64(context[self.context] + words[self.word])
        self.keys = np.concatenate([bigram & ~np.uint64(1), _word_keys(words), context & ~np.uint64(1)])

    def counts(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs in the chunk, or in the chosen words of it."""
        n = np.bincount(self.pair if chosen is None else self.pair[chosen], minlength=len(self.word))
        return np.concatenate([n, np.bincount(self.word, n, self.n_words),
                               np.bincount(self.context, n, self.n_words + 1)]).astype(np.int64)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys' places in order, the buckets (ranges of keys) that have any, and where each begins."""
        order = np.argsort(self.keys, kind="stable")
        return order, *_buckets(self.keys[order], buckets)


def _targets(row: dict, sizes: np.ndarray) -> np.ndarray:
    """For every word of the chunk, whether its document is a target."""
    flag = np.zeros(len(sizes), bool)
    flag[np.array(row["target"] or [], np.int64)] = True
    return np.repeat(flag, sizes)


def model_sizes(chunks: DataFrame) -> tuple[int, int, int, int]:
    """Buckets, different words (but the unknown one), words, and words of target documents in all chunks."""
    in_targets = F.aggregate(F.coalesce("target", F.array().cast("array<int>")), F.lit(0).cast("bigint"),
                             lambda sum_, nth: sum_ + F.get(F.col("sizes"), nth))
    row = chunks.agg(F.sum("n").alias("n"), F.sum(in_targets).alias("n_t")).first()
    buckets = max(BUCKETS, -(-(row["n"] or 0) // BUCKET_WORDS))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("words"):
                each = _unpacked(blob.as_py(), True)
                keys = np.sort(mix64(each[each != UNKNOWN]))
                held, first = _buckets(keys, buckets)
                if len(held):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(held), pa.array([_packed(x, True) for x in np.split(keys, first[1:])], pa.binary())],
                        ["bucket", "keys"])
        released()

    def count(bucket: pa.Table) -> pa.Table:
        each = np.unique(np.concatenate([_unpacked(x, True) for x in bucket.column("keys").to_pylist()]))
        return pa.table({"n": pa.array([len(each)], pa.int64())})

    known = (chunks.select("words").mapInArrow(words, "bucket bigint, keys binary")
             .groupBy("bucket").applyInArrow(count, "n bigint").agg(F.sum("n")).first()[0])
    return buckets, known or 0, row["n"] or 0, row["n_t"] or 0


def score(spark: SparkSession, docs: DataFrame, targets: DataFrame, *, size: int | None = None) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score for every row of ``docs`` (doc_id, text);
    ``targets`` has the doc_ids of target documents. With ``size`` only so many most frequent words are told apart."""
    scratch = Scratch(spark, "lm-score")
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    chunks = scratch.write(encoded(texts, None if size is None else vocabulary(texts, size)), "chunks")
    place = chunks.select("chunk", F.posexplode("doc_ids").alias("nth", "doc_id"))
    wanted = targets.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    flagged = place.join(wanted, "doc_id").groupBy("chunk").agg(F.collect_list("nth").alias("target"))
    chunks = scratch.write(chunks.join(scratch.write(flagged, "flagged"), "chunk", "left"), "marked")
    scratch.drop("chunks")
    buckets, vocabulary_, *tokens = model_sizes(chunks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Chunk(row)
                order, held, first = own.by_bucket(buckets)
                cols = [[_packed(x, c is own.keys) for x in np.split(c[order], first[1:])]
                        for c in (own.keys, own.counts(), own.counts(_targets(row, own.sizes)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), pa.array(np.full(len(held), row["chunk"]), pa.int64()),
                     *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "chunk", "keys", "n", "n_t"])
                del own, order, cols
                released()

    def add_up(bucket: pa.Table) -> pa.Table:
        sent = [_unpacked(x, True) for x in bucket.column("keys").to_pylist()]
        ends = np.cumsum([len(x) for x in sent])[:-1]
        each, code = np.unique(np.concatenate(sent), return_inverse=True)
        cols = []
        for c in ("n", "n_t"):
            total = np.bincount(code, np.concatenate([_unpacked(x) for x in bucket.column(c).to_pylist()]), len(each))
            cols.append(pa.array([_packed(x) for x in np.split(total.astype(np.int64)[code], ends)], pa.binary()))
        return pa.Table.from_arrays([bucket.column("chunk"), bucket.column("bucket"), *cols], ["chunk", "bucket", "n", "n_t"])

    sent = chunks.select("chunk", "sizes", "words", "ids", "target").mapInArrow(
        send, "bucket bigint, chunk bigint, keys binary, n binary, n_t binary")
    totals = sent.groupBy("bucket").applyInArrow(
        add_up, "chunk bigint, bucket bigint, n binary, n_t binary")

    def losses(chunk: pa.Table, back: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _NO_SCORES
        (row,) = chunk.to_pylist()
        own = _Chunk(row)
        order, _, _ = own.by_bucket(buckets)
        back = back.sort_by("bucket")
        sizes, of = own.sizes, np.repeat(np.arange(len(own.sizes), dtype=np.int32), own.sizes)
        means = []
        for k, c in enumerate(("n", "n_t")):
            total = np.zeros(len(order))
            total[order] = np.concatenate([_unpacked(x) for x in back.column(c).to_pylist()])
            pair, word, context = np.split(total, np.cumsum([len(own.word), own.n_words]))
            loss = _loss(pair, word[own.word], context[own.context], tokens[k], vocabulary_, tokens[1])
            sums = np.bincount(of, loss[own.pair], len(sizes))
            means.append(np.divide(sums, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0))
        cols = [means[1], means[0], means[1] - means[0]]
        del own, order, total, pair, word, context, loss, sums
        released()
        return pa.Table.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), pa.array(sizes),
             *(pa.array(c, pa.float64(), from_pandas=True) for c in cols)],
            ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    held = chunks.select("chunk", "doc_ids", "sizes", "words", "ids")
    return held.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        losses, "doc_id bigint, n_words bigint, target_loss double, background_loss double, score double")


_NO_SCORES = pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                       **{c: pa.array([], pa.float64()) for c in ("target_loss", "background_loss", "score")}})


def _loss(pairs: np.ndarray, words: np.ndarray, contexts: np.ndarray, tokens: int, size: int,
          matched: int) -> np.ndarray:
    """-ln p of bigrams by the counts of themselves, their words and contexts, in a model of ``tokens`` words; smoothing
    is ALPHA a word in a model of ``matched`` words, and in proportion in others."""
    alpha = ALPHA * (tokens / matched if matched and tokens else 1.0)
    single = (words + alpha) / (tokens + alpha * (size + 1))
    share = np.divide(pairs, contexts, out=np.zeros(len(pairs)), where=contexts > 0)
    return -np.log(np.where(contexts > 0, LAMBDA * share + (1 - LAMBDA) * single, single))
