"""Token ids of a corpus in a compact file format, and back.

Ids are coded with one canonical Huffman code of at most ``max_bits`` bits,
built from the counts of the whole corpus (package merge). A written corpus is
a folder of two tables:

* ``codebook``: id, bits. The lengths alone fix a canonical code.
* ``blocks``: independent blocks of at most BLOCK ids in ascending doc_id order
  (part, block), each with the documents it holds (their ids, sizes, how many
  ids of its first document stand in earlier blocks), the coded bits, and the
  bit offset of every CHECKPOINT-th id.

Decoding starts at all checkpoints of a block at once and moves one id a step
through a table of 2^bits entries. A reader needs one block and the codebook,
nothing else, so blocks can be read in any order and on any machine.

Null text is the empty text: only the end id. Rows with equal doc_id each stand
for themselves, next to each other; null doc_ids come first. Extra columns are
ignored; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Encoder, Scratch, binaries, released, slices

MAX_BITS = 18
BLOCK = 1 << 18
CHECKPOINT = 128
#: Ids in a range of documents that one task sorts and writes.
RANGE_IDS = 4_000_000


# --------------------------------------------------------------------------- the code

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in the best code of at most ``max_bits`` bits; 0 for symbols that don't occur."""
    bits = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        bits[used] = 1
        return bits
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    items, leaf_at = leaves, []
    for _ in range(max_bits - 1):
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        items = both[order]
        leaf_at.append(order < len(leaves))
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(leaf_at):
        own = int(is_leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    length[:take] += 1
    bits[used] = length
    return bits


def canonical(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by (bits, id), and every symbol's code."""
    order = np.flatnonzero(bits)
    order = order[np.argsort(bits[order], kind="stable")]
    longest = int(bits.max(initial=0))
    step = np.left_shift(1, longest - bits[order])
    codes = np.zeros(len(bits), np.uint64)
    codes[order] = ((np.cumsum(step) - step) >> (longest - bits[order])).astype(np.uint64)
    return order, codes


def encode(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` in big-endian order, and where every CHECKPOINT-th id begins."""
    size = bits[ids]
    end = np.cumsum(size, dtype=np.int64)
    begin = end - size
    word, shift = begin >> 5, (64 - size - (begin & 31)).view(np.uint64)
    put = codes[ids] << shift
    out = np.zeros((int(end[-1]) + 31) // 32 + 2, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
    # ids that begin in one 32-bit word: their bits there and in the next word don't overlap, so sums join them
    joined, at = np.add.reduceat(put, first), word[first]
    out[at] += joined >> np.uint64(32)
    out[at + 1] += joined & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[:(int(end[-1]) + 7) // 8], begin[::CHECKPOINT].astype("<u4")


class Decoder:
    def __init__(self, bits: np.ndarray):
        order, _ = canonical(bits)
        self.longest = int(bits.max(initial=1))
        spread = np.left_shift(1, self.longest - bits[order])
        self.symbol = np.zeros(1 << self.longest, np.int32)
        self.size = np.ones(1 << self.longest, np.int64)
        self.symbol[:int(spread.sum())] = np.repeat(order, spread)
        self.size[:int(spread.sum())] = np.repeat(bits[order], spread)

    def __call__(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at, top = checkpoints.astype(np.int64), len(window) - 1
        out = np.empty((min(CHECKPOINT, n), len(at)), np.int32)
        for step in range(len(out)):
            key = (window[np.minimum(at >> 3, top)] >> (32 - self.longest - (at & 7)).astype(np.uint32))
            key &= np.uint32((1 << self.longest) - 1)
            out[step] = self.symbol[key]
            at += self.size[key]
        return out.T.ravel()[:n]


def _times(a: int, b: int) -> int:
    """a x b as polynomials over GF(2) modulo that of crc32 (bit 31 is x^0)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_after(crc: int, crc_next: int, n_next: int) -> int:
    """crc32 of two byte strings one after another, from theirs and the length of the second."""
    power, square = 1 << 31, 1 << 23              # x^0, x^8
    while n_next:
        if n_next & 1:
            power = _times(power, square)
        square = _times(square, square)
        n_next >>= 1
    return _times(power, crc) ^ crc_next


# --------------------------------------------------------------------------- files

def write_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1,
              max_bits: int = MAX_BITS) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``folder`` in the format above."""
    scratch = Scratch(spark, "huffman")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(tokenizer_path), np.zeros(vocabulary, np.int64)
        for batch in slices(batches, "text"):
            ids, begin = encoder(batch.column("text"), end_id)
            total += np.bincount(ids, minlength=vocabulary)
            rows = binaries(ids.astype(width), begin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, pa.nulls(len(rows), pa.binary())], names_)
        del encoder
        released()
        # one more row a task: how often it has seen each id
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([total.astype("<u8").tobytes()], pa.binary())], names_)

    from tokenizers import Tokenizer
    names_ = ["doc_id", "ids", "seen"]
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    coded = scratch.write(source.mapInArrow(tokens, "doc_id bigint, ids binary, seen binary"), "ids")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for row in batch.column("seen"):
                total += np.frombuffer(row.as_buffer(), "<u8").astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for i, n in (coded.where("seen IS NOT NULL").select("seen").mapInArrow(add_up, "id bigint, n bigint")
                 .groupBy("id").agg(F.sum("n")).collect()):       # at most one row an id of the vocabulary
        counts[i] = n
    bits = code_lengths(counts, max_bits)
    _, codes = canonical(bits)
    used = np.flatnonzero(bits).tolist()
    spark.createDataFrame([(i, int(bits[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(
        f"{folder}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, nth = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        docs_, sizes, skip, have = [], [], 0, 0

        def block() -> pa.RecordBatch:
            payload, checkpoints = encode(np.concatenate(held), bits, codes)
            row = [part, number, nth - len(docs_) + 1, have, skip, docs_, sizes, checkpoints.tobytes(), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

        for batch in batches:
            for doc, row in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(row.as_buffer(), width)
                done = 0
                while done < len(ids):
                    piece = ids[done:done + BLOCK - have]
                    if not held:
                        skip = done
                    held.append(piece)
                    docs_.append(doc)
                    sizes.append(len(piece))
                    have, done = have + len(piece), done + len(piece)
                    if have == BLOCK:
                        yield block()
                        number, held, docs_, sizes, have = number + 1, [], [], [], 0
                nth += 1
        if held:
            nth -= 1
            yield block()
        released()

    names = ["part", "block", "first_doc", "n", "skip", "doc_ids", "sizes", "checkpoints", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
             pa.binary(), pa.binary()]
    parts = max(1, -(-int(counts.sum()) // RANGE_IDS))
    (coded.where("seen IS NULL").drop("seen").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(blocks, "part int, block int, first_doc bigint, n int, skip bigint, doc_ids array<bigint>, "
                         "sizes array<int>, checkpoints binary, payload binary")
     .write.option("compression", "none").parquet(f"{folder}/blocks"))
    scratch.drop("ids")


def read_ids(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """The runs of ids that the files hold: part, nth (document in the part), first (its ids before the run),
    at (the part's ids before the run), doc_id, n, crc32, and with ``with_ids`` the ids (u32)."""
    bits = np.zeros(1, np.int64)
    book = spark.read.parquet(f"{folder}/codebook").collect()     # at most one row an id of the vocabulary
    if book:
        bits = np.zeros(max(r["id"] for r in book) + 1, np.int64)
        bits[[r["id"] for r in book]] = [r["bits"] for r in book]
    files = spark.read.parquet(f"{folder}/blocks")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = (files.select("part", "block", "n")
              .withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(bits)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"], np.frombuffer(row["checkpoints"], "<u4"), row["n"]).astype("<u4")
                end = np.cumsum(row["sizes"])
                whole = memoryview(ids).cast("B")
                runs = [whole[4 * a:4 * b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())]
                k = len(runs)
                cols = [pa.array(np.full(k, row["part"]), pa.int32()), pa.array(row["first_doc"] + np.arange(k)),
                        pa.array([row["skip"]] + [0] * (k - 1), pa.int64()), pa.array(end - row["sizes"], pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                        pa.array([zlib.crc32(x) for x in runs], pa.int64()),
                        pa.array(np.full(k, row["block"]), pa.int32())]
                if with_ids:
                    cols.append(pa.array(map(bytes, runs), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["part", "nth", "first", "inside", "doc_id", "n", "crc32", "block", *(["ids"] if with_ids else [])]
    schema = ("part int, nth bigint, first bigint, inside bigint, doc_id bigint, n bigint, crc32 bigint, block int"
              + (", ids binary" if with_ids else ""))
    return (files.mapInArrow(decoded, schema).join(begins, ["part", "block"])
            .withColumn("at", F.col("begin") + F.col("inside")).drop("begin", "inside", "block"))


@F.pandas_udf(LongType())
def _joined_crc(runs):
    def one(parts):
        crc = 0
        for run in sorted(parts, key=lambda r: r["first"]):
            crc = crc32_after(crc, run["crc32"], 4 * run["n"]) if run["first"] else run["crc32"]
        return crc
    return runs.map(one)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    scratch = Scratch(spark, "huffman-read")
    runs = scratch.write(read_ids(spark, folder), "runs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.write(runs.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")   # one row a part
    whole = (runs.groupBy("part", "nth")
             .agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
                  F.count(F.lit(1)).alias("k"), F.min("crc32").alias("crc32"),
                  F.collect_list(F.struct("first", "n", "crc32")).alias("runs")))
    one = whole.where("k = 1").drop("runs")
    many = whole.where("k > 1").withColumn("crc32", _joined_crc("runs")).drop("runs")
    return (one.unionByName(many).join(base, "part")
            .select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens",
                    F.col("crc32").alias("ids_crc32")))
