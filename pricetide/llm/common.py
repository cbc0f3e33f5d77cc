"""What several training-data operators share: scratch tables, words, hashes, components."""

from __future__ import annotations

import codecs
import ctypes
import gc
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import scratch_path

#: Text handled at once inside a task, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20


ARROW_ROWS, TEXTS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


class Scratch:
    """Written tables of one operator call, in the folder that all executors share.

    A written table cuts the lineage: a lost executor costs the tasks that ran
    on it, never the steps before the last written table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        # texts are long: where the session has no size of its own for Arrow batches, they hold fewer rows
        if spark.conf.get(ARROW_ROWS) == "10000":
            spark.conf.set(ARROW_ROWS, TEXTS_PER_BATCH)
        self.base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables whose readers have all been written."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of about ``most`` bytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = (np.cumsum(size, dtype=np.int64) - 1) // most
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)
    released()


def released() -> None:
    """Give memory that Arrow and the C library hold for later back to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def strings(column: pa.Array) -> pa.Array:
    """A text column as large strings that start at offset 0; null is the empty text."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([filled, pa.array([], pa.large_string())])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each pair, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 31 else np.int64
    ends -= sizes
    np.subtract(starts, ends, out=ends)
    out = np.repeat(ends.astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


# --------------------------------------------------------------------------- token ids

def _byte_letters() -> str:
    """The letters that stand for bytes 0 to 255 in a byte-level vocabulary: visible ones themselves, others from 256 up."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(more)) for b in range(256))


class Encoder:
    """Token ids of texts through the tokenizers library, each different word encoded once a task.

    The vocabulary splits at white space before anything else, so a text's ids
    are those of its words one after another. A word of letters only, with
    points or commas behind, goes to the library's model directly; any other
    word goes through the whole library. Both give the ids that the library
    gives for the whole text.
    """

    #: Words remembered in a task, and bytes of them; beyond either the memory starts anew.
    KNOWN, KNOWN_BYTES = 400_000, 12 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._forget()
        gc.set_threshold(200_000, 50, 1000)            # the many small objects here hold no cycles

    def _forget(self) -> None:
        self.known: dict[str, int] = {}                # word -> its number in the arrays below
        self.letters_known = 0
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _spelled(self, word: str) -> str | None:
        """A word of letters as the model reads it; None where case or composition depend on more than single letters."""
        low = word.lower()
        if "\u03a3" in word or not low.isalpha() or not unicodedata.is_normalized("NFC", word):
            return None
        return codecs.charmap_decode(low.encode(), "strict", self.letters)[0]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers in ``ids`` and ``size``, new words appended."""
        if len(self.known) > self.KNOWN or self.letters_known > self.KNOWN_BYTES:
            self._forget()
        known, tokenize = self.known, self.model.tokenize
        new = [w for w in words if w not in known]
        plain = [w for w in new if w.isascii() and w.isalpha()]
        own = [[t.id for t in tokenize(w.lower())] for w in plain]
        hard = []
        for word in new if len(plain) < len(new) else ():
            if not word.isascii():
                spelled = self._spelled(word) if word.isalpha() else None
                if spelled is not None:
                    plain.append(word)
                    own.append([t.id for t in tokenize(spelled)])
                    continue
            elif word.isalpha():
                continue
            hard.append(word)
        own += self._whole(hard)
        known.update(zip(plain + hard, range(len(self.size), len(self.size) + len(own))))
        self.letters_known += sum(map(len, plain)) + sum(map(len, hard))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(own), np.int32)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, own), np.int32, len(own))])
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry than texts); ``end`` is put behind each text."""
        texts = strings(texts)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():     # else capitals may hide a special token
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        cut = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        each = coded.dictionary
        bare = pc.utf8_slice_codeunits(each, 0, -1)
        split = pc.and_(pc.or_(pc.ends_with(each, "."), pc.ends_with(each, ",")), pc.utf8_is_alpha(bare))
        core = pc.if_else(split, bare, each).dictionary_encode()
        own = self._numbers([*core.dictionary.to_pylist(), ".", ","])
        point, comma = own[-2:]
        tail = np.where(pc.ends_with(each, ",").to_numpy(zero_copy_only=False), comma, point)
        begin, split = np.cumsum(self.size, dtype=np.int64) - self.size, split.to_numpy(zero_copy_only=False)
        # a word's ids: those of its letters, then of the point or comma behind them
        parts = np.stack([own[core.indices.to_numpy(zero_copy_only=False)], tail], 1)
        size = self.size[parts] * np.stack([np.ones(len(split), bool), split], 1)
        flat, size = self.ids[ranges(begin[parts].ravel(), size.ravel())], size.sum(1, dtype=np.int32)
        which, cut = coded.indices.to_numpy(zero_copy_only=False), cut - cut[0]
        del texts, words, coded, each, bare, core, parts, begin
        if end is not None:
            which = np.insert(which, cut[1:], len(size))
            cut = cut + np.arange(len(cut))
            flat, size = np.append(flat, np.int32(end)), np.append(size, np.int32(1))
        sizes = size[which]
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[cut]
        starts = (np.cumsum(size) - size).astype(np.int32)[which]
        return flat[ranges(starts, sizes)], total


def binaries(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The stretches of an array between the entries of ``begin``, as binary values without a copy of each."""
    at = pa.py_buffer((begin * data.itemsize).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


# --------------------------------------------------------------------------- word hashes

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW, _POW_INV = _powers(_P, 1 << 12), _powers(_INV, 1 << 12)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each run, from one running polynomial sum."""
    global _POW, _POW_INV
    if len(_POW) <= len(data):
        n = (len(data) // (1 << 18) + 1) << 18
        _POW, _POW_INV = _powers(_P, n), _powers(_INV, n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[:len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * _POW_INV[start] + (end - start).astype(np.uint64))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text's begin (one more entry than texts)."""
    texts = strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[:offsets[-1]] if held is not None else np.zeros(0, np.uint8), offsets


def runs_of(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal, non-zero ``kind``; none crosses the offsets (where texts begin)."""
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    full = kind[start] != 0 if len(start) else np.zeros(0, bool)
    return start[full], end[full]


#: 1 for bytes that are not ASCII white space.
BLACK = np.ones(256, np.uint8)
BLACK[[32, *range(9, 14)]] = 0


def words_of(texts: pa.Array, kind: np.ndarray = BLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, start and end of each word in them, and the words before each text.

    Words are runs of bytes of one non-zero ``kind``, by default between ASCII
    white space; none crosses two texts.
    """
    data, offsets = bytes_of(texts)
    start, end = runs_of(kind[data], offsets)
    return data, start, end, np.searchsorted(start, offsets)


# --------------------------------------------------------------------------- connected components

def components(spark: SparkSession, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b; a < b); component is the smallest id.

    Each round every id moves to the neighbour (or itself) with the smallest
    hash of that round, and the links follow. A chain keeps about half of its
    ids a round, so the rounds grow with the logarithm of the longest chain,
    and the links left shrink as fast. Every step is a table in the shared
    folder; nothing is collected.
    """
    ids = scratch.write(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    where = ids.select("id", F.col("id").alias("at"))
    steps = 0
    while links.head(1):
        steps += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(steps)).alias("h"), F.col(c).alias("id"))
        near = (links.select(F.explode(F.array(
                    F.struct(F.col("a").alias("id"), F.least(rank("a"), rank("b")).alias("to")),
                    F.struct(F.col("b").alias("id"), F.least(rank("a"), rank("b")).alias("to")))).alias("x"))
                .groupBy("x.id").agg(F.min("x.to").alias("to")).select("id", F.col("to.id").alias("to")))
        moved = scratch.write(near, f"{name}-to{steps}")
        new = (links.join(moved.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
               .join(moved.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
               .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        links = scratch.write(new, f"{name}-links{steps}")
        where = (where.join(moved.select(F.col("id").alias("at"), "to"), "at", "left")
                 .select("id", F.coalesce("to", "at").alias("at")))
        where = scratch.write(where, f"{name}-at{steps}")
    least = scratch.write(where.groupBy("at").agg(F.min("id").alias("component")), f"{name}-least")
    return where.join(least, "at").select("id", "component")
