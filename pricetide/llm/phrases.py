"""Phrases that stand together more often than their parts would by chance, from FM-indexes over word numbers.

Texts (A-Z lower-cased) are cut into pieces at punctuation and line ends, and
pieces into words at blanks and tabs. Everything is per language. A task turns
its texts into shards of at most SHARD words of one language: the different
words with their counts, and the sequence of their numbers, 0 between pieces.

Counts are summed across shards level by level; only what reaches ``least``
goes on. A phrase of k + 1 words is named by the numbers of its first k and of
its last k words, so sums are over exact names, not over hashes, and a phrase
that cannot reach ``least`` (one of these two did not) is never sent. A shard
sends one message to each bucket of names, the names in order and their counts,
packed. A bucket adds up, numbers what is frequent, and answers every message
with the places in it that are frequent and their numbers:

1. words: the shards' counts are summed, frequent words get numbers, and every
   shard gets back those of its own words;
2. each shard builds the Burrows-Wheeler transforms of its sequence (infrequent
   words are 0 now, as piece ends are; sorted by as many words as a phrase can
   hold) and extends the intervals of all its frequent words;
3. levels 3 to ``most`` extend the intervals that came back as frequent. Those
   of length 2, most of which did not, are not kept for that but made once more.

The index is bidirectional: a phrase has an interval in the transform of the
sequence and one in that of the sequence read backwards. Extending it to the
left moves the first by the last-to-first mapping and the second by the number
of smaller words in the interval; extending it to the right does the same the
other way round. Levels 2, 4, .. extend to the left and 3, 5, .. to the right,
so a level reads one of the two transforms. An extended phrase has its parent's
name on one side; on the other it lies, in the index in which it was extended,
inside the interval of the phrase without the parent's outer word, if that is
frequent. All intervals of a level are extended at once.

A phrase's score is the lowest of its cuts, in exact decimals. The counts of
its longest extension to the left and to the right decide whether it is only
part of a longer one; one word longer is enough to look at, since a still
longer phrase as frequent as this one holds such a one.

Null and empty texts hold no words; a null language is ``und``; repeated rows
count each time; ties end in the phrase's bytes; an empty table gives an empty
result; extra columns are ignored. A text longer than a shard goes on in the
next one at a piece's end; a piece longer than a shard makes a longer shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, mix64, released, runs_of, slices
from .lm_score import _packed as _packed_whole
from .lm_score import _unpacked as _unpacked_whole

LEAST = 100
MOST = 5
TOP = 2000
#: Words of a shard; its index takes some 100 bytes a word while it is built.
SHARD = 1 << 20
PIECE = 2 << 20
#: Words of the corpus for each bucket that adds up counts, and the fewest buckets.
BUCKET_WORDS, BUCKETS = 1 << 22, 64
UNKNOWN_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 for what ends a piece, 1 for blanks and tabs, 2 for what words are made of.
_KIND = np.full(256, 2, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*map(ord, ".,;:!?"), *range(10, 14)]] = 0


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(held: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view(np.int32).ravel()


# --------------------------------------------------------------------------- shards

def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts as one column, whether a piece begins with each, and the words before each text."""
    data, offsets = bytes_of(texts)
    data = _LOWER[data]
    kind = _KIND[data]
    black = (kind == 2).astype(np.uint8)
    start, end = runs_of(black, offsets)
    ends = np.concatenate([[0], np.cumsum(kind == 0)])
    first = np.ones(len(start), bool)
    first[1:] = ends[start[1:]] > ends[end[:-1]]
    before = np.searchsorted(start, offsets)
    first[before[:-1][before[:-1] < len(start)]] = True
    letters = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start),
                                  [None, pa.py_buffer(letters.astype(np.int64)), pa.py_buffer(data[black.view(bool)])])
    return words, first, before


class _Open:
    """A shard of one language that is being filled."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sequence: list[np.ndarray] = []
        self.size = 0

    def add(self, words: pa.Array, first: np.ndarray) -> None:
        coded = words.dictionary_encode()
        known = self.known
        number = np.array([known.setdefault(w, len(known) + 1) for w in coded.dictionary.to_pylist()], np.int32)
        # 0 before every word that begins a piece
        own = number[coded.indices.to_numpy(zero_copy_only=False)]
        self.sequence.append(np.insert(own, np.flatnonzero(first), 0))
        self.size += len(own)

    def row(self, shard: int, lang: str) -> tuple[int, str, int, list[bytes], np.ndarray, bytes, bytes]:
        """The different words in the order of their hashes, with their counts and their numbers in the sequence."""
        sequence, words = np.concatenate(self.sequence), list(self.known)
        counts = np.bincount(sequence, minlength=len(words) + 1)[1:]
        order = np.argsort(_hashes(words), kind="stable")
        return shard, lang, self.size, [words[i] for i in order.tolist()], counts[order], _packed(order + 1), _packed(sequence)


_SHARDS = "shard bigint, lang string, n bigint, words array<binary>, counts array<bigint>, numbers binary, sequence binary"


def _shard_batch(rows: list[tuple[int, str, int, list[bytes], np.ndarray, bytes, bytes]]) -> pa.RecordBatch:
    at = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
         pa.array([r[2] for r in rows], pa.int64()),
         pa.ListArray.from_arrays(at, pa.array([w for r in rows for w in r[3]], pa.binary())),
         pa.ListArray.from_arrays(at, pa.array(np.concatenate([r[4] for r in rows]), pa.int64())),
         pa.array([r[5] for r in rows], pa.binary()), pa.array([r[6] for r in rows], pa.binary())],
        ["shard", "lang", "n", "words", "counts", "numbers", "sequence"])


def shards(docs: DataFrame, most: int = SHARD) -> DataFrame:
    """The texts of ``docs`` (lang, text) as shards; to be written at once, since numbers follow the tasks."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        opened: dict[str, _Open] = {}
        for batch in slices(batches, "text", PIECE):
            words, first, before = tokens(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            code = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(before))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                of = np.flatnonzero(code == k)
                own, begins = words.take(pa.array(of)), first[of]
                at = 0
                while at < len(of):
                    shard = opened.setdefault(lang, _Open())
                    stop = at + max(1, most - shard.size)
                    if stop < len(of):                            # on to where a piece ends
                        stop += int(np.argmax(begins[stop:])) if begins[stop:].any() else len(of) - stop
                    stop = min(stop, len(of))
                    shard.add(own.slice(at, stop - at), begins[at:stop])
                    at = stop
                    if shard.size >= most:
                        yield _shard_batch([opened.pop(lang).row(number, lang)])
                        number += 1
        for lang, shard in opened.items():
            if shard.size:
                yield _shard_batch([shard.row(number, lang)])
                number += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(fill, _SHARDS)


# --------------------------------------------------------------------------- index

def _by_context(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the sequence in the order of the ``depth`` (or more) symbols from there on."""
    n = len(sequence)
    rank, span = sequence.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        key = rank * (int(rank.max(initial=0)) + 1)
        key[:max(0, n - span)] += rank[span:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else 0
        span *= 2
    return order


def transform(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform for phrases of up to ``depth`` words: the symbol before each position, in order."""
    return np.roll(sequence, 1)[_by_context(sequence, depth)]


class Index:
    """An FM-index: the transform, where each symbol's interval begins, and the last-to-first mapping."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        order = np.argsort(bwt, kind="stable")
        self.first = np.empty(len(bwt), np.int64)
        self.first[order] = np.arange(len(bwt))
        self.sorted = bwt[order]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols above 0, and the begin and size of each one's interval (the same in both directions)."""
        symbol, begin, size = np.unique(self.sorted, return_index=True, return_counts=True)
        return symbol[symbol > 0], begin[symbol > 0], size[symbol > 0]

    def extend(self, begin: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All intervals one word longer, by the words that stand before them in this index: the interval that each
        comes from, and its begin in this and in the other index, and its size.

        ``begin`` ascends and the intervals are disjoint, as those of one length are.
        """
        total = int(size.sum())
        before = np.cumsum(size) - size
        which = np.repeat(np.arange(len(size)), size)
        at = np.arange(total) - np.repeat(before - begin, size)
        symbol = self.bwt[at]
        order = np.lexsort((symbol, which))
        which, symbol, to = which[order], symbol[order], self.first[at[order]]
        new = np.ones(total, bool)
        new[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        head = np.flatnonzero(new)
        size_of = np.diff(np.append(head, total))
        head, size_of = head[symbol[head] > 0], size_of[symbol[head] > 0]
        parent = which[head]
        # the mapping keeps the order inside a symbol, and the other index orders an interval by this very word
        return parent, to[head], other[parent] + head - before[parent], size_of


def _extended(index: Index, left: bool, begin: np.ndarray, back: np.ndarray, size: np.ndarray,
              name: np.ndarray) -> list[np.ndarray]:
    """One level: begin, back, size, and the names of the first and of the last words of each longer phrase."""
    here, there = (begin, back) if left else (back, begin)
    order = np.argsort(here, kind="stable")
    here, there, size, name = here[order], there[order], size[order], name[order]
    parent, here_of, there_of, size_of = index.extend(here, there, size)
    # without its parent's outer word, the longer phrase lies in this interval
    around = np.maximum(np.searchsorted(here, here_of, "right") - 1, 0)
    if not len(here):
        return [np.zeros(0, np.int64)] * 5
    inside = (here_of >= here[around]) & (here_of < here[around] + size[around])
    parent, here_of, there_of, size_of, around = (x[inside] for x in (parent, here_of, there_of, size_of, around))
    if left:
        return [here_of, there_of, size_of, name[around], name[parent]]
    return [there_of, here_of, size_of, name[parent], name[around]]


# --------------------------------------------------------------------------- messages

_ODD = 0x9E3779B97F4A7C15


def _hashes(words: list[bytes]) -> np.ndarray:
    """By what words are dealt out; buckets compare the words themselves."""
    return mix64(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))


def _bits(known: int) -> int:
    return max(2, (known * known - 1).bit_length())


def _code(pid: np.ndarray, sid: np.ndarray, known: int) -> np.ndarray:
    """Two numbers below ``known`` as one of :func:`_bits` bits, one to one, in an order that deals them out evenly."""
    bits, odd = _bits(known), np.uint64(_ODD)
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    x = (pid.astype(np.uint64) * np.uint64(known) + sid.astype(np.uint64)) * odd & mask
    return (x ^ (x >> half)) * odd & mask


def _decoded(code: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    bits = _bits(known)
    mask, half, back = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2), np.uint64(pow(_ODD, -1, 1 << bits))
    x = code * back & mask
    x = (x ^ (x >> half)) * back & mask
    return (x // np.uint64(max(known, 1))).astype(np.int64), (x % np.uint64(max(known, 1))).astype(np.int64)


def _dealt(code: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """The buckets (ranges of codes) that have any of the ascending codes, and which."""
    low, high = np.uint64(max(0, bits - 32)), np.uint64(min(bits, 32))
    held, first = np.unique((code >> low) * np.uint64(buckets) >> high, return_index=True)
    return held.astype(np.int64), [slice(a, b) for a, b in zip(first, [*first[1:], len(code)])]


_WORDS_SENT = "shard bigint, lang string, bucket bigint, words binary, ns binary"


def _send_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].as_py()
                counts = batch.column("counts")[i].values.to_numpy()
                held, parts = _dealt(_hashes(words), 64, buckets)
                pack = zstandard.ZstdCompressor(level=3).compress
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[i].as_py()] * len(held), pa.int64()),
                     pa.array([batch.column("lang")[i].as_py()] * len(held), pa.string()), pa.array(held),
                     # no word holds a blank
                     pa.array([pack(b" ".join(words[x])) for x in parts], pa.binary()),
                     pa.array([_packed_whole(counts[x]) for x in parts], pa.binary())],
                    ["shard", "lang", "bucket", "words", "ns"])
                del words
        released()
    return run


def _sent(code: np.ndarray, size: np.ndarray, known: int, buckets: int) -> pa.Array:
    """A shard's messages as one list: per bucket its codes, which ascend, and their counts."""
    held, parts = _dealt(code, _bits(known), buckets)
    each = pa.StructArray.from_arrays([pa.array(held), pa.array([_packed_whole(code[x], True) for x in parts], pa.binary()),
                                       pa.array([_packed_whole(size[x]) for x in parts], pa.binary())], ["bucket", "codes", "ns"])
    return pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), each)


_SENT = "sent array<struct<bucket: bigint, codes: binary, ns: binary>>"
_ANSWER = "bucket bigint, shard bigint, n bigint, places binary, numbers binary"


def _answers(bucket: pa.Table, entry: np.ndarray, sizes: list[int], kept: np.ndarray, different: int,
             sums: dict[str, pa.Array]) -> pa.Table:
    """A row without a shard with the frequent ones in the order of their numbers, and a row for every message:
    its length, the places in it of frequent ones, and their numbers in the bucket."""
    number = np.full(different, -1)
    number[kept] = np.arange(len(kept))
    places, numbers = [], []
    for part in np.split(number[entry], np.cumsum(sizes)[:-1]):
        at = np.flatnonzero(part >= 0)
        places.append(_packed_whole(at, True))
        numbers.append(_packed_whole(part[at].astype(np.uint64), True))
    ends = pa.array(np.full(len(sizes) + 2, len(kept)) * (np.arange(len(sizes) + 2) > 0), pa.int32())
    of = bucket.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([of] * (len(sizes) + 1), pa.int64()),
                     "shard": pa.array([None, *bucket.column("shard").to_pylist()], pa.int64()),
                     "n": pa.array([None, *sizes], pa.int64()), "places": pa.array([None, *places], pa.binary()),
                     "numbers": pa.array([None, *numbers], pa.binary()),
                     **{c: pa.ListArray.from_arrays(ends, x) for c, x in sums.items()}})


def _totals(entry: np.ndarray, ns: pa.ChunkedArray, different: int) -> np.ndarray:
    sent = np.concatenate([_unpacked_whole(x) for x in ns.to_pylist()])
    return np.bincount(entry, sent, different).astype(np.int64)          # whole numbers below 2 ** 53: exact


def _add_words(least: int):
    def run(bucket: pa.Table) -> pa.Table:
        sent = [zstandard.ZstdDecompressor().decompress(x).split(b" ") for x in bucket.column("words").to_pylist()]
        sizes = [len(x) for x in sent]
        words = pa.array([*chain.from_iterable(sent)], pa.binary()).dictionary_encode()
        del sent
        langs = bucket.column("lang").combine_chunks().dictionary_encode()
        code = (words.indices.to_numpy().astype(np.int64) * len(langs.dictionary)
                + np.repeat(langs.indices.to_numpy(), sizes))
        each, entry = np.unique(code, return_inverse=True)
        total = _totals(entry, bucket.column("ns"), len(each))
        kept = np.flatnonzero(total >= least)
        word = lambda at: words.dictionary.take(pa.array(each[at] // len(langs.dictionary)))
        kept = kept[np.argsort(_hashes(word(kept).to_pylist()), kind="stable")]     # as in the messages
        return _answers(bucket, entry, sizes, kept, len(each), {
            "langs": langs.dictionary.take(pa.array(each[kept] % len(langs.dictionary))).cast(pa.string()),
            "words": word(kept), "fs": pa.array(total[kept], pa.int64())})
    return run


def _add_pairs(least: int, known: int):
    def run(bucket: pa.Table) -> pa.Table:
        sent = [_unpacked_whole(x, True) for x in bucket.column("codes").to_pylist()]
        each, entry = np.unique(np.concatenate(sent), return_inverse=True)
        total = _totals(entry, bucket.column("ns"), len(each))
        kept = np.flatnonzero(total >= least)
        pid, sid = _decoded(each[kept], known)
        return _answers(bucket, entry, [len(x) for x in sent], kept, len(each), {
            "pids": pa.array(pid), "sids": pa.array(sid), "fs": pa.array(total[kept], pa.int64())})
    return run


def _returned(back: list[dict], begins: Mapping[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a shard's messages, one after another, that are frequent, and their numbers in the level."""
    place, name, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for x in sorted(back, key=lambda x: x["bucket"]):
        place.append(_unpacked_whole(x["places"], True).astype(np.int64) + before)
        name.append(_unpacked_whole(x["numbers"], True).astype(np.int64) + begins[x["bucket"]])
        before += x["n"]
    return np.concatenate(place), np.concatenate(name)


def _pairs(index: Index, names: np.ndarray) -> list[np.ndarray]:
    """All pairs of frequent words of a shard as one level, extended to the left in its forward index."""
    symbol, begin, size = index.words()
    return _extended(index, True, begin, begin, size, names[symbol - 1])


def _build(depth: int, begins: Mapping[int, int], known: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                place, name = _returned(row.column("back")[0].as_py(), begins)
                if not len(place):
                    continue
                number = _unpacked(row.column("numbers")[0].as_py())[place]
                sequence = _unpacked(row.column("sequence")[0].as_py())
                kept = np.zeros(int(max(sequence.max(initial=0), number.max(initial=0))) + 1, np.int32)
                kept[np.sort(number)] = np.arange(1, len(number) + 1)
                names = name[np.argsort(number)]
                sequence = kept[sequence]
                sequence = sequence[(sequence > 0) | (np.roll(sequence, 1) > 0)]   # one 0 is enough
                if not len(sequence) or sequence[-1]:
                    sequence = np.append(sequence, np.int32(0))                   # no phrase runs round the end
                forward, backward = transform(sequence, depth), transform(sequence[::-1], depth)
                _, _, size, pid, sid = _pairs(Index(forward), names)
                code = _code(pid, sid, known)
                order = np.argsort(code)
                yield pa.RecordBatch.from_arrays(
                    [row.column("shard"), pa.array([_packed_whole(names)], pa.binary()), pa.array([_packed(forward)], pa.binary()),
                     pa.array([_packed(backward)], pa.binary()), _sent(code[order], size[order], known, buckets)],
                    ["shard", "names", "forward", "backward", "sent"])
        released()
    return run


_FOUND = f"shard bigint, begins binary, backs binary, sizes binary, {_SENT}"


def _deepen(k: int, begins: Mapping[int, int], below: int, known: int, buckets: int):
    """From length ``k``, whose names are pairs of numbers less than ``below``, to the next, of numbers less than ``known``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                place, name = _returned(row.column("back")[0].as_py(), begins)
                if not len(place):
                    continue
                if k == 2:
                    names = _unpacked_whole(row.column("names")[0].as_py()).astype(np.int64)
                    begin, back, size, pid, sid = _pairs(Index(_unpacked(row.column("forward")[0].as_py())), names)
                    kept = np.argsort(_code(pid, sid, below))[place]
                    level = [x[kept] for x in (begin, back, size)]
                    del begin, back, size, pid, sid
                else:
                    level = [_unpacked(row.column(c)[0].as_py())[place].astype(np.int64) for c in ("begins", "backs", "sizes")]
                left = k % 2 == 1                                 # from length k to k + 1
                bwt = _unpacked(row.column("forward" if left else "backward")[0].as_py())
                *level, pid, sid = _extended(Index(bwt), left, *level, name)
                code = _code(pid, sid, known)
                order = np.argsort(code)
                yield pa.RecordBatch.from_arrays(
                    [row.column("shard"), *(pa.array([_packed(x[order])], pa.binary()) for x in level),
                     _sent(code[order], level[2][order], known, buckets)], ["shard", "begins", "backs", "sizes", "sent"])
        released()
    return run


# --------------------------------------------------------------------------- mining

def _added(sent: DataFrame, add_up: Callable[[pa.Table], pa.Table], sums: str, name: str,
           scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[int, int], int]:
    """What the buckets found: a level's rows (id and the sums), the answers (shard, back), each bucket's first id, and how many ids."""
    counted = scratch.write(sent.groupBy("bucket").applyInArrow(add_up, f"{_ANSWER}, {sums}"), name)
    found = counted.where("shard IS NULL")
    begins, known = {}, 0
    for bucket, n in sorted(found.select("bucket", F.size("fs")).collect()):       # one row a bucket
        begins[bucket] = known
        known += n
    first = scratch.spark.createDataFrame(list(begins.items()), "bucket bigint, begin bigint")
    columns = F.arrays_zip(*[F.col(c.split()[0]).alias(c.split()[0][:-1]) for c in sums.split(", ")])
    level = (found.join(F.broadcast(first), "bucket").select("begin", F.posexplode(columns).alias("pos", "of"))
             .select((F.col("begin") + F.col("pos")).alias("id"), "of.*"))
    back = (counted.where("shard IS NOT NULL").groupBy("shard")
            .agg(F.collect_list(F.struct("bucket", "n", "places", "numbers")).alias("back")))
    return level, back, begins, known


def frequent(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, most: int = MOST,
             shard: int = SHARD, scratch: Scratch | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and per length 1 to ``most`` the phrases that occur ``least`` times or more.

    A level has (id, lang, f, words), from length 2 on also pid and sid: the ids
    of its first and of its last words, one level below. Ids are per level.
    """
    scratch = scratch or Scratch(spark, "phrases")
    held = scratch.write(shards(docs, shard), "shards")
    totals = scratch.write(held.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(BUCKETS, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    level, back, begins, known = _added(
        held.select("shard", "lang", "words", "counts").mapInArrow(_send_words(buckets), _WORDS_SENT),
        _add_words(least), "langs array<string>, words array<binary>, fs array<bigint>", "words", scratch)
    levels = [scratch.write(level.select("id", "lang", "f", F.array(F.col("word").cast("string")).alias("words")), "level1")]
    index = scratch.write(held.select("shard", "numbers", "sequence").join(back, "shard").mapInArrow(
        _build(most, begins, known, buckets), f"shard bigint, names binary, forward binary, backward binary, {_SENT}"), "index")
    scratch.drop("shards")
    found = index
    for k in range(2, most + 1):
        below, prior = levels[-1], known
        level, back, begins, known = _added(found.select("shard", F.inline("sent")), _add_pairs(least, prior),
                                            "pids array<bigint>, sids array<bigint>, fs array<bigint>", f"sums{k}", scratch)
        named = (level.join(below.select(F.col("id").alias("pid"), "lang", F.col("words").alias("head")), "pid")
                 .join(below.select(F.col("id").alias("sid"), F.element_at("words", -1).alias("last")), "sid")
                 .select("id", "lang", "f", F.concat("head", F.array("last")).alias("words"), "pid", "sid"))
        levels.append(scratch.write(named, f"level{k}"))
        if k == most:
            break
        kept = index.select("shard", "names", "forward", "backward") if k == 2 else (
            found.drop("sent").join(index.select("shard", "forward" if k % 2 == 1 else "backward"), "shard"))
        found = scratch.write(kept.join(back, "shard").mapInArrow(_deepen(k, begins, prior, known, buckets), _FOUND), f"found{k}")
    scratch.drop("index", *[f"found{k}" for k in range(2, most)])
    return totals, levels


def _with_parts(levels: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """Per length from 2 on: id, lang, f, words, the counts of the first 1, 2, .. words and of the last ones (longest first).

    Each length is written: it is read twice for the next one, and plans would double with every word.
    """
    one = F.array(F.col("f"))
    parts, out = levels[0].select("id", one.alias("fronts"), one.alias("backs")), []
    for k, level in enumerate(levels[1:], 2):
        joined = (level.join(parts.select(F.col("id").alias("pid"), "fronts"), "pid")
                  .join(parts.select(F.col("id").alias("sid"), "backs"), "sid"))
        joined = scratch.write(joined.select("id", "lang", "f", "words", "fronts", "backs"), f"parts{k}")
        out.append(joined)
        parts = joined.select("id", F.concat("fronts", one).alias("fronts"), F.concat(one, "backs").alias("backs"))
    return out


def _best_cut(f: Column, n: Column, fronts: Column, backs: Column) -> Column:
    """(score, cut, l, r) of the lowest-scoring cut, the first of equal ones. Decimals: 38 digits hold all products."""
    wide = lambda c: c.cast("decimal(18,0)")

    def cut(pair: Column, k: Column) -> Column:
        l, r = pair["fronts"], pair["backs"]
        top = (wide(f) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
        return F.struct(_floor_div(top, (wide(l) * wide(r))).alias("score"), k.alias("cut"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.arrays_zip(fronts.alias("fronts"), backs.alias("backs")), cut))


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def collocations(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, most: int = MOST, top: int | None = TOP,
                 shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (its parts' counts), n (all words of the language), score, and the
    counts of its most frequent extension by one word to the left and to the right; the first ``top`` of each language.
    """
    scratch = Scratch(spark, "phrases")
    totals, levels = frequent(spark, docs, least=least, most=most, shard=shard, scratch=scratch)
    scored = []
    for k, phrases in enumerate(_with_parts(levels, scratch), 1):
        longer = levels[k + 1] if k + 1 < len(levels) else None
        for side, key in (("left", "sid"), ("right", "pid")):
            if longer is None:
                phrases = phrases.withColumn(side, F.lit(0).cast("bigint"))
                continue
            widest = longer.groupBy(F.col(key).alias("id")).agg(F.max("f").alias(side))
            phrases = phrases.join(widest, "id", "left").withColumn(side, F.coalesce(side, F.lit(0)))
        scored.append(phrases.where(100 * F.greatest("left", "right") < 100 * F.col("f"))
                      .join(totals, "lang")
                      .withColumn("best", _best_cut(F.col("f"), F.col("n"), F.col("fronts"), F.col("backs")))
                      .select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "n",
                              F.col("best.score").cast("bigint").alias("score"), "left", "right"))
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    # written: the window below would otherwise run all of it once more for its ranges
    out = scratch.write(out, "scored")
    ranked = out.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left", "right")


# --------------------------------------------------------------------------- the same in DuckDB SQL

def oracle_sql(least: int = LEAST, most: int = MOST, top: int = TOP) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i "
        f"FROM pieces WHERE len(w) >= {k})" for k in range(1, most + 1))
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
    SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
    FROM documents)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, p, count(*)::HUGEINT AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (
  SELECT lang, k, p, f, unnest(range(1, k)) AS c, string_split(p, ' ') AS w FROM f WHERE k >= 2),
scores AS (
  SELECT c.lang, c.k, c.p, c.f, c.c, l.f AS l, r.f AS r, n, (1000 * c.f * n) // (l.f * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.c], ' ')
  JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.c + 1:], ' ') JOIN total t ON t.lang = c.lang),
best AS (
  SELECT lang, k, p, f AS a, n, arg_min(l, (score, c)) AS l, arg_min(r, (score, c)) AS r, min(score) AS score
  FROM scores GROUP BY ALL),
wider AS (
  SELECT lang, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) AS p, f, unnest(['right', 'left']) AS side
  FROM (SELECT lang, k, f, string_split(p, ' ') AS w FROM f WHERE k > 2)),
around AS (
  SELECT lang, p, coalesce(max(f) FILTER (side = 'left'), 0) AS "left", coalesce(max(f) FILTER (side = 'right'), 0) AS "right"
  FROM wider GROUP BY lang, p),
kept AS (
  SELECT b.*, coalesce(w."left", 0) AS "left", coalesce(w."right", 0) AS "right" FROM best b LEFT JOIN around w USING (lang, p)
  WHERE 100 * greatest(coalesce(w."left", 0), coalesce(w."right", 0)) < 100 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score, "left"::BIGINT AS "left", "right"::BIGINT AS "right" FROM ranked WHERE rank <= {top}"""
