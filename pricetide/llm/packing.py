"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents become token ids with an end id; only those longer than a sequence
are cut. What is packed is the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus holds:

1. the configuration linear program (fewest sequences so that every length's
   count is covered) is solved by multiplicative weights: each round a knapsack
   dynamic program prices the best filling of one sequence under the weights,
   takes some of it, and lowers the weights of the lengths that it covers;
2. the fractional counts are rounded to whole sequences that never take more
   pieces of a length than there are;
3. the pieces left, and the room left in those sequences, meet in a best fit
   over the histogram, longest pieces first.

The plan (configurations with counts) is bounded by the capacity, not by the
corpus. Pieces find their place from their number among the pieces of their
length, which comes from counts per task and length, so no length, however
common, meets in one task.

Null text is the empty text, which is one piece holding only the end id. Equal
rows are packed each for itself; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Encoder, Scratch, released, slices

CAPACITY = 2048
#: Share of the scarcest length's count that one round of the linear program takes.
STEP = 1.0
#: How fast the weight of a covered length falls.
ETA = 1.0


def best_configuration(value: np.ndarray, capacity: int) -> list[int]:
    """Lengths (with repeats) that fill at most ``capacity`` with the greatest sum of values.

    ``value[n]`` is the worth of a piece of length n; 0 where there is none.
    """
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = value[1:room + 1] + best[room - 1::-1]
        n = int(worth.argmax())
        if worth[n] > best[room - 1]:
            best[room], took[room] = worth[n], n + 1 if value[n + 1] > 0 else 0
        else:
            best[room] = best[room - 1]
    out, room = [], capacity
    while room > 0:
        if took[room] and best[room] > best[room - 1]:
            out.append(int(took[room]))
            room -= int(took[room])
        else:
            room -= 1
    return out


def solve(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """The configuration linear program by multiplicative weights: configuration -> how many, fractional."""
    lengths = np.flatnonzero(counts[:capacity])      # a whole sequence needs no program
    need = counts[lengths].astype(float)
    goal, done = float((need * lengths).sum()), 0.0
    covered, found = np.zeros(len(lengths)), {}
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(len(lengths))
    value = np.zeros(capacity + 1)
    while done < goal:
        level = done / goal
        value[lengths] = lengths * np.exp(-ETA * (covered / need - level))
        chosen = best_configuration(value, capacity)
        which, times = np.unique(at[chosen], return_counts=True)
        take = STEP * float((need[which] / times).min())
        found[tuple(chosen)] = found.get(tuple(chosen), 0.0) + take
        covered[which] += take * times
        done += take * float((lengths[which] * times).sum())
    return found


def best_fit(left: np.ndarray, open_: list[tuple[tuple[int, ...], int]], capacity: int):
    """Place the pieces left into open and new sequences, longest first, each where the least room remains."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for chosen, n in open_:
        room.setdefault(capacity - sum(chosen), []).append((chosen, n))
    spaces = np.zeros(capacity + 1, bool)
    spaces[list(room)] = True
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = length + int(fits[0])
                chosen, have = room[space].pop()
                used = min(n, have)
                if have > used:
                    room[space].append((chosen, have - used))
                spaces[space] = bool(room[space])
                chosen, put = (*chosen, length), used
            else:
                each = min(capacity // length, n)
                space, used = capacity - (each - 1) * length, n // each
                chosen, put = (length,) * each, n // each * each
            rest = space - length
            room.setdefault(rest, []).append((chosen, used))
            spaces[rest] = True
            n -= put
    return [x for group in room.values() for x in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with whole counts that hold exactly ``counts[n]`` pieces of each length n."""
    left = counts.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for chosen, share in sorted(solve(left, capacity).items(), key=lambda x: (-x[1], x[0])):
        which, times = np.unique(chosen, return_counts=True)
        n = int(min(np.floor(share), (left[which] // times).min()))
        if n > 0:
            left[which] -= n * times
            out.append((chosen, n))
    full = [x for x in out if sum(x[0]) == capacity]
    return full + best_fit(left, [x for x in out if sum(x[0]) < capacity], capacity)


def _slots(configurations: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the i-th piece of a length goes, as runs: length, first i, first sequence, pieces a sequence, offset."""
    rows, first, used = [], 0, {}
    for chosen, n in configurations:
        lengths, times = np.unique(chosen, return_counts=True)
        offset = 0
        for length, each in zip(lengths[::-1].tolist(), times[::-1].tolist()):
            begin = used.get(length, 0)
            rows.append((length, begin, first, each, offset))
            used[length] = begin + n * each
            offset += length * each
        first += n
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "begin", "sequence", "each", "offset"), cols))


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of documents, each numbered among the pieces of its length in its task (part, nth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = Encoder(tokenizer_path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            ids, begin = encode(batch.column("text"), end_id)
            size, ids = np.diff(begin), ids.astype("<u4")
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            number = count_up(pieces)
            start = number * capacity
            length = np.minimum(capacity, size[row] - start)
            lo = (np.cumsum(size) - size)[row] + start
            whole = memoryview(ids).cast("B")
            parts = [whole[4 * a:4 * b] for a, b in zip(lo.tolist(), (lo + length).tolist())]
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(length), np.int64)
            nth[order] = count_up(np.unique(length, return_counts=True)[1])
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start),
                    pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                cols.append(pa.array(map(bytes, parts), pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        del encode
        released()

    schema = f"{PIECE}, part int, nth bigint" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def count_up(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY,
         end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence_id and offset; ``with_ids`` adds their ids (u32)."""
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    counts = scratch.write(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():     # at most `capacity` rows
        histogram[length] = n
    slots = _slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.write(counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "base")
    numbered = (pieces.join(base, ["part", "length"])
                .withColumn("nth", F.col("nth") + F.col("base")).drop("part", "base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = int(max(slots["begin"].max(initial=0), histogram.max(initial=0))) + 1
        key = slots["length"] * stride + slots["begin"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy()
            run = np.searchsorted(key, length * stride + nth, "right") - 1
            within = nth - slots["begin"][run]
            sequence = slots["sequence"][run] + within // slots["each"][run]
            offset = slots["offset"][run] + within % slots["each"][run] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], out_names)

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out_names = [*kept, "sequence_id", "offset"]
    schema = PIECE + (", ids binary" if with_ids else "") + ", sequence_id bigint, offset bigint"
    return numbered.select(*kept, "nth").mapInArrow(place, schema)
