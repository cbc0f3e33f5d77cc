"""Text quality by compression: which of two dictionaries, of good or of bad texts, packs a text smaller.

From the labelled texts two zstandard dictionaries are built, one of the good
and one of the bad. A text is cut into blocks, each block is compressed with
either dictionary, and the difference of the two sizes, summed over all blocks
and divided by the text's bytes, says how much more it resembles the good ones.
Blocks keep a long text from becoming its own dictionary, after which the two
would hardly matter. A logistic curve turns the difference into a probability;
it is fitted to differences from dictionaries that have not seen the text (out
of fold), held between two of their quantiles so that odd texts don't bend it.

Every byte of every text is compressed. Only the fit is bounded: the
dictionaries are built from at most ``rows`` labelled documents of each class,
those with the smallest hash of their id, and from each of those one window of
``window`` characters whose place follows from the hash. These windows are all
that comes to the driver; equal ones count once.

Null and empty texts have the difference 0. If one class has no examples all
texts get the same score, the share of good ones (1 and 0 can't occur: a
labelled text more of either class is supposed). A document with several labels
is good if one of them says so; repeated rows are scored alike; a null doc_id is
held out; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, slices

ROWS = 5000
WINDOW = 2048
#: Bytes compressed at once, and of a dictionary.
BLOCK = 2048
DICTIONARY = 112 << 10
LEVEL = 3
FOLDS = 4
THRESHOLD = 0.3
#: Quantiles of the differences between which the curve is fitted and read.
HELD = (0.02, 0.98)
PIECE = 1 << 20


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of few samples, that no dictionary can be trained from, their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


class Difference:
    """Bytes by which a text is larger with the bad dictionary than with the good one, per byte of text."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: bytes | memoryview) -> float:
        total = 0
        for at in range(0, len(text), BLOCK):
            block = text[at:at + BLOCK]
            total += len(self.bad.compress(block)) - len(self.good.compress(block))
        return total / max(1, len(text))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through weighted 0/1 values (Newton's method, a weak pull of the slope to 0)."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    pull = np.diag([1e-2, 1e-6])
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -35, 35)))
        slope = z.T @ (weight * (p - y)) + pull @ theta
        bend = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + pull
        step = np.linalg.solve(bend, slope)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]) / scale, float(theta[1])


@dataclass
class Model:
    """Both dictionaries (None where a class has no examples), the bounds of the difference, slope and intercept."""

    good: bytes | None
    bad: bytes | None
    low: float
    high: float
    slope: float
    intercept: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        x = np.clip(difference, self.low, self.high)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -35, 35)))


def fit(good: list[bytes], bad: list[bytes], odds: float, folds: int = FOLDS) -> Model:
    """Dictionaries of all samples and a curve fitted to out-of-fold differences.

    ``odds``: good labels to each bad one. The samples of a class weigh as much
    as the class does, so the scores are probabilities among the labelled.
    """
    if not good or not bad:
        return Model(None, None, 0.0, 0.0, 0.0, float(np.log(odds)))
    x, y = [], []
    for f in range(folds):
        parts = [[s for i, s in enumerate(each) if i % folds != f] or each for each in (good, bad)]
        differ = Difference(*map(build_dictionary, parts))
        for label, each in ((1, good), (0, bad)):
            own = each[f::folds]
            x += [differ(s) for s in own]
            y += [label] * len(own)
    found = np.array(x)
    low, high = (float(q) for q in np.quantile(found, HELD))
    seen = np.array(y, np.float64)
    weight = np.where(seen > 0, odds / (1 + odds) / len(good), 1 / (1 + odds) / len(bad)) * len(seen)
    slope, intercept = fit_curve(np.clip(found, low, high), seen, weight)
    return Model(build_dictionary(good), build_dictionary(bad), low, high, slope, intercept)


def window(text: Column, seed: Column, size: int) -> Column:
    """``size`` characters of a text, from a place that follows from the seed."""
    room = F.greatest(F.lit(0), F.length(text) - size) + 1
    return F.substring(text, (F.pmod(seed, room) + 1).cast("int"), F.lit(size))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, size: int = WINDOW) -> Model:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0/1) covers."""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg((F.max("quality") > 0).alias("good"))
             .withColumn("seed", F.xxhash64("id")))
    count = known.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    chosen = known.where("good").orderBy("seed", "id").limit(rows).unionAll(
        known.where("NOT good").orderBy("seed", "id").limit(rows))
    # at most twice `rows` rows, by the limits above; a window of `size` characters each
    held = (docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "id").where("text <> ''")
            .select("good", "seed", "id", window(F.col("text"), F.col("seed"), size).alias("text"))
            .groupBy("good", "id", "seed").agg(F.min("text").alias("text"))
            .orderBy("seed", "id").select("good", "text").toArrow())
    texts = [t.encode() for t in held.column("text").to_pylist()]
    classes = held.column("good").to_pylist()
    parts = [list(dict.fromkeys(t for t, good in zip(texts, classes) if good is label)) for label in (True, False)]
    return fit(*parts, odds=(count["good"] + 1) / (count["bad"] + 1))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt: those with crc32(doc_id as text) divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD,
             rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the difference for every row of ``docs``."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), rows=rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Difference(model.good, model.bad) if model.good is not None else lambda text: 0.0
        for batch in slices(batches, "text", PIECE):
            data, begin = bytes_of(batch.column("text"))
            view, at = memoryview(data), begin.tolist()
            found = np.array([differ(view[a:b]) for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), pa.array(model.score(found))], ["doc_id", "difference", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(score, "doc_id bigint, difference double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
