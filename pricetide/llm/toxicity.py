"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model is a logistic
regression on the features of the text and the probabilities of the categories
before it. For training, those probabilities come from models that have not
seen the row (out of fold), so a later model learns how far it can trust them.

Features say which words and word beginnings (4 and 6 bytes) a text holds, as
hashes. Of all features in the training rows those that go with a category are
kept: counts per feature are a Spark aggregate, only the KEPT strongest of a
category come to the driver, where the models (a few thousand weights) are
fitted. Scoring reads every word of every text.

Training takes at most ``rows`` labelled documents, those with the smallest
hash of their id; of texts with the same words in the same order the one with
the smallest id is used. The first two categories are toxic texts that hold one
of the ten words below: where a corpus holds none of them both are empty, and the
chain is its last classifier alone. The bound is the parameter TRAIN_ROWS; all else covers all documents.

Null and empty texts have no features: they get the probabilities of the
intercepts. A category without examples has probability 0. Repeated rows are
scored alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, hash_runs, slices, strings, words_of

TRAIN_ROWS = 12_000
KEPT = 1500
#: A feature counts only if this many training texts of the category hold it, and with this G statistic.
LEAST_TEXTS, LEAST_G = 4, 20.0
FOLDS = 4
THRESHOLD = 0.5
PIECE = 1 << 20

#: Words by which a toxic text counts as an example of the first two categories.
INSULT = ("idiot", "moron", "loser", "clown", "scum", "trash")
DEMEANING = ("stupid", "pathetic", "worthless", "disgusting")

#: Letters and digits, and all bytes beyond ASCII.
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words (three each: word, 4 and 6 first bytes) and each text's first (one more than texts)."""
    data, start, end, first = words_of(texts, _WORD)
    parts = [hash_runs(data, start, stop) ^ np.uint64(salt)
             for stop, salt in ((end, 0), (np.minimum(end, start + 4), 4), (np.minimum(end, start + 6), 6))]
    return np.stack(parts, 1).ravel().view(np.int64), 3 * first


@dataclass
class Chain:
    """Fitted models: the kept feature hashes, and per category its weights, those of earlier ones, and intercept."""

    names: tuple[str, ...]
    features: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    chained: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) pairs of the kept features that the texts hold, each once."""
        codes, first = hashed(texts)
        few = np.zeros(1 << 16, bool)
        few[self.features & 0xFFFF] = True
        at = np.flatnonzero(few[codes & 0xFFFF])
        if not len(self.features) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.features, codes[at]), len(self.features) - 1)
        hit = self.features[place] == codes[at]
        row = np.searchsorted(first, at[hit], "right") - 1
        pair = np.unique(row * len(self.features) + place[hit])
        return pair // len(self.features), pair % len(self.features)

    def probabilities(self, row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for k in range(len(self.weights)):
            score = np.bincount(row, self.weights[k][code], n) + out[:, :k] @ self.chained[k] + self.intercepts[k]
            out[:, k] = _sigmoid(score)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(row: np.ndarray, code: np.ndarray, width: int, extra: np.ndarray, y: np.ndarray, *,
             l2: float = 1.0, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse 0/1 features (row, code), of dense ``extra`` columns, and the intercept (Adam, full batch)."""
    n = len(y)
    if not n or y.min() == y.max():
        return np.zeros(width), np.zeros(extra.shape[1]), 35.0 if n and y[0] else -35.0
    theta = np.zeros(width + extra.shape[1] + 1)
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = np.bincount(row, theta[code], n) + extra @ theta[width:-1] + theta[-1]
        error = _sigmoid(score) - y
        slope = np.concatenate([np.bincount(code, error[row], width), extra.T @ error, [error.sum()]])
        slope[:-1] += l2 * theta[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        theta -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
    return theta[:width], theta[width:-1], float(theta[-1])


def fit_chain(names: tuple[str, ...], features: np.ndarray, row: np.ndarray, code: np.ndarray,
              y: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fit all categories in order on training rows 0 .. len(y) - 1 (y: one 0/1 column a category)."""
    chain, width, n = Chain(names, features), len(features), len(y)
    fold = np.arange(n) % folds
    held_out = np.zeros((n, len(names)))
    for k in range(len(names)):
        before = held_out[:, :k]
        for f in range(folds):
            train, own = fold != f, fold[row] != f
            number = np.cumsum(train) - 1
            w, c, b = logistic(number[row[own]], code[own], width, before[train], y[train, k])
            score = np.bincount(row, w[code], n) + before @ c + b
            held_out[~train, k] = _sigmoid(score)[~train]
        w, c, b = logistic(row, code, width, before, y[:, k])
        chain.weights.append(w)
        chain.chained.append(c)
        chain.intercepts.append(b)
    return chain


def g_statistic(both: Column, has: Column, positive: Column, n: Column) -> Column:
    """Likelihood ratio of a feature and a category in the same texts, 0 where they avoid each other."""
    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    g = 2 * (cell(both, has * positive / n) + cell(has - both, has * (n - positive) / n)
             + cell(positive - both, (n - has) * positive / n)
             + cell(n - has - positive + both, (n - has) * (n - positive) / n))
    return F.when(both * n > has * positive, g).otherwise(0.0)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS,
          kept: int = KEPT) -> Chain:
    """Fit insult -> demeaning -> toxic on labelled documents (labels: doc_id, toxic)."""
    scratch = Scratch(spark, "toxicity")
    names = ("insult", "demeaning", "toxic")
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(rows))
    # at most `rows` rows, by the limit above
    held = (docs.select(F.col("doc_id").cast("bigint").alias("id"), F.lower("text").alias("text"))
            .join(F.broadcast(chosen), "id"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            texts = strings(batch.column("text"))
            codes, first = hashed(texts)
            each = [np.unique(codes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            same = [xxhash.xxh64(np.ascontiguousarray(codes[a:b]).tobytes()).intdigest() - (1 << 63)
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            seed = [[int(np.isin(_seed_hashes(w), own).any()) for own in each] for w in (INSULT, DEMEANING)]
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(same, pa.int64()), *(pa.array(np.array(s) * toxic, pa.int32()) for s in seed),
                 pa.array(toxic.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()),
                                          pa.array(np.concatenate(each), pa.int64()))],
                ["id", "same", *names, "codes"])

    def one(frame: DataFrame, key: str, order: str) -> DataFrame:
        return frame.groupBy(key).agg(F.min_by(F.struct(*frame.columns), F.struct(order, "toxic")).alias("r")).select("r.*")

    # texts with the same words are one example, that with the smallest id; a training set doesn't depend on row order
    told = held.mapInArrow(sketch, "id bigint, same bigint, insult int, demeaning int, toxic int, codes array<bigint>")
    sample = scratch.write(one(one(told, "id", "same"), "same", "id"), "sample")
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    n, counts = total["n"], {c: total[c] or 0 for c in names}
    seen = scratch.write(sample.select(*names, F.explode("codes").alias("code")).groupBy("code").agg(
        F.count(F.lit(1)).alias("has"), *[F.sum(c).alias(c) for c in names]).where(f"toxic >= {LEAST_TEXTS}"), "seen")
    picked: set[int] = set()
    for c in names:
        g = g_statistic(F.col(c), F.col("has"), F.lit(float(counts[c])), F.lit(float(n)))
        best = (seen.where(F.col(c) >= LEAST_TEXTS).select("code", g.alias("g")).where(F.col("g") >= LEAST_G)
                .orderBy(F.desc("g"), "code").limit(kept).collect())               # at most `kept` rows
        picked.update(r["code"] for r in best)
    features = np.array(sorted(picked), np.int64)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.searchsorted(features, x[np.isin(x, features)])
                     for x in batch.column("codes").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in names), pa.array([x.tolist() for x in lists],
                                                                                pa.list_(pa.int32()))],
                ["id", *names, "codes"])

    # at most `rows` rows of at most 3 x `kept` feature numbers
    data = sample.mapInArrow(restrict, "id bigint, insult int, demeaning int, toxic int, codes array<int>") \
        .orderBy(F.xxhash64("id"), "id").toPandas()
    size = np.array([len(x) for x in data["codes"]], np.int64)
    row = np.repeat(np.arange(len(data)), size)
    code = np.concatenate([*data["codes"], np.zeros(0)]).astype(np.int64)
    return fit_chain(names, features, row, code, data[list(names)].to_numpy(np.float64))


def _seed_hashes(words: tuple[str, ...]) -> np.ndarray:
    codes, first = hashed(pa.array(list(words)))
    return codes[first[:-1]]


def scores(chain: Chain, text: Column) -> Column:
    """A struct with the probability of each category for a lower case text column."""
    kind = StructType([StructField(c, DoubleType()) for c in chain.names])

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, len(chain.names)))]
        for piece in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", PIECE):
            out.append(chain.probabilities(*chain.present(piece.column(0)), piece.num_rows))
        found = np.concatenate(out)
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(chain.names))], list(chain.names))

    return score(F.lower(text))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category, and rejected (toxic) for every row of ``docs``."""
    chain = train(spark, docs, labels)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), scores(chain, F.col("text")).alias("p"))
    return scored.select("doc_id", *[F.col(f"p.{c}").alias(f"p_{c}") for c in chain.names],
                         (F.col("p.toxic") >= threshold).alias("rejected"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, *,
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not rejected."""
    chain = train(spark, docs, labels)
    return (docs.select(F.struct("*").alias("_row"), scores(chain, F.col("text"))["toxic"].alias("_toxic"))
            .where(F.col("_toxic") < threshold).select("_row.*"))
