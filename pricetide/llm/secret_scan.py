"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

Base spans come from three patterns (kinds assign, access, hex), leftmost and
non-overlapping per kind; they always stay. The random field tags every token
of a text as outside (O), begin (B) or inside (I) of a secret from the token's
shape (length, digits, case, hex letters, changes between digits and letters),
the words and signs before and after it, and features of the whole text (its
share of digits and symbols, its length). It is decoded by Viterbi; spans that
overlap no base span are added as kind ``crf``.

Training takes windows of at most WINDOW characters around the first span of at
most TRAIN_DOCS texts with base spans, and the first WINDOW characters of as
many texts without (those with the smallest checksum of their text); the tokens of
base spans are the examples. These bounds hold for training alone: scanning
reads whole texts.

Decoding is exact without walking through every token: a stretch of tokens can
only leave O if its summed gains over O, at best, are positive. Running sums
find all tokens that could be part of such a stretch; Viterbi runs over those.

Null text is the empty text, with no spans. Offsets count code points, ends are
exclusive. Repeated rows are scanned alike; extra columns are ignored; an empty
table gives an empty result (and a field that adds nothing).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, bytes_of, hash_runs, runs_of, slices, strings

TRAIN_DOCS, WINDOW = 400, 2000
KINDS = ("assign", "access", "hex", "crf")
PIECE = 1 << 20

#: The base patterns. A match counts if the named group is long enough.
_WORD = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_BASE = (("assign", re.compile(rf"({_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
         ("hex", re.compile("[0-9a-f]+"), 0, 24))
#: A text that holds no match of this holds none of the base patterns either.
_ANY = rf"(?:{_WORD})[\"']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) of the base spans, in order."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(_BASE):
        if kind == 2:                                 # runs of 24 and more are those that the plain pattern keeps
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end(), m.start(group)))
    return sorted(found)


_FIRST = re.compile(_ANY)
_LONG_HEX = re.compile("[0-9a-f]{24,}")


# --------------------------------------------------------------------------- tokens and features

def _table(*groups: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for g in groups:
        out[[ord(c) for c in g]] = 1
    return out


_DIGIT, _LOWER = _table("0123456789"), _table("abcdefghijklmnopqrstuvwxyz")
_UPPER, _HEX = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789abcdef")
#: Kind of byte: 0 white space, 1 part of a word (ASCII letters, digits, + / _ -, and all beyond ASCII), 2 a sign.
_KIND = np.full(256, 2, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[(_DIGIT + _LOWER + _UPPER + _table("+/_-")).astype(bool)] = 1
_KIND[128:] = 1
_LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 24, 32, 40, 64])
_NEAR = 1024                                           # hashed neighbouring words
_BLOCKS = (24, 60, 12, _NEAR, _NEAR, 16, 12, 27)
_AT = np.cumsum((0, *_BLOCKS))


def tokens(texts: pa.Array):
    """Bytes, each text's first byte, start and end of each token, and (feature blocks x tokens) feature numbers."""
    data, offsets = bytes_of(texts)
    kind = _KIND[data]
    start, end = runs_of(kind, offsets)
    if not len(start):
        return data, offsets, start, end, np.zeros((len(_BLOCKS), 0), np.int32)

    def per_token(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[start]

    size = (end - start).astype(np.int32)
    word = kind[start] == 1
    digit = _DIGIT[data]
    digits, hexes = per_token(digit), per_token(_HEX[data])
    lower, upper = per_token(_LOWER[data]), per_token(_UPPER[data])
    turns = np.zeros(len(data), np.uint8)
    turns[1:] = digit[1:] != digit[:-1]
    turns[start] = 0
    changes = np.minimum(per_token(turns), 3)
    length = np.searchsorted(_LENGTHS, size, "right")
    share = np.where(digits == 0, 0, np.where(digits == size, 4, 1 + np.minimum(2, digits * 5 // np.maximum(size, 1))))
    case = (lower > 0) + 2 * (upper > 0)
    whole_hex = (hexes == size) & word
    # neighbours, inside the same text
    text = np.searchsorted(offsets, start, "right")
    low = data + np.where(_UPPER[data], 32, 0).astype(np.uint8)
    name = (hash_runs(low, start, end) % np.uint64(_NEAR - 1)).astype(np.int32) + 1
    before = _previous_word(word, text)
    near = np.where(before >= 0, name[before], 0)
    second = np.where(before >= 0, before[np.maximum(before, 0)], -1)
    far = np.where(second >= 0, name[second], 0)
    sign = np.where(word, 0, 1 + (data[start] == ord("=")) + 2 * (data[start] == ord(":"))
                    + 4 * ((data[start] == 34) | (data[start] == 39)))
    sign = np.minimum(sign, 7)
    same_before = np.concatenate([[False], text[1:] == text[:-1]])
    same_after = np.concatenate([text[1:] == text[:-1], [False]])
    touch = np.concatenate([[False], start[1:] == end[:-1]]) & same_before
    left = np.where(same_before, np.concatenate([[0], sign[:-1]]), 0) + 8 * touch
    right = np.where(same_after, np.concatenate([sign[1:], [0]]), 0)
    # the whole text
    bytes_ = np.maximum(np.diff(offsets), 1)
    of = np.zeros(len(data) + 1, np.int64)
    np.cumsum(digit, out=of[1:])
    digit_share = np.minimum(2, (of[offsets[1:]] - of[offsets[:-1]]) * 30 // bytes_)
    np.cumsum(kind == 2, out=of[1:])
    sign_share = np.minimum(2, (of[offsets[1:]] - of[offsets[:-1]]) * 15 // bytes_)
    extent = np.minimum(2, np.log10(bytes_).astype(int) // 2)
    file = (9 * digit_share + 3 * sign_share + extent)[text - 1]
    found = np.stack([length + 12 * word, (share * 4 + case) * 2 + whole_hex, changes * 3 + np.minimum(2, length // 4),
                      near, far, left, right, file]).astype(np.int32)
    return data, offsets, start, end, found + _AT[:-1, None].astype(np.int32)


def _previous_word(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Number of the last word before each token in its text, or -1."""
    at = np.maximum.accumulate(np.where(word, np.arange(len(word)), -1))
    before = np.concatenate([[-1], at[:-1]])
    return np.where((before >= 0) & (text[np.maximum(before, 0)] == text), before, -1)


# --------------------------------------------------------------------------- the field

@dataclass
class Field:
    """Weights: emission (features x O, B, I) and transition (from x to)."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """States (0 O, 1 B, 2 I) of all tokens by Viterbi; ``text`` tells which tokens are of one text."""
        n = features.shape[1]
        state = np.zeros(n, np.int8)
        if not n or not self.emission.any():
            return state
        relative = (self.emission - self.emission[:, :1])[:, 1:].astype(np.float64)
        gain = np.zeros((n, 2))
        for block in features:
            gain += relative[block]
        t = self.transition - self.transition[0, 0]
        upper = gain.max(1) + t[:, 1:].max()
        out = max(0.0, float(t[1:, 0].max()))
        total = np.concatenate([[0.0], np.cumsum(upper)])
        # best sum of a stretch that ends before, and that begins after, each token (0: empty)
        ahead = total[:-1] - np.minimum.accumulate(total[:-1])
        behind = np.maximum.accumulate(total[::-1])[::-1][1:] - total[1:]
        open_ = np.flatnonzero(ahead + upper + behind + out > -1e-6)
        if not len(open_):
            return state
        cut = np.flatnonzero((np.diff(open_) != 1) | (text[open_[1:]] != text[open_[:-1]])) + 1
        for stretch in np.split(open_, cut):
            state[stretch] = self._viterbi(np.concatenate([np.zeros((len(stretch), 1)), gain[stretch]], 1), t)
        return state

    @staticmethod
    def _viterbi(score: np.ndarray, t: np.ndarray) -> np.ndarray:
        best, back = t[0] + score[0], np.zeros((len(score), 3), np.int8)
        for i in range(1, len(score)):
            reach = best[:, None] + t
            back[i] = reach.argmax(0)
            best = reach.max(0) + score[i]
        path = np.zeros(len(score), np.int8)
        path[-1] = (best + t[:, 0]).argmax()
        for i in range(len(score) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def fit(features: np.ndarray, gold: np.ndarray, first: np.ndarray, *, steps: int = 120, l2: float = 0.5) -> Field:
    """Maximum likelihood by forward-backward over all windows in step (Adam).

    Tokens first[i] .. first[i + 1] - 1 are window i; a window begins and ends at O.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    size = size[size > 0]
    begin = first[:-1][order][:len(size)]
    n, longest = len(size), int(size.max(initial=0))
    width = int(_AT[-1])
    if not (gold > 0).any():
        return Field(np.zeros((width, 3)), np.zeros((3, 3)))
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]       # windows longer than t
    onehot = np.eye(3)[gold]
    before = gold.copy()
    before[1:] = gold[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    pairs = np.bincount(before * 3 + gold, minlength=9).reshape(3, 3).astype(float)
    last = first[1:][np.diff(first) > 0] - 1
    pairs[:, 0] += np.bincount(gold[last], minlength=3)
    theta = np.zeros(width * 3 + 9)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emission, t = theta[:-9].reshape(-1, 3), theta[-9:].reshape(3, 3)
        score = np.zeros((len(gold), 3))
        for block in features:
            score += emission[block]
        score = np.exp(score - score.max(1, keepdims=True))
        move = np.exp(t - t.max())
        alpha = np.zeros((len(gold), 3))
        beta = np.zeros((len(gold), 3))
        a = np.tile([1.0, 0.0, 0.0], (n, 1))
        for i in range(longest):
            at = begin[:live[i]] + i
            a = (a[:live[i]] @ move) * score[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        tail = np.tile(move[:, 0], (n, 1))
        expected = np.zeros((3, 3))
        for i in range(longest - 1, -1, -1):
            at = begin[:live[i]] + i
            beta[at] = tail[:live[i]] / tail[:live[i]].sum(1, keepdims=True)
            ahead = score[at] * beta[at]
            prior = alpha[at - 1] if i else np.tile([1.0, 0.0, 0.0], (live[i], 1))
            joint = prior[:, :, None] * move[None] * ahead[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += joint.sum(0)
            tail[:live[i]] = ahead @ move.T
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        expected[:, 0] += p[last].sum(0)
        error = p - onehot
        slope = np.zeros((width, 3))
        for s in range(3):
            for k, block in enumerate(features):
                lo, hi = int(_AT[k]), int(_AT[k + 1])
                slope[lo:hi, s] += np.bincount(block - lo, error[:, s], hi - lo)
        g = np.concatenate([slope.ravel(), (expected - pairs).ravel()]) + l2 * theta
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        theta -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
    return Field(theta[:-9].reshape(-1, 3), theta[-9:].reshape(3, 3))


def gold_states(texts: list[str], data, offsets, start, end) -> np.ndarray:
    """B and I for the tokens of the secrets in base spans."""
    state = np.zeros(len(start), np.int64)
    for i, text in enumerate(texts):
        for _, _, stop, secret in base_spans(text):
            lo = int(offsets[i]) + len(text[:secret].encode())
            hi = int(offsets[i]) + len(text[:stop].encode())
            a, b = np.searchsorted(start, lo), np.searchsorted(end, hi, "right")
            if b > a and (state[a:b] == 0).any():
                state[a:b] = 2
                state[a] = 1
    return state


def train(spark: SparkSession, docs: DataFrame, *, texts: int = TRAIN_DOCS, window: int = WINDOW) -> Field:
    """Fit the field on windows of at most ``texts`` texts with base spans and as many without."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bool, dict[tuple[int, str], None]] = {True: {}, False: {}}
        for batch in slices(batches, "text", PIECE):
            column = strings(batch.column("text"))
            marked = pc.match_substring_regex(column, _ANY).to_numpy(zero_copy_only=False)
            for text, found in zip(column, marked.tolist()):
                kept, h = best[found], zlib.crc32(text.as_buffer())
                if len(kept) < 2 * texts or h < limit[found]:
                    value = text.as_py()
                    at = max(0, _FIRST.search(value).start() - window // 2) if found else 0
                    kept[h, value[at:at + window]] = None
                    if len(kept) >= 4 * texts:
                        best[found] = dict.fromkeys(sorted(kept)[:2 * texts])
                        limit[found] = max(best[found])[0]
        for found, kept in best.items():
            rows = sorted(kept)[:texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([found] * len(rows), pa.bool_()), pa.array([h for h, _ in rows], pa.int64()),
                 pa.array([piece for _, piece in rows], pa.string())], ["found", "h", "piece"])

    limit = {True: 1 << 32, False: 1 << 32}
    picked = Scratch(spark, "secret-scan").write(
        docs.select("text").mapInArrow(pick, "found boolean, h bigint, piece string"), "picked")
    parts: list[str] = []
    for found in (True, False):                        # at most `texts` windows of `window` characters each
        parts += [r["piece"] for r in picked.where(F.col("found") == found).distinct().orderBy("h", "piece")
                  .limit(texts).collect()]
    parts = sorted(set(parts))
    data, offsets, start, end, features = tokens(pa.array(parts, pa.string()))
    first = np.searchsorted(start, offsets)
    return fit(features, gold_states(parts, data, offsets, start, end), first)


# --------------------------------------------------------------------------- scanning

def scan_texts(field: Field, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) of all spans of each text, in order; offsets in code points."""
    texts = strings(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)).tolist():
        out[i] = [(a, k, b) for a, k, b, _ in base_spans(texts[i].as_py())]
    data, offsets, start, end, features = tokens(texts)
    text = np.searchsorted(offsets, start, "right") - 1
    state = field.decode(features, text)
    for at in _stretches(state, text):
        i = int(text[at[0]])
        lo, hi = int(start[at[0]]), int(end[at[1]])
        head = data[offsets[i]:lo]
        a = int((head & 0xC0 != 0x80).sum())
        b = a + int((data[lo:hi] & 0xC0 != 0x80).sum())
        if all(b <= x or a >= y for x, _, y in out[i]):
            out[i].append((a, 3, b))
    for spans in out:
        spans.sort()
    return out


def _stretches(state: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """First and last token of each span: B or a lone I, then all I that follow in the text."""
    on = np.flatnonzero(state)
    if not len(on):
        return []
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) != 1) | (state[on[1:]] == 1) | (text[on[1:]] != text[on[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(on)]]) - 1
    return list(zip(on[first].tolist(), on[last].tolist()))


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _per_piece(texts: pa.Array):
    for piece in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", PIECE):
        yield strings(piece.column(0))


def spans(field: Field, text: Column) -> Column:
    """A struct per text: n_assign, n_access, n_hex, base_sha256 and spans ("kind:start:end", comma-joined)."""
    names = ("n_assign", "n_access", "n_hex")
    kind = StructType([*(StructField(c, LongType()) for c in names), StructField("base_sha256", StringType()),
                       StructField("spans", StringType())])

    @F.arrow_udf(kind)
    def scan(texts: pa.Array) -> pa.Array:
        found = [x for piece in _per_piece(texts) for x in scan_texts(field, piece)]
        base = [[s for s in one if s[1] < 3] for one in found]
        cols = [pa.array([sum(s[1] == k for s in one) for one in base], pa.int64()) for k in range(3)]
        cols.append(pa.array([hashlib.sha256(_line(one).encode()).hexdigest() for one in base], pa.string()))
        cols.append(pa.array([_line(one) for one in found], pa.string()))
        return pa.StructArray.from_arrays(cols, [*names, "base_sha256", "spans"])

    return scan(text)


MASK = "[SECRET]"


def masked(field: Field, text: Column) -> Column:
    """The text with every span replaced by MASK (overlapping spans by one); null stays null."""
    @F.arrow_udf(StringType())
    def mask(texts: pa.Array) -> pa.Array:
        found = [x for piece in _per_piece(texts) for x in scan_texts(field, piece)]
        out = []
        for value, one in zip(texts, found):
            if not one:
                out.append(value.as_py())
                continue
            source, parts, done = value.as_py(), [], 0
            for a, _, b in one:
                if a >= done:
                    parts += [source[done:a], MASK]
                done = max(done, b)
            out.append("".join([*parts, source[done:]]))
        return pa.array(out, pa.string())

    return mask(text)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id with the counts, the digest of the base spans, and all spans, for every row of ``docs``."""
    field = train(spark, docs)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), spans(field, F.col("text")).alias("s"))
            .select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans"))


def without_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; secrets in the texts are masked, n_chars (if there) follows the text."""
    field = train(spark, docs)
    names = docs.columns
    safe = docs.select(F.struct("*").alias("_row"), masked(field, F.col("text")).alias("_text"))
    cols = []
    for c in names:
        if c == "text":
            cols.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            changed = F.col("_text") != F.col("_row.text")
            cols.append(F.when(changed, F.length("_text").cast(docs.schema[c].dataType))
                        .otherwise(F.col("_row.n_chars")).alias(c))
        else:
            cols.append(F.col(f"_row.`{c}`"))
    return safe.select(*cols)
