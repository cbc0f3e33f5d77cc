"""Seeded pseudo-randomness that does not depend on partitioning.

``rand(seed)`` is reproducible only for the same partition layout; a value
derived from the row's key and the seed is the same on any cluster and after
any task retry, so a re-run job writes the same rows.

The value is a 32-bit integer mix (xor-shift and multiply, every product kept
below 2^60 so 64-bit arithmetic never overflows) of a linear combination of
the key columns, the seed and a tag. It uses only integer operators, so the
same numbers can be written in plain SQL (see :func:`uniform_sql`).
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M32 = 1 << 32
_MIX = 0x45D9F3B
# one multiplier per key position (primes below 2^27)
_MULT = (0x3C6EF35, 0x5BD1E99, 0x1B873593 >> 2, 0x27D4EB3, 0x165667B)


def _tag_const(tag: str) -> int:
    return zlib.crc32(tag.encode()) & 0xFFFFFFF


def _mix(x: Column) -> Column:
    x = (F.shiftright(x, 16).bitwiseXOR(x) * _MIX) % _M32
    x = (F.shiftright(x, 16).bitwiseXOR(x) * _MIX) % _M32
    return F.shiftright(x, 16).bitwiseXOR(x)


def hash32(seed: int, *cols, tag: str = "") -> Column:
    """Integer in [0, 2^32) from (seed, tag, cols)."""
    acc = F.lit((int(seed) * 0x2545F49 + _tag_const(tag)) % _M32).cast("bigint")
    for i, c in enumerate(cols):
        c = F.col(c) if isinstance(c, str) else c
        acc = (acc + F.pmod(c.cast("bigint"), F.lit(_M32)) * _MULT[i % len(_MULT)]) % _M32
        acc = _mix(acc)
    return acc


def uniform(seed: int, *cols, tag: str = "") -> Column:
    """Uniform double in [0, 1) from (seed, tag, cols)."""
    return hash32(seed, *cols, tag=tag).cast("double") / F.lit(float(_M32))


def randint(seed: int, lo: int, hi: int, *cols, tag: str = "") -> Column:
    """Uniform integer in [lo, hi] (both ends included)."""
    return (F.floor(uniform(seed, *cols, tag=tag) * (hi - lo + 1)) + lo).cast("int")


# --------------------------------------------------------------------------- the same numbers in SQL

def _mix_sql(x: str) -> str:
    x = f"((xor(({x}) >> 16, ({x})) * {_MIX}) % {_M32})"
    x = f"((xor(({x}) >> 16, ({x})) * {_MIX}) % {_M32})"
    return f"xor(({x}) >> 16, ({x}))"


def hash32_sql(seed: int, *cols: str, tag: str = "") -> str:
    acc = str((int(seed) * 0x2545F49 + _tag_const(tag)) % _M32)
    for i, c in enumerate(cols):
        acc = f"(({acc}) + (((CAST({c} AS BIGINT) % {_M32}) + {_M32}) % {_M32}) * {_MULT[i % len(_MULT)]}) % {_M32}"
        acc = _mix_sql(acc)
    return acc


def uniform_sql(seed: int, *cols: str, tag: str = "") -> str:
    return f"(CAST({hash32_sql(seed, *cols, tag=tag)} AS DOUBLE) / {float(_M32)})"


# --------------------------------------------------------------------------- picks

def random_row(df: DataFrame, seed: int, key_cols: list[str], *, smallest: bool = False) -> DataFrame:
    """One row chosen by seeded hash (or the smallest key), as a bounded top-1."""
    if smallest:
        return df.orderBy(*key_cols).limit(1)
    return (df.withColumn("_h", uniform(seed, *key_cols, tag="pick"))
            .orderBy("_h", *key_cols).limit(1).drop("_h"))


def sample_n(df: DataFrame, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """``ORDER BY random() LIMIT n`` without replacement, reproducible.

    Planned as a top-n (TakeOrderedAndProject): each task keeps its n best rows,
    so n must be a batch size (the reference uses 1e5-2e5), not a table size.
    """
    return (df.withColumn("_h", uniform(seed, *key_cols, tag="sample"))
            .orderBy("_h", *key_cols).limit(int(n)).drop("_h"))
