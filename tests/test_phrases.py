"""Phrase mining: plans that don't grow with the length of phrases, numbers that go back to shards without a join."""

import random
from collections import Counter

import numpy as np

from pricetide.llm import phrases
from pricetide.llm.common import Scratch

TEXTS = [("en", "a b c d e. a b c d e"), ("en", "a b c d e x"), (None, "a b c d e a b c d e"), ("de", None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_small(spark):
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    scratch = Scratch(spark, "phrases-test")
    _, levels = phrases.frequent(spark, docs, least=2, most=5, scratch=scratch)
    parts = phrases._with_parts(levels, scratch)
    assert [_plan(p).count("Join") for p in parts] == [0, 0, 0, 0]
    counts = {(r.lang, " ".join(r.words)): (r.f, r.fronts, r.backs) for r in parts[-1].collect()}
    assert counts == {("en", "a b c d e"): (3, [3, 3, 3, 3], [3, 3, 3, 3]), ("und", "a b c d e"): (2, [2, 2, 2, 2], [2, 2, 2, 2])}


def test_words_are_numbered_from_the_places_that_hold_them(spark):
    """Shards of three words: every frequent word gets its number in each of them, others in none."""
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    totals, levels = phrases.frequent(spark, docs, least=3, most=2, shard=3)
    assert {r.lang: r.n for r in totals.collect()} == {"en": 16, "und": 10}
    assert {(r.lang, r.words[0]): r.f for r in levels[0].collect()} == {("en", w): 3 for w in "abcde"}
    whole = phrases.frequent(spark, docs, least=3, most=2)[1]
    # shards end where pieces do, so their length changes no count
    assert {(r.lang, *r.words): r.f for r in levels[1].collect()} == {(r.lang, *r.words): r.f for r in whole[1].collect()} == {
        ("en", a, b): 3 for a, b in zip("abcd", "bcde")}
    assert "places" not in levels[0].columns


def test_pairs_travel_packed(spark):
    """A shard sends a row to a bucket, not one for each pair that it holds, and gets back its places and numbers."""
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(60)}" for _ in range(500)] for _ in range(12)]
    docs = spark.createDataFrame([("en", " ".join(t)) for t in texts], "lang string, text string").coalesce(1)
    scratch = Scratch(spark, "phrases-test")
    _, levels = phrases.frequent(spark, docs, least=2, most=3, shard=1500, scratch=scratch)
    for k, level in enumerate(levels, 1):
        want = Counter(tuple(t[i:i + k]) for t in texts for i in range(len(t) - k + 1))
        assert {tuple(r.words): r.f for r in level.collect()} == {p: n for p, n in want.items() if n >= 2}
        ids = sorted(r.id for r in level.collect())
        assert ids == list(range(len(ids)))
    assert levels[1].count() > 1000
    assert spark.read.parquet(f"{scratch.base}/sums2").count() <= (4 + 1) * phrases.BUCKETS < 1000


def test_pairs_are_coded_one_to_one():
    for known in (0, 1, 2, 3, 1000, 60_000, (1 << 31) - 1):
        pid, sid = np.random.default_rng(known).integers(0, max(known, 1), (2, 5000))
        back = phrases._decoded(phrases._code(pid, sid, known), known)
        assert (back[0] == pid).all() and (back[1] == sid).all()
