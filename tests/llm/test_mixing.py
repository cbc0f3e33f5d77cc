"""Mixing against a plain program, and its edge cases."""

import math
import re

import pytest

from pricetide.llm import mixing

ROWS = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "d " * 500, "x"), (4, "d " * 500, "x"), (5, "e f\x0bg", None),
        (None, "h i", "y"), (7, "j k l", "ü"), *[(10 + i, "w " * (i % 9 + 1), "xyzü"[i % 4]) for i in range(200)]]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 5, "extra") for r in rows],
                                 "doc_id bigint, text string, source string, size int, bucket string")


def water_fill(sizes, weights, most):
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **share}
        capped |= over


@pytest.mark.parametrize("weights,most", [((5.0, 2.0, 1.0), 3.0), ((1000.0, 1.0), 3.0), ((1.0,), 1.0)])
def test_targets_and_takes(spark, weights, most):
    got = mixing.mix(spark, frame(spark), weights=weights, max_epochs=most).collect()
    assert len(got) == len(ROWS)
    sizes, largest = {}, {}
    for _, text, source in ROWS:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water_fill(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, most)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken == r.size * r.times and r.taken <= most * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]      # copies with one key stand together
    again = mixing.mix(spark, frame(spark).repartition(7), weights=weights, max_epochs=most).collect()
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_quality_draws_documents_forward(spark):
    rows = [(i, "a b c d", "s" if i % 2 else "t") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "*", "CASE WHEN doc_id < 2000 THEN 8.0 ELSE 1.0 END AS worth")
    got = mixing.mix(spark, df, weights=(3.0, 1.0), quality="worth").where("source = 't'").collect()
    good = sum(r.times for r in got if r.doc_id < 2000)
    bad = sum(r.times for r in got if r.doc_id >= 2000)
    assert good > 3 * bad


def test_repeated_rows_carry_all_columns(spark):
    df = frame(spark)
    times = {}
    for r in mixing.mix(spark, df).collect():
        times.setdefault(r.doc_id, []).append(r.times)
    got = mixing.repeated(spark, df)
    assert got.columns == df.columns
    counts = {}
    for r in got.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {d: min(t) * len(t) for d, t in times.items() if min(t) > 0}


def test_empty_table(spark):
    empty = frame(spark).where("false")
    assert mixing.mix(spark, empty).collect() == [] and mixing.repeated(spark, empty).collect() == []
