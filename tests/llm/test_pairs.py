"""Joins and searches against brute force, with copies, ties, nulls and hot groups."""

import random

import numpy as np
import pytest

from pricetide.llm import hnsw, lm_score, ngram_join, topk
from pricetide.llm.common import Scratch, components

# --------------------------------------------------------------------------- components


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    pairs += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(3000, 3001)]
    pairs = [(min(p), max(p)) for p in pairs]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.id: r.component for r in components(spark, links, Scratch(spark, "test"), "c").collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {2000 + i: 2000 for i in range(50)}
    assert got == want | {3000: 3000, 3001: 3000}
    assert components(spark, links.where("false"), Scratch(spark, "test"), "c").collect() == []


# --------------------------------------------------------------------------- n-gram join


def _grams(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    base = [word() for _ in range(100)]
    for _ in range(150):                      # a large group of near copies, all texts different
        near = list(base)
        near[rng.randrange(100)] = word()
        docs.append(" ".join(near))
    docs += [docs[3]] * 40 + [docs[70].upper()] + ["", None, "   ", "one two", "one  two", "one two three"]
    docs += ["long " + " ".join(word() for _ in range(30_000))] * 2
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(1000 + i, docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [16, 128])
def test_ngram_join_finds_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = _corpus()
    sets = {d: _grams(t) for d, t in docs}
    links = [(a, b) for i, (a, _) in enumerate(docs) for b, _ in docs[i + 1:]
             if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    counts = {d: sum(d in p for p in links) for d in sets}
    group = _groups(sets, links)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(None, "one two", "x", 1)],
                               "doc_id bigint, text string, bands string, size int")
    got = ngram_join.join(spark, df).collect()
    assert len(got) == len(docs) + 1
    assert {r.doc_id: (r.n_links, r.class_id, r.kept) for r in got if r.doc_id is not None} == {
        d: (counts[d], group[d], group[d] == d) for d in sets}
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 0, None, True)]
    stay = ngram_join.one_of_each(spark, df)
    assert stay.columns == df.columns
    ids = sorted((r.doc_id for r in stay.collect()), key=lambda i: (i is not None, i))
    assert ids == [None] + sorted(d for d in sets if group[d] == d)


def test_ngram_join_of_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (3, "z")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in ngram_join.join(spark, df).collect())
    assert got == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False), (3, 0, 3, True)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(spark, df).collect()) == [1, 3]
    assert ngram_join.join(spark, df.where("false")).collect() == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.7, 0.99), (0.9, 0.99)):
        bands, rows = ngram_join.bands_for(threshold, recall)
        assert bands * rows <= ngram_join.HASHES and 1 - (1 - threshold ** rows) ** bands >= recall


def test_shared_counts_both_ways():
    rng = np.random.default_rng(2)
    for width in (50, 4_000_000):
        sets = [np.unique(rng.integers(0, width, 300)).astype(np.uint64) for _ in range(12)]
        left, right = np.triu_indices(12, 1)
        want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(left, right)]
        assert ngram_join.shared_counts(sets, left, right).tolist() == want


# --------------------------------------------------------------------------- top-k


@pytest.mark.parametrize("step", [7, 512])
def test_topk_equals_brute_force(spark, step):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 6), 1)]) for i in range(300)]      # many ties
    rows += [(i, rows[0][1]) for i in range(300, 330)] + [(i, [0.5]) for i in range(330, 340)]
    odd = [(400, None), (420, [1.0, None]), (440, [float("nan")]), (460, [float("inf"), 1.0]), (None, [1.0]), (480, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:5] + odd], "vec_id bigint, embedding array<float>, rank int")
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows} | {480: []}
    want = {}
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:20]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scored)}
    got = topk.search(spark, df, step=step).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_terms_of_few_vectors_become_non_essential(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True))
    x[1:60] = x[0] + rng.integers(-2, 3, (59, 64))
    splits, plain = [], topk.non_essential
    monkeypatch.setattr(topk, "non_essential", lambda total, goal: splits.append(plain(total, goal)) or splits[-1])
    step = topk.size_of_shards(500) // topk.BLOCKS
    cuts, postings = range(0, 500, step), np.ascontiguousarray(x.T)
    high = np.stack([postings[:, c:c + step].max(1) for c in cuts], 1)
    low = np.stack([postings[:, c:c + step].min(1) for c in cuts], 1)
    score, who = topk.best(x[0], 0, np.arange(500), postings, high, low, 20, step)
    want = sorted((-int(x[0] @ x[c]), c) for c in range(1, 500))[:20]
    assert [(-int(s), int(w)) for s, w in zip(score, who)] == want
    assert len(splits) == 7 and min(splits) > 32                        # more than half of the postings, in every later block


def test_topk_with_large_values_and_few_rows(spark):
    df = spark.createDataFrame([(0, [3.0e7, 1.0]), (1, [3.0e7, -1.0]), (2, [3.0e7, 0.5])], "vec_id bigint, embedding array<float>")
    one = int(64 * 3.0e7)
    assert [tuple(r) for r in topk.search(spark, df).orderBy("rank").collect()] == [
        (0, 1, 2, one * one + 64 * 32), (0, 2, 1, one * one - 64 * 64)]
    assert topk.search(spark, df.where("false")).collect() == []


# --------------------------------------------------------------------------- vectors


def _clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims))
    x = centers[rng.integers(0, 8, n)] + 0.9 * rng.normal(size=(n, dims))
    for k in range(0, n // 3, 2):                     # pairs and a dense group
        x[n - 1 - k] = x[k] + 0.1 * rng.normal(size=dims)
    x[n // 2:n // 2 + n // 8] = x[n // 2] + 0.1 * rng.normal(size=(n // 8, dims))
    return x


def test_graph_recall_on_a_shard():
    x = _clustered(3000, 32, 1)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.build(unit, np.arange(len(x)))
    near = np.argsort(-(unit[:100] @ unit.T), axis=1)[:, :10]
    found = graph.search(unit[:100], 48)[0][:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near.tolist(), found.tolist())]) >= 0.9
    left, right, _ = hnsw.find(graph, x, x, 0.93)
    want = int((unit.astype(float) @ unit.T.astype(float) >= 0.93).sum())
    assert len(left) >= 0.99 * want


def test_pairs_beside_a_hot_group_are_found():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32))
    x[:1000] = x[0] + 0.05 * rng.normal(size=(1000, 32))          # hundreds of links a vector
    x[3900:] = x[3800:3900] + 0.05 * rng.normal(size=(100, 32))   # 100 pairs
    graph = hnsw.build((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), np.arange(len(x)))
    for layer in graph.layers:                                    # that no other vector leads to
        layer[layer >= 3800] = -1
    graph.entry = int(np.flatnonzero((graph.layers[-1][:3800] >= 0).any(1))[0])
    left, right, _ = hnsw.find(graph, x, x, 0.93)
    pairs = set(zip(left.tolist(), right.tolist()))
    assert sum((i, i + 100) in pairs and (i + 100, i) in pairs for i in range(3800, 3900)) >= 99
    assert len(pairs) == len(left) >= 0.99 * 1000 * 1000


@pytest.mark.parametrize("shard", [40, 8192])
def test_near_duplicates_equal_brute_force(spark, shard):
    x = _clustered(240, 16, 2).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(240)]
    rows += [(300 + i, rows[5][1], 2) for i in range(30)] + [(340, [2 * v for v in rows[5][1]], 2), (341, rows[5][1], None)]
    rows += [(342, None, 1), (343, [0.0] * 16, 1), (344, [1.0, None], 1), (345, [float("nan")] * 16, 1), (346, [1.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, size int")
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v
            and np.isfinite(np.array(v, float)).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
             and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    group = _groups([r[0] for r in rows], links)
    got = hnsw.near_duplicates(spark, df, shard=shard).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (sum(i in p for p in links), group[i], group[i] == i) for i, _, _ in rows}
    assert len(got) == len(rows)


@pytest.mark.parametrize("pairs", [0, 20, 400])
def test_sparse_links_come_from_the_graph(pairs):
    rng = np.random.default_rng(pairs)
    x = rng.normal(size=(6000, 64))
    x[6000 - pairs:] = x[:pairs] + 0.1 * rng.normal(size=(pairs, 64))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    left, right, audits = hnsw.find(hnsw.build(unit, np.arange(len(x))), x, x, 0.93)
    found = {(a, b) for a, b in zip(left.tolist(), right.tolist()) if a < b}
    want = {(i, 6000 - pairs + i) for i in range(pairs)}
    assert found <= want and len(found) >= 0.99 * len(want)
    assert not audits["whole"] and audits["audited"] <= 6000 / 16 and audits["probed"] >= 0.99


def test_audits_are_reported_and_small_labels_use_the_graph(spark, scratch):
    x = np.random.default_rng(3).normal(size=(900, 16))
    x[450:] = x[:450] + 0.05 * np.random.default_rng(4).normal(size=(450, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], "ab"[i % 450 % 2]) for i in range(900)],
                               "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: r.component_id for r in hnsw.near_duplicates(spark, df, shard=300, report=scratch + "/a").collect()}
    assert np.mean([got[i] == i % 450 for i in range(900)]) >= 0.99
    audits = spark.read.parquet(scratch + "/a").collect()
    assert len(audits) == 2 * 4 and not any(r.whole for r in audits)    # two shards a label: each, and both ways
    assert all(r.audited <= -(-r.vectors // 16) and min(r.probed, r.linked) >= 0.99 for r in audits)


def test_near_duplicates_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hnsw.near_duplicates(spark, df).collect() == []


# --------------------------------------------------------------------------- language models


def _plain_scores(rows, target, size, hashes):
    import collections
    import math
    texts = [(t or "").lower().split() for _, t in rows]
    counts = collections.Counter(w for t in texts for w in t)
    known = set(sorted(counts, key=lambda w: (-counts[w], hashes[w]))[:size])

    def model(chosen):
        words, pairs, before, n = collections.Counter(), collections.Counter(), collections.Counter(), 0
        for (doc, _), text in zip(rows, texts):
            last = "<s>"
            for w in text if chosen(doc) else []:
                w = w if w in known else "<u>"
                words[w] += 1
                pairs[last, w] += 1
                before[last] += 1
                last, n = w, n + 1
        return words, pairs, before, n

    background, goal = model(lambda d: True), model(lambda d: d in target)

    def loss(m, text):
        words, pairs, before, n = m
        a = lm_score.ALPHA * (n / goal[3] if goal[3] and n else 1)
        total, last = 0.0, "<s>"
        for w in text:
            w = w if w in known else "<u>"
            p = (words[w] + a) / (n + a * (len(known) + 1))
            total -= math.log(lm_score.LAMBDA * pairs[last, w] / before[last] + (1 - lm_score.LAMBDA) * p
                              if before[last] else p)
            last = w
        return total / len(text) if text else None

    return [(d, len(t), loss(goal, t), loss(background, t)) for (d, _), t in zip(rows, texts)]


@pytest.mark.parametrize("targets", [[2, 4, 6, 8, 8, None], []])
def test_scores_equal_a_plain_program(spark, monkeypatch, targets):
    import pyarrow as pa
    monkeypatch.setattr(lm_score, "PIECE", 300)          # many chunks
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 30)))) for i in range(50)]
    rows += [(50, None), (51, ""), (8, "w1 w2 w3"), (None, "w3 w3"), (53, "W1\tw2\x0bw1"), (54, "w5 " * 5000)]
    each = sorted({w for _, t in rows for w in (t or "").lower().split()})
    hashes = dict(zip(each, lm_score._hashes(pa.array(each))[0].tolist()))
    want = _plain_scores(rows, {t for t in targets if t is not None}, 20, hashes)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    got = lm_score.score(spark, df, spark.createDataFrame([(t,) for t in targets], "doc_id bigint"), size=20).collect()
    flat = lambda rows: sorted([(d is None, d or 0, n, round(a, 9) if n else None, round(b, 9) if n else None)
                                for d, n, a, b in rows], key=repr)
    assert flat([(r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in got]) == flat(want)
    assert all(r.score is None if not r.n_words else abs(r.score - r.target_loss + r.background_loss) < 1e-12 for r in got)


def test_every_word_is_told_apart(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(70_000)] * 2            # more words than 16 bits number, none of them rare
    rng.shuffle(names)
    rows = [(i, " ".join(names[i * 1400:(i + 1) * 1400])) for i in range(100)]
    want = _plain_scores(rows, set(range(10)), None, dict.fromkeys(names, 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_score.score(spark, df, df.select("doc_id").where("doc_id < 10")).collect()}
    for doc, n, target, background in want:
        assert got[doc].n_words == n
        assert abs(got[doc].target_loss - target) < 1e-9 and abs(got[doc].background_loss - background) < 1e-9


def test_chunks_write_only_to_buckets_of_their_keys():
    rng = np.random.default_rng(8)

    def messages(chunks, buckets):
        sent = 0
        for _ in range(chunks):
            ids = rng.integers(0, 30, 60)
            words = np.sort(rng.integers(1, 1 << 62, 30, dtype=np.uint64))
            own = lm_score._Chunk({"sizes": [40, 20], "words": lm_score._packed(words, True), "ids": lm_score._packed(ids)})
            order, held, first = own.by_bucket(buckets)
            parts = np.split(own.keys[order], first[1:])
            assert len(parts) == len(held) <= len(own.keys) and all(len(p) for p in parts)
            assert all(((p >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) == b).all() for p, b in zip(parts, held))
            sent += len(held)
        return sent

    few, many = messages(20, 1_000), messages(80, 4_000)         # four times the text, so four times the buckets
    assert many < 4.8 * few


def test_scores_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm_score.score(spark, df, df.select("doc_id")).collect() == []
