"""Quality by compression, importance resampling, phrases: against plain programs, and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pricetide.llm import phrases, quality, resample

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, "en", "x"), (2, "", None, "x"), (3, "Alpha beta. Alpha beta, alpha beta! gamma", "en", "x"),
       (3, "Alpha beta. Alpha beta, alpha beta! gamma", "en", "x"), (None, "alpha beta", "en", "x"), (5, "é à É " * 50, "fr", "x"),
       (6, "w" * 300_000 + " alpha beta", "en", "x"), (7, "alpha beta gamma delta " * 20_000, "en", "x"), (8, " \t\n.,;", "und", "x")]
SCHEMA = "doc_id bigint, text string, lang string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("score", "rank")


# --------------------------------------------------------------------------- quality

def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.classify(spark, docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got["doc_id"], got["held_out"]))
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    known = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    place = known["score"].rank()
    good = known["quality"] == 1
    area = (place[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.9 and (known["predicted"] == known["quality"]).mean() > 0.9


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(quality.held_out(labels["doc_id"])).unionByName(
        labels.where(~quality.held_out(labels["doc_id"])))
    one, two = (quality.classify(spark, docs, x).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (labels, turned))
    assert (one == two).all()


def test_difference_counts_every_block():
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word("abcde") for _ in range(100)).encode() for _ in range(60)]
    bad = ["".join(word("#$%&") for _ in range(100)).encode() for _ in range(60)]
    model = quality.fit(good, bad, 1.0)
    differ = quality.Difference(model.good, model.bad)
    text = good[0] * 20 + bad[0] * 5
    plain = 0
    for at in range(0, len(text), quality.BLOCK):
        block = text[at:at + quality.BLOCK]
        plain += len(quality._compressor(model.bad).compress(block)) - len(quality._compressor(model.good).compress(block))
    assert differ(text) == plain / len(text) and differ(b"") == 0
    scores = model.score(np.array([differ(x) for x in good + bad]))
    assert scores[:60].min() > 0.5 > scores[60:].max()


def test_quality_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(3, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    got = quality.classify(spark, odd, labels).collect()
    assert len(got) == len(ODD) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and all(r.difference == 0 for r in got if r.doc_id in (1, 2))
    one_class = quality.classify(spark, odd, labels.where("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1 and 0.5 < one_class[0].score < 1
    assert quality.classify(spark, odd.where("false"), labels).collect() == []
    assert len(quality.classify(spark, odd, labels.where("false")).collect()) == len(ODD)


# --------------------------------------------------------------------------- resampling

def test_checksums_equal_crc32():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    spans = [(s, s + n) for n in (1, 2, 3, 5, 63, 64, 65, 127, 128, 129, 640, 641, 5000) for s in rng.sample(range(15_000), 20)]
    start, end = np.array(spans + [(0, 20_000)]).T
    got = resample.checksums(np.frombuffer(data, np.uint8), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]
    assert len(resample.checksums(np.frombuffer(data, np.uint8), start[:0], end[:0])) == 0


def _plain_resample(docs, goal, buckets=10_000):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    listed = lambda w: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in listed(words(t))]
    c, t = (collections.Counter(b for x in texts for b in of(x)) for texts in ([d[1] for d in docs], goal))
    total_c, total_t = sum(c.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_c + buckets) / ((c[b] + 1) * (total_t + buckets))))
    rows = []
    for doc, text, *_ in docs:
        found = of(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words(text))))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[:25 * len(fit) // 100]
    ranks = collections.Counter()
    out = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    ranks.update(r[:4] for r in drawn)
    rest = collections.Counter(r[:4] for r in rows)
    rest.subtract(ranks)
    return sorted(out + [(*r, None) for r, n in rest.items() for _ in range(n)], key=repr)


def test_resampling_equals_a_plain_program(spark, odd):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "délta", "x9", "eps", "zeta"])
    docs = ODD + [(100 + i, " ".join(word() for _ in range(rng.randrange(60))), "en", "x") for i in range(80)]
    goal = ["alpha beta gamma", None, "zeta zeta eps", ""]
    frame = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("score", "rank")
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    got = resample.resample(spark, frame, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _plain_resample(docs, goal)
    assert resample.resample(spark, frame.where("false"), target).collect() == []
    assert sorted((tuple(r) for r in resample.resample(spark, frame, target.where("false")).collect()), key=repr) == _plain_resample(docs, [])


# --------------------------------------------------------------------------- phrases

def _plain_phrases(docs, least):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inside = set()
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            inside.update((lang, p[i:i + k]) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[lang, p[i:i + k]])
    rows = []
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rows.sort()
    first = {}
    return [(r[0], i - first.setdefault(r[0], i) + 1, r[3].decode(), -r[2], *r[4:], -r[1]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("shard", [30, 1 << 20])
def test_phrases_equal_a_plain_program(spark, shard):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "c", "dé", "ß", "e"])
    glue = lambda: rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "])
    docs = [(i, "".join(word() + glue() for _ in range(rng.randrange(40))), rng.choice(["en", "fr", None, "und"]), "x") for i in range(120)]
    docs += ODD[:6] + ODD[8:]
    frame = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("score", "rank")
    got = phrases.collocations(spark, frame, least=4, shard=shard).drop("left", "right").orderBy("lang", "rank").collect()
    assert [tuple(r) for r in got] == _plain_phrases(docs, 4)


def test_phrases_of_odd_tables(spark, odd):
    got = phrases.collocations(spark, odd, least=100, shard=1000).drop("left", "right").orderBy("lang", "rank").collect()
    assert [tuple(r) for r in got] == _plain_phrases(ODD, 100)
    assert phrases.collocations(spark, odd.where("false")).collect() == []
    assert len(phrases.collocations(spark, odd, least=100, top=2).where("lang = 'en'").collect()) == 2


def test_intervals_of_both_directions():
    rng = np.random.default_rng(0)
    seq = np.append(rng.integers(0, 5, 1500), 0).astype(np.int32)
    ways = [phrases.Index(phrases.transform(s, 5)) for s in (seq, seq[::-1])]
    symbol, begin, size = ways[0].words()
    level, held = (begin, begin, size, symbol), {int(s): (int(s),) for s in symbol}
    for k in range(2, 6):
        left = k % 2 == 0
        low, back, size, pid, sid = phrases._extended(ways[not left], left, *level)
        seen = collections.Counter(tuple(seq[i:i + k].tolist()) for i in range(len(seq) - k + 1))
        want = {p: n for p, n in seen.items() if 0 not in p}
        found = {i: held[int(p)] + held[int(s)][-1:] for i, (p, s) in enumerate(zip(pid, sid))}
        assert all(held[int(p)][1:] == held[int(s)][:-1] for p, s in zip(pid, sid))
        assert {found[i]: int(n) for i, n in enumerate(size)} == want
        level, held = (low, back, size, np.arange(len(low))), found
