"""Packing and the token files, against the tokenizers library used plainly."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricetide.llm import huffman, packing
from pricetide.llm.common import Encoder, Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Σίσυφος ΣΑΣ", "été ÉTÉ", "<|endoftext|> a<|endoftext|>b <|STARTOFTEXT|>", "don't it's I'LL 've", "½ x² ①a",
       "​word next ", "İstanbul", "a.,b ... ,,. a.. b,.", "中文 字。 あ", "\x85x\x1cy z\x0bq", "", "   ",
       "ﬁ ﬀ ǅ ᾼ", "اَب क्ष", "_a_ 1a2 3.4, x.", "\U0001F600 hi\U0001F600.", "K ſecret", "≠ á."]
DOCS = [(1, "One two three."), (2, None), (3, ""), (4, "word " * 9000), (4, "One two three."), (None, "null id, twice"),
        (None, "null id, twice"), (9, "x" * 5000), *[(20 + i, "some words " * (i % 7 + 1)) for i in range(40)]]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def frame(spark, rows=DOCS):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "keep", 7) for r in rows],
                                 "doc_id bigint, text string, part string, n int")


def test_encoder_equals_library(tokenizer):
    ids, begin = Encoder(PATH)(pa.array(ODD + [None]))
    for i, text in enumerate(ODD):
        assert ids[begin[i]:begin[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert begin[-1] == begin[-2] == len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_equals_library_on_any_text(texts):
    tokenizer = Tokenizer.from_file(PATH)
    ids, begin = Encoder(PATH)(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[begin[i]:begin[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_places_every_piece(spark, tokenizer, capacity):
    got = packing.pack(spark, frame(spark), PATH, capacity=capacity, with_ids=True).collect()
    want = []
    for doc, text in DOCS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc, k, k * capacity, len(p), _crc(p)) for k, p in
                 enumerate(ids[i:i + capacity] for i in range(0, len(ids), capacity))]
    rows = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= -(-sum(r.length for r in got) // capacity) + 2


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark, frame(spark, DOCS[:1]).where("false"), PATH).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=41, max_size=41))
def test_plan_holds_exactly_the_histogram(counts):
    counts = np.array([0, *counts[1:]])
    plan, capacity = packing.plan(counts, 40), 40
    held = np.zeros(41, int)
    for chosen, n in plan:
        assert n > 0 and sum(chosen) <= capacity
        for length in chosen:
            held[length] += n
    assert (held == counts).all()
    lower = -(-int((counts * np.arange(41)).sum()) // capacity)
    lower = max(lower, int(counts[21:].sum()))
    assert sum(n for _, n in plan) <= lower * 1.1 + 2


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(6.3, 0.9, 20_000).astype(int), 1, 2048), minlength=2049)
    lower = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in packing.plan(counts)) <= lower * 1.002 + 1


def test_best_configuration_is_the_best_knapsack():
    rng = np.random.default_rng(0)
    for _ in range(20):
        value = np.zeros(13)
        value[rng.integers(1, 13, 4)] = rng.random(4)
        best = [0.0] * 13
        for room in range(1, 13):
            best[room] = max([best[room - 1], *(best[room - n] + value[n] for n in range(1, room + 1))])
        chosen = packing.best_configuration(value, 12)
        assert sum(chosen) <= 12 and abs(sum(value[chosen]) - best[12]) < 1e-12


# --------------------------------------------------------------------------- Huffman files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=900), st.integers(6, 20))
def test_code_round_trip(ids, longest):
    ids = np.array(ids)
    bits = huffman.code_lengths(np.bincount(ids, minlength=61), longest)
    assert bits.max() <= longest and (2.0 ** -bits[bits > 0]).sum() <= 1
    payload, checkpoints = huffman.encode(ids, bits, huffman.canonical(bits)[1])
    assert len(payload) == (bits[ids].sum() + 7) // 8
    assert (huffman.Decoder(bits)(payload, checkpoints, len(ids)) == ids).all()


def test_code_is_optimal_where_the_limit_does_not_bind():
    import heapq
    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1])
    heap = counts.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (huffman.code_lengths(counts, 18) * counts).sum() == cost


def test_crc_of_joined_parts():
    a, b = b"hello" * 9, b"world" * 1001
    assert huffman.crc32_after(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [50, 1 << 18])
def test_files_round_trip(spark, tokenizer, monkeypatch, block):
    monkeypatch.setattr(huffman, "BLOCK", block)
    monkeypatch.setattr(huffman, "RANGE_IDS", 3000)
    folder = f"{Scratch(spark, 'test').base}/corpus"
    huffman.write_ids(spark, frame(spark), PATH, folder)
    rows = sorted(((d is not None, d or 0), t or "") for d, t in DOCS)
    got = sorted(huffman.digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for (_, d), _ in rows][:0] + [None, None] + [d for (k, d), _ in rows if k]
    at, held = 0, {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        held.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    want = {}
    for doc, text in DOCS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(doc, []).append((len(ids), _crc(ids)))
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in want.items()}
    runs = huffman.read_ids(spark, folder, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.crc32 for r in runs)


def test_files_of_an_empty_table(spark):
    folder = f"{Scratch(spark, 'test').base}/corpus"
    huffman.write_ids(spark, frame(spark, DOCS[:1]).where("false"), PATH, folder)
    assert huffman.digests(spark, folder).collect() == []
