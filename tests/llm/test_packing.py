import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparrowhawk.llm import packing as P

from .helpers import EDGE, documents, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, tokenizer, got, sequence):
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), sequence)):
            part = ids[s : s + sequence]
            want[(doc, n, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in placed.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= sequence
    return len(placed), sum(r["length"] for r in got)


def test_contract(spark, tokenizer):
    rng = random.Random(8)
    rows = EDGE + [(100 + i, sentence(rng.choice([1, 5, 50, 300, 900]), i)) for i in range(150)]
    got = P.pack(documents(spark, rows), PATH, 512).collect()
    n, total = check(rows, tokenizer, got, 512)
    assert -(-total // 512) <= n <= sum(k for _, k in P.best_fit(Counter(r["length"] for r in got), 512))


def test_empty(spark):
    assert P.pack(documents(spark, [(1, "x")]).where("false"), PATH).count() == 0


@pytest.mark.parametrize("text", ["It's DON'T we'll 'S", "a_b c-d 123 ½ ²", "<|endoftext|> x", "ÀÉÎ õ ß ſ İ ŉ", "e\u0301 \u212a", "a\x1cb\x85c\xa0d\u2028e", "字 ☃ 🙂", "!!!'s ''' ", "x" * 3000, "\x00\x01 \x7f", " ", "", "ªº µ"])
def test_word_encoder_is_exact(tokenizer, text):
    e = P.WordEncoder(PATH, words=5)
    for _ in range(2):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder_on_any_text(text):
    e, t = P.encoder_of(PATH), Tokenizer.from_file(PATH) if not hasattr(test_word_encoder_on_any_text, "t") else test_word_encoder_on_any_text.t
    test_word_encoder_on_any_text.t = t
    assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_plan_holds_exactly_the_pieces(histogram):
    plan, bound = P.pack_histogram(histogram, 64)
    held = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(x * a for x, a in pattern) <= 64
        for x, a in pattern:
            held[x] += a * n
    assert held == Counter(histogram)
    assert sum(n for _, n in plan) >= bound - 1e-6


@pytest.mark.parametrize("scale", [1, 1000])
def test_few_sequences(scale):
    rng = random.Random(1)
    histogram = {k: v * scale for k, v in Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)).items()}
    plan, bound = P.pack_histogram(histogram)
    used = sum(n for _, n in plan)
    assert used <= bound * 1.005 + 1
    assert used <= sum(n for _, n in P.best_fit(histogram, 4096)) * 1.002 + 1


def test_small_programs_are_solved():
    """Three lengths whose best packing mixes them; the program's bound is met."""
    assert sum(n for _, n in P.pack_histogram({60: 100, 40: 100}, 100)[0]) == 100
    assert sum(n for _, n in P.pack_histogram({50: 30, 30: 30, 20: 30}, 100)[0]) == 30
