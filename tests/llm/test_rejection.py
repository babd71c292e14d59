"""Hashing and averaging against plain loops; texts of no language are rejected, clean ones stay."""

from __future__ import annotations

import random

import numpy as np
import pytest
from chronofold.llm import langid

from tests.llm.test_text_operators import DOCS, WORDS, prose

M = 1 << 32


def plain_logits(m, text):
    data = b" " + b" ".join(bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in text.lower().encode()).split()) + b" "
    total, n = np.zeros(len(m.bias)), 0
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            h = data[i]
            for c in data[i + 1 : i + size]:
                h = (h * 0x01000193 + c) % M
            total += m.table[(((h ^ (size * 0x9E3779B1 % M)) * 0x85EBCA6B) % M) >> 16]
            n += 1
    return total / max(n, 1) + m.bias


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(lang, prose(lang, rng, rng.randint(5, 60))) for lang in WORDS for _ in range(120)]
    return langid.train([t for _, t in rows], [lang for lang, _ in rows])


@pytest.mark.parametrize("text", ["The cat, 12 é!", "a", "über " * 900, "ab\ncd"])
def test_logits_are_the_mean_of_the_ngrams(model, text, monkeypatch):
    want = plain_logits(model, text)
    assert np.allclose(model.logits(text), want, atol=1e-5)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    assert np.allclose(model.logits(text), want, atol=1e-5)


def junk(rng):
    letters = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 9))) for _ in range(n))
    return [letters("bcdfghjklmnpqrstvwxz", 40), letters("абвгдежзиклмнопрстуфхцчшщ", 40), letters("漢字仮名交文", 40), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40)]


def test_texts_of_no_language_are_rejected(model):
    rng = random.Random(9)
    texts = [t for _ in range(25) for t in junk(rng)]
    assert np.mean([model.predict(t)[2] for t in texts]) <= 0.03
    clean = [prose(lang, rng, n) for lang in WORDS for n in (6, 20, 200) for _ in range(30)]
    assert np.mean([model.predict(t)[2] for t in clean]) >= 0.97


def test_the_stage_drops_planted_junk(spark):
    rng = random.Random(5)
    rows = [(i, prose(lang, rng, 30), lang, "s", 1) for i, lang in enumerate(list(WORDS) * 90)]
    rows += [(1000 + i, t, "en" if i == 0 else None, "s", 1) for i, t in enumerate(t for _ in range(3) for t in junk(rng))]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in langid.keep_accepted(df, langid.fit(df, languages=5, sample_chars=150)).collect()}
    assert len([i for i in kept if i < 1000]) >= 265 and len([i for i in kept if i >= 1000]) <= 1


def test_the_sample_is_bounded(spark):
    rng = random.Random(6)
    rows = [(i, prose("en", rng, 300), "en" if i % 2 else f"x{i}", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    seen = {}
    keep = langid.train
    try:
        langid.train = lambda texts, labels, **k: seen.update(texts=texts, labels=labels) or keep([], [])
        langid.fit(df, per_language=50, languages=3, sample_chars=100)
    finally:
        langid.train = keep
    assert len(set(seen["labels"])) <= 3 and seen["labels"].count("en") < 90 and {len(t) for t in seen["texts"]} == {100}
