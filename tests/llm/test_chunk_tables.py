"""Tables of chunks and words: what is asked of the tokenizer's model, and that nothing else changes."""

import random

import numpy as np
import pytest

from foliospark.llm import bpe, token_shards
from tests.llm.test_operators import library

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def reference():
    t = library(NAME)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encoder(monkeypatch, slots):
    monkeypatch.setattr(bpe, "SLOTS", slots)
    found = bpe.IdEncoder(bpe.tokenizer_path(NAME), False)
    asked, of_words = [], found.of_words
    found.chunks.make.words = lambda words: asked.extend(words) or of_words(words)
    return found, asked


def test_frequent_chunks_stay_when_a_table_is_full(monkeypatch, reference):
    found, asked = encoder(monkeypatch, 4096)
    often = [f"oft{chr(97 + i)}en" for i in range(20)]
    # each text: the frequent words, and 100 words that are met once; 4,000 of these put several tables aside
    rare = iter("".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q" for i in range(4000))
    for _ in range(40):
        text = " ".join([*often, *(next(rare) for _ in range(100))])
        assert next(found.ids([text])).tolist() == reference(text)
    assert found.chunks.known.aside and found.chunks.make.known.aside
    assert all(asked.count(w) == 1 for w in often)


def test_words_are_asked_for_once_whatever_stands_beside_them(monkeypatch, reference):
    found, asked = encoder(monkeypatch, 1 << 14)
    text = "Straining straining, (STRAINING) straining. straining7 7straining-straining"
    assert next(found.ids([text])).tolist() == reference(text)
    assert asked.count("straining") == 1


@pytest.mark.parametrize("slots", [64, 1 << 12])
def test_plain_and_other_chunks_as_the_library(monkeypatch, slots, reference):
    found, _ = encoder(monkeypatch, slots)
    rng = random.Random(5)
    signs = ["a", "B", "z", "Q", "0", "7", ".", "-", "_", "'s", "'", "'LL", "<", "<|endoftext|>", "\x00", "\x1c", "\x7f", "\x01", "é", "İ", "ß", "語", "́", " ", " ", "\n", "\t"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(600)]
    for text, ids in zip(texts, found.ids(texts), strict=True):
        assert ids.tolist() == reference(text), text


def test_re_pair_with_few_and_many_places():
    rng = np.random.default_rng(7)
    for kinds, n in ((3, 5000), (60, 3000), (400, 200_000)):
        ids = np.append(rng.zipf(1.3, n) % kinds + 2, 1).astype("<u4")
        g = token_shards.compress(ids, 1)
        assert len(g.symbols) < len(ids) and (g.expand(0, len(g.symbols)) == ids).all()
