"""Token ids of texts against the tokenizers library, and what of them is kept."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardenry.llm import common

VOCABULARY = common.public_vocabulary("byte_bpe_50k.json")
PARTS = ["a", "foo", "Bar", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "...", "'s", "é", "×", "÷", "ÿ", "²", "日本", "\xa0", "　", "\x00", "\x1c", "\x85", "3.14", "<|endoftext|>", "-", "😀", "ſ", "the", "x" * 70]


class Counting:
    """An encoder that counts the words it is given."""

    def __init__(self, encoder):
        self.encoder, self.words = encoder, 0

    def encode_batch_fast(self, texts, **more):
        self.words += sum(len(t.split()) for t in texts)
        return self.encoder.encode_batch_fast(texts, **more)


@pytest.mark.parametrize(("limit", "characters"), [(24 << 20, 8 << 20), (3000, 50), (0, 5)])
def test_ids_are_the_librarys(monkeypatch, limit, characters):
    """With everything kept, little and nothing; texts in many cuts and in one."""
    monkeypatch.setattr(common.TokenBytes, "LIMIT", limit)
    monkeypatch.setattr(common, "_SLICE", characters)
    tokens, whole, pick = common.TokenBytes(VOCABULARY, "<u2"), Tokenizer.from_file(VOCABULARY), random.Random(5)
    whole.encode_special_tokens = True
    for texts in [[], [None], [""], ["."], [",", None, "a."], *([pick.choice([None, "".join(pick.choices(PARTS, k=pick.randrange(12)))]) for _ in range(20)] for _ in range(100))]:
        want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert tokens.of_all(pa.array(["before", *texts], pa.string()).slice(1)) == want


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])  # of op9 and op7
def test_words_of_many_batches_are_encoded_once(dtype):
    tokens = common.TokenBytes(VOCABULARY, dtype)
    tokens.encoder = counting = Counting(tokens.encoder)
    batches = [pa.array([" ".join(f"w{i}" for i in range(k, k + 50_000))]) for k in range(0, 300_000, 50_000)]
    first = [tokens.of_all(b) for b in batches]
    assert counting.words == 300_000
    assert [tokens.of_all(b) for b in batches] == first
    assert counting.words <= 300_000 + 10


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(common.TokenBytes, "LIMIT", 200_000)
    tokens = common.TokenBytes(VOCABULARY)
    tokens.encoder = counting = Counting(tokens.encoder)
    for k in range(40):
        tokens.of_all(pa.array(["x often met " + " ".join(f"v{i}" for i in range(1000 * k, 1000 * k + 1000)) + " " + "long" * 1000]))
        assert tokens.old.costs().sum() <= 200_000 and tokens.fresh.costs().sum() <= 25_000
    counting.words = 0
    tokens.of_all(pa.array(["x often met"]))
    assert counting.words == 0


def test_one_text_of_very_many_words(monkeypatch):
    monkeypatch.setattr(common.TokenBytes, "LIMIT", 200_000)
    tokens = common.TokenBytes(VOCABULARY)
    tokens.of_all(pa.array([" ".join(f"w{i}" for i in range(50_000))]))
    assert 0 < tokens.old.costs().sum() <= 200_000
