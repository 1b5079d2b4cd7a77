import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return tc.counter_for(f.read(), tc.class_table().tobytes()), Tokenizer.from_file(PATH)


def _library(other, texts):
    return [len(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "'r", "'ve", "'l", "ll", "e", "é", "日本", "1", "²", "!", "\x1c", "\x85", "　",
         "🙂", "the", "\0", "<|endoftext|>", "<|endof", "ing", "'re", "'RE", "ſ", "ǅ", "̀", " 't", "-" * 40]


def test_mixed_texts(both):
    own, other = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert own.count(texts).tolist() == _library(other, texts)
    assert own.count([]).tolist() == []
    assert own.count(["", " ", "<|endoftext|><|endoftext|>"]).tolist() == [0, 1, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(both, texts):
    own, other = both
    assert own.count(texts).tolist() == _library(other, texts)


def test_long_pieces_and_texts(both):
    own, other = both
    rng = random.Random(2)
    texts = ["a" * 30_000, "".join(rng.choice("abcdethng") for _ in range(30_000)), " " * 5_000 + "x" + "\n" * 3_000,
             " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 12))) for _ in range(20_000))]
    assert own.count(texts).tolist() == _library(other, texts)


def test_every_token_and_all_byte_pairs(both):
    own, other = both
    texts = [t for t in (other.decode([k]) for k in range(50256)) if "�" not in t]
    texts += [chr(a) + chr(b) for a in range(0x20, 0x7F) for b in range(0x20, 0x7F)]
    assert own.count(texts).tolist() == _library(other, texts)


def test_states_start_anew(both, monkeypatch):
    own, other = both
    monkeypatch.setattr(tc, "MAX_STATES", 50)
    rng = random.Random(3)
    for _ in range(4):
        texts = ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(50)]
        assert own.count(texts).tolist() == _library(other, texts)


def test_chunks_meet_anywhere(both, monkeypatch):
    own, other = both
    texts = ["it's we're  they'll \n\n 'r 'v x'd"] * 5
    for size in (1, 2, 3, 5, 64):
        monkeypatch.setattr(tc, "CHUNK", size)
        assert own.count(texts).tolist() == _library(other, texts)


def test_frames(spark, both):
    rows = [(1, "Hello wörld", 7), (1, "Hello wörld", 8), (2, None, 9), (None, "", 1), (3, "a<|endoftext|>b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = tc.token_counts(docs, PATH, 3).collect()
    n = _library(both[1], ["Hello wörld"])[0]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [
        (0, 0, 0, False), (1, 12, n, n > 3), (1, 12, n, n > 3), (2, 0, 0, False), (3, 15, 3, False),
    ]
    assert tc.token_counts(docs.limit(0), PATH, 3).count() == 0


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        tc.Counter(f.read(), b"")
