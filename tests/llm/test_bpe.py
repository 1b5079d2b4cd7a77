import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from factloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        own = bpe.encoder_for(f.read(), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}
    )


def test_random_texts_and_white_space(both):
    own, other = both
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "ll", "é", "日本", "1", "23", "!", "\x1c", "\x85", "　", "🙂", "the", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [other.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in got] == texts


def test_long_pre_tokens(both):
    own, other = both
    rng = random.Random(2)
    for text in ("a" * 20_000, "".join(rng.choice("abcdethng") for _ in range(20_000))):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == other.encode_ordinary(text)


def test_frames(spark, both):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "x"), (2, None, None), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    want = both[1].encode_ordinary("Hello wörld")
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in out) == [
        (0, [], b""), (1, want, "Hello wörld".encode()), (1, want, "Hello wörld".encode()), (2, [], b""),
    ]
    digests = bpe.digest(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r.n_tokens for r in digests if r.doc_id == 1} == {len(want)}
    assert {r.decoded_sha256 for r in digests if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
