import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.booleans())
def test_round_trip(values, small):
    ids = np.array([v % 1000 if small and k % 17 else v for k, v in enumerate(values)], np.uint32)
    data = tf.pack(ids)
    assert tf.unpack(data).tolist() == ids.tolist()
    assert tf.unpack(data, 1, 2).tolist() == ids[256:512].tolist()


def test_encoder_equals_the_library():
    rng = random.Random(4)
    other = Tokenizer.from_file(PATH)
    own = tf.Encoder(open(PATH, "rb").read())
    parts = ["a", "B", " ", "\n", "'s", "'LL", "É", "ß", "İ", "日本", "12", "!?", "\x1c", "\x85", "　", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "<|endoftext|", "ſ", "the", "K", "½", "²", "​", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    want = [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_files(spark, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_IDS", 50)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["one", "two", "Three!", "é"]) for _ in range(rng.randint(0, 40))), "x") for k in range(60)]
    rows += [(7, rows[7][1], "x"), (61, None, None), (None, "last", "y")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = tf.write_token_files(docs, PATH, 2)
    got = sorted(tf.digests(path, spark, "bigint").collect(), key=lambda r: (r.start, r.n_tokens))
    other = Tokenizer.from_file(PATH)
    at = 0
    for (key, text, _), r in zip(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), got, strict=True):
        ids = [*other.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.key, r.start, r.n_tokens) == (key, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    lists = {r.key: r.ids for r in tf.read_token_files(spark.read.parquet(path), "bigint").collect()}
    assert lists[61] == [2] and len(lists) == 62
    empty = tf.write_token_files(docs.limit(0), PATH, 2)
    assert tf.digests(empty, spark, "bigint").count() == 0


def test_tables_grow_and_start_anew(monkeypatch):
    monkeypatch.setattr(tf, "CACHE_ENTRIES", 16)
    other, own, rng = Tokenizer.from_file(PATH), tf.Encoder(open(PATH, "rb").read()), random.Random(6)
    for n in (5, 40, 400, 3, 2000):
        texts = [" ".join(rng.choice(["the", "aé", "xy!"]) + str(rng.randint(0, n)) for _ in range(n)) for _ in range(3)]
        want = [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
