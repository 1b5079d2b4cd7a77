import random
from difflib import SequenceMatcher

import pytest

from factloom.operators import leakage

WORDS = "order placed refund issued payment failed was not will be the customer on monday shipped parcel late é ß".split()


def _sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _changed(rng, text, share):
    out = []
    for c in text:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(rng.choice("abcxyz ") if r < 2 * share / 3 else c)
        if 1 - r < share / 3:
            out.append(rng.choice("abc"))
    return "".join(out)


def _texts(rng, n):
    base = [_sentence(rng, rng.choice([1, 3, 8, 15, 60])) for _ in range(n // 3)]
    near = [_changed(rng, rng.choice(base), rng.choice([0.05, 0.1, 0.2, 0.3])) for _ in range(n - len(base))]
    return base + near + ["", "", "a", "ab", "🙂 emoji here", "🙂 emoji there"]


@pytest.mark.parametrize("least", [0.8, 0.88, 0.5])
def test_bounds_lose_nothing(least):
    rng = random.Random(1)
    pool = _texts(rng, 150)
    rng.shuffle(pool)
    left, right = pool[:70], pool[70:]
    want = [(i, j, r) for i, a in enumerate(left) for j, b in enumerate(right) if (r := SequenceMatcher(None, a, b).ratio()) >= least]
    assert leakage.similar(left, right, least) == want and want
    assert leakage.similar([], right, least) == [] == leakage.similar(left, [], least)


def test_long_texts():
    rng = random.Random(2)
    text = _sentence(rng, 3_000)
    left, right = [text, _sentence(rng, 3_000)], [text, _changed(rng, text, 0.02), "", _sentence(rng, 2_900)]
    want = [(i, j, r) for i, a in enumerate(left) for j, b in enumerate(right) if (r := SequenceMatcher(None, a, b).ratio()) >= 0.8]
    assert leakage.similar(left, right, 0.8) == want


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_TEXTS", 7)
    rng = random.Random(3)
    pool = _texts(rng, 90)
    rows = [(k, rng.choice(["train", "val", "test"]), rng.choice([t, t.upper()])) for k, t in enumerate(pool + pool[:30])]
    rows += [(900, None, "lost"), (901, "val", None), (902, "other", pool[0])]
    classes = {}
    for k, split, text in rows:
        if split in ("train", "val", "test") and text is not None:
            classes.setdefault((split, text.lower()), []).append(str(k))
    want = set()
    for (s, a), ka in classes.items():
        for (t, b), kb in classes.items():
            if ("train", "val", "test").index(s) < ("train", "val", "test").index(t):
                r = SequenceMatcher(None, a, b).ratio()
                if r >= 0.8:
                    want.add((s, t, min(ka), min(kb), len(ka), len(kb), r, "near" if r >= 0.88 else "borderline"))
    found = leakage.near_leakage(spark.createDataFrame(rows, "k long, split string, text string"), "k")
    assert {tuple(r) for r in found.collect()} == want
    counts = leakage.near_leakage_counts(found).collect()
    assert sum(r.pairs for r in counts) == sum(w[4] * w[5] for w in want) and sum(r.class_pairs for r in counts) == len(want)
    empty = spark.createDataFrame([], "k long, split string, text string")
    assert leakage.near_leakage(empty, "k").count() == 0
