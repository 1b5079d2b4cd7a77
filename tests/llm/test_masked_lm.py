import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import masked_lm as m


def corpus(n=200):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        words = []
        while len(words) < 60:  # every second word is decided by its neighbours
            a, b = rng.randrange(8), rng.randrange(8)
            words += [f"a{a}", f"m{(a + b) % 8}", f"b{b}", "the"]
        rows.append((k, " ".join(words), "x"))
    return rows


def test_scores_equal_a_plain_evaluation_and_beat_frequencies(spark):
    rows = corpus() + [(500, " ".join(random.Random(3).sample(corpus(1)[0][1].split(), 60)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in m.scores(docs).collect()}
    known = m.vocabulary(docs)
    network = m.train(docs, known)
    for k, text, _ in rows[:20]:
        ids, at, counts = known.padded([text])
        assert counts.tolist() == [len(text.split())] == [got[k].n_tokens]
        total = 0.0
        for t in at:
            h = np.tanh(sum(network.parts[0][i][ids[t + p]] for i, p in enumerate(m.PLACES)) + network.parts[1])
            c, w = divmod(int(ids[t]), m.OF_CLASS)
            p1, p2 = h @ network.parts[2] + network.parts[3], h @ network.parts[4][c] + network.parts[5][c]
            total += p1[c] - np.logaddexp.reduce(p1) + p2[w] - np.logaddexp.reduce(p2) - known.share[ids[t]]
        assert got[k].log_likelihood == pytest.approx(total, rel=1e-3)
    ids, at, _ = known.padded([t for _, t, _ in rows[:200]])
    assert network.log_probabilities(ids, at).mean() > known.log_frequency[ids[at]].mean() + 0.05
    assert got[500].mean_log_probability < np.mean([got[k].mean_log_probability for k in range(200)])


def test_gradient_is_the_slope():
    rng = np.random.default_rng(2)
    known = m.Vocabulary([(k, 10) for k in range(40)], {})
    network = m.Network.first(known)
    ids = np.concatenate([[m.SIZE] * 2, rng.integers(0, 60, 80), [m.SIZE] * 2])
    at = np.flatnonzero(ids < m.SIZE)
    grad = network.gradient(ids, at)
    for k in [*np.argsort(-np.abs(grad))[:5].tolist(), 3, 40000]:
        ends = []
        for e in (1e-2, -1e-2):
            flat = network.flat.copy()
            flat[k] += e
            ends.append(-m.Network(flat).log_probabilities(ids, at).astype(float).mean())
        assert grad[k] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-4)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", None), (2, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = m.scores(docs).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 3, 3]
    assert {(r.log_likelihood, r.mean_log_probability) for r in got if r.doc_id in (2, 3)} == {(0.0, None)}
    assert m.scores(docs.limit(0)).count() == 0


def test_rare_words_are_scored_by_their_own_counts(spark):
    rng = random.Random(4)
    often = [f"f{k}" for k in range(800)]
    rows = [(k, " ".join(rng.sample(often, 400)), "x") for k in range(20)]
    rows += [(100 + k, " ".join(f"r{k}_{i}" for i in range(60) for _ in range(1 + i % 3)), "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in m.scores(docs).collect()}
    known = m.vocabulary(docs)
    network = m.train(docs, known)
    n, held, buckets = Counter(), {}, Counter()
    for _, text, _ in rows:
        n.update(text.split())
    for w, k in n.items():
        b = int(known.ids(m.words.of_text(w))[0])
        held[w] = b
        if b >= known.n_frequent:
            buckets[b] += k
    assert max(n[w] for w, b in held.items() if b >= known.n_frequent) > 1
    for k, text, _ in rows:
        ids, at, counts, _ = known.framed([text])
        total = network.log_probabilities(ids, at).astype(float).sum()
        total += sum(np.log(n[w] / buckets[held[w]]) for w in text.split() if held[w] in buckets)
        assert counts.tolist() == [got[k].n_tokens] and got[k].log_likelihood == pytest.approx(total, rel=1e-4)


def test_the_model_follows_the_number_of_words():
    assert m.side(25) == m.CLASSES < m.side(4_000_000) < m.side(100_000_000)
    sizes = [m.Network.length(m.side(v) ** 2) for v in (10**5, 10**6, 10**7, 10**8)]
    assert sizes == sorted(set(sizes))
