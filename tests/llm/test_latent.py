import random

from factloom.llm import latent

_rng = random.Random(1)
WORDS = ["".join(_rng.choice("abcdefghij") for _ in range(6)) for _ in range(6000)]


def corpus(n=60):
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    items = [(100 + k, text(rng.randint(15, 50)) + ". " + text(8) + ".") for k in range(12)]
    docs, truth = [], set()
    for k in range(n):
        body = text(rng.randint(0, 300)).split()
        if k % 3 == 0:
            item, words = rng.choice(items)
            words = words.upper().split() if k % 2 else words.split()
            if k % 4 == 0:  # a paraphrase: one word in six is another
                words = [w if rng.random() > 1 / 6 else "other" for w in words]
            at = rng.randint(0, len(body))
            body[at:at] = words
            truth.add((k, item))
        docs.append((k, " ".join(body)))
    return docs, items, truth


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_planted_items_are_found_and_others_not(spark):
    docs, items, truth = corpus()
    d, b = frames(spark, docs, items)
    got = latent.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert len(got) == len(truth)
    kept = {r.doc_id for r in latent.clean(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in truth}


def test_item_in_every_document_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(latent, "ITEMS", 5)
    docs, items, truth = corpus()
    everywhere = (7, " ".join(WORDS[:30]))
    docs = [(k, t + " " + everywhere[1]) for k, t in docs]
    d, b = frames(spark, docs, [*items, everywhere])
    got = {(r.doc_id, r.item_id) for r in latent.contaminated(d, b).collect()}
    assert {(k, 7) for k, _ in docs} <= got and truth <= got


def test_common_subsequence():
    import numpy as np

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randint(1, 8) for _ in range(rng.randint(1, 70))]
        b = [rng.randint(1, 8) for _ in range(rng.randint(0, 70))]
        assert latent.common_subsequence(latent.masks(np.array(a)), b) == plain(a, b)


def test_nulls_empty_and_repeats(spark):
    text = " ".join(WORDS[:40])
    d = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, "y"), (3, "", "z")],
                              "doc_id long, text string, cosine string")
    b = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "!!")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.item_share) for r in latent.contaminated(d, b).collect())
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0)]
    assert latent.clean(d, b).columns == d.columns
    assert {r.doc_id for r in latent.clean(d, b).collect()} == {None, 2, 3}
    assert latent.contaminated(d.limit(0), b).count() == 0
    assert latent.contaminated(d, b.limit(0)).count() == 0


def test_changed_copies_of_an_item_in_every_document(spark):
    docs, items, _ = corpus(100)
    rng = random.Random(5)
    item = WORDS[:36]
    docs = [(k, t + " " + " ".join(w if i % 4 != k % 4 else rng.choice(WORDS) for i, w in enumerate(item))) for k, t in docs]
    d, b = frames(spark, docs, [*items, (7, " ".join(item))])
    got = {(r.doc_id, r.item_id) for r in latent.contaminated(d, b).collect()}
    assert {(k, 7) for k, _ in docs} <= got


def test_matches_that_the_cosine_misses_are_those_of_brute_force(spark, monkeypatch):
    docs, items, truth = corpus()
    d, b = frames(spark, docs, items)
    bench = latent.Benchmark([(k, t, None) for k, t in items])
    monkeypatch.setattr(latent, "LEAST_COSINE", 2.0)
    got = {(r.doc_id, r.item_id) for r in latent.contaminated(d, b).collect()}
    every = set()
    for k, t in docs:
        text = bench.numbers(latent.words.of_text(t, latent.words.BARE))
        for i, item in enumerate(bench.items):
            known = latent.masks(item)
            for start in range(0, len(text), latent.BLOCK):
                window = text[start : start + 5 * latent.BLOCK + len(item)].tolist()
                share = latent.common_subsequence(known, window) / len(item)
                answer = latent.common_subsequence(latent.masks(bench.answers[i]), window) / len(bench.answers[i])
                if share >= latent.COPY or share >= latent.PARAPHRASE and answer >= latent.ANSWER:
                    every.add((k, bench.ids[i]))
    assert got == every == truth
