import random

from factloom.llm import minmax

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, percent=75):
    sets = {}
    for key, text in rows:
        w = (text or "").translate(SMALL).replace("\x0b", " ").replace("\x0c", " ").split()
        sets[key] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), top(k), top(k) == k) for k, s in sets.items()}


def corpus():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(400)]
    rows, key = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((key, " ".join(copy)))
            key += 1
    # a chain: neighbours are similar, its ends are not
    chain = [rng.choice(vocab) for _ in range(60)]
    for step in range(8):
        rows.append((key, " ".join(chain[step * 4 : step * 4 + 32])))
        key += 1
    extra = ["", None, "one", "ONE", "one two three", "One two\tthree", "a b c d e", "a b c d e", "À b c d e f"]
    for text in extra:
        rows.append((key, text))
        key += 1
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_bands_with_several_components(spark, monkeypatch):
    """Blocks of two rows: the comparison across components is cut into many blocks."""
    monkeypatch.setattr(minmax, "BLOCK", 2)
    rng = random.Random(5)
    base = ["b%d" % i for i in range(100)]
    rows = []
    for key in range(40):  # a star whose centre is not the smallest key
        copy = list(base)
        for _ in range(0 if key == 39 else 3):
            copy[rng.randrange(100)] = "x%d" % rng.randrange(10**6)
        rows.append((key, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "z"), (None, "a b c d e f", None), (3, "a b c d e f", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(docs).collect())
    assert got == [(0, 2, None, True), (1, 2, 1, True), (3, 2, 1, False)]
    assert minmax.near_duplicates(docs.limit(0)).count() == 0
