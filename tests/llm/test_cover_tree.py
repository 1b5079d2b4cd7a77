import math
import random

import numpy as np
import pytest

from factloom.llm import cover_tree as ct


def _plain(rows, step=50, moved=7):
    """Brute force over (id, label, vector) rows."""
    held = set()
    usable = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i % moved == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in usable:
        if i % step or (i, label, tuple(v)) in held:
            continue
        held.add((i, label, tuple(v)))
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in usable if j != i))
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def _own(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = ct.hard_negatives(frame, 50, 5, 3, 50, 95, moved=7, classes=10)
    return sorted(tuple(r) for r in found.collect())


def _clustered(rng, n, dim, labels, spread):
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        v = [c + spread * rng.gauss(0, 1) for c in centers[rng.randrange(labels)]]
        norm = math.sqrt(sum(x * x for x in v)) or 1
        rows.append((i, label, [x / norm for x in v]))
    return rows


@pytest.mark.parametrize("tree, shelf, anchors", [(1024, 32, 256), (40, 2, 3)])
def test_equals_brute_force(spark, monkeypatch, tree, shelf, anchors):
    for name, value in (("TREE", tree), ("SHELF", shelf), ("ANCHORS", anchors)):
        monkeypatch.setattr(ct, name, value)
    rng = random.Random(1)
    rows = _clustered(rng, 700, 6, 4, 0.3)
    rows += [(700 + k, k % 3, rows[0][2]) for k in range(120)]  # a hot vector with ties over labels
    rows += [(5_000, 1, [0.5, 0.25]), (5_001, 2, []), (5_050, 3, [0.0] * 6), (50, 1, rows[3][2]), rows[100]]
    rows += [(None, 1, rows[0][2]), (6_000, None, rows[0][2]), (6_001, 1, None), (6_002, 1, [1.0, None]), (6_003, 1, [math.nan]), (6_004, 1, [math.inf])]
    rng.shuffle(rows)
    assert _own(spark, rows) == _plain(rows)


def test_tree_invariants():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(size=(300, 5)))
    vectors[50:80] = vectors[0]
    labels = rng.integers(0, 3, 300)
    tree = ct.build(np.arange(300), labels, vectors)
    points = tree["vectors"].astype(float)
    lifted = np.column_stack([points, np.sqrt(tree["top"][0] - (points**2).sum(axis=1))])
    parent = tree["parent"]
    assert parent[0] == -1 and (parent[1:] < np.arange(1, len(parent))).all()
    for k in range(1, len(parent)):
        assert tree["first_child"][parent[k]] <= k < tree["first_child"][parent[k]] + tree["children"][parent[k]]
        a = parent[k]
        assert abs(np.linalg.norm(lifted[k] - lifted[a]) - tree["apart"][k]) < 1e-3
        while a >= 0:
            assert np.linalg.norm(lifted[k] - lifted[a]) <= tree["cover"][a] + 1e-3
            assert not tree["pure"][a] or tree["label"][a] == tree["label"][k]
            a = parent[a]
    assert sorted(tree["ids"].tolist()) == list(range(300))
    for k in range(len(parent)):
        ids = tree["ids"][tree["first_id"][k] : tree["first_id"][k + 1]]
        assert (vectors[ids] == points[k]).all() and (labels[ids] == tree["label"][k]).all() and (np.diff(ids) > 0).all()


def test_descent_skips_what_no_window_needs(monkeypatch):
    rng = np.random.default_rng(3)
    centers = 200 * rng.normal(size=(20, 4))
    vectors = np.floor(centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 4)))
    tree = ct.build(np.arange(3000), np.zeros(3000, int), vectors)
    seen = []
    plain = ct.products
    monkeypatch.setattr(ct, "products", lambda a, b: seen.append(len(b)) or plain(a, b))
    anchor = vectors[:1]
    found = ct.descend(ct.Forest([tree], 4), anchor, np.array([0]), np.array([0]), np.full((1, 1), ct.LEAST), np.full((1, 1), ct.MOST), True, 5)
    score = (vectors @ anchor[0]).astype(int)
    want = sorted(((-s, i) for i, s in enumerate(score.tolist()) if i))[:5]
    assert [(-s, i) for s, i in zip(found.score[0].tolist(), found.id[0].tolist())] == want
    assert sum(seen) < len(tree["label"]) / 3


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 3.0], [1.0, 0.0]])
    assert ct.products(a, np.array([[2.0**20, 1.0], [2.0**40, 0.0]])).tolist() == [[2**60 + 3, 2**63 - 1], [2**20, 2**40]]


def test_nothing_to_do(spark):
    assert _own(spark, [(1, 1, [1.0])]) == []
    assert _own(spark, [(50, 1, [1.0]), (51, 1, [1.0])]) == []
    frame = spark.createDataFrame([], "vec_id long, label int, embedding array<float>, bucket int")
    assert ct.hard_negatives(frame, 50, 5, 3, 50, 95).count() == 0
