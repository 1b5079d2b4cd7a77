import numpy as np

from factloom.llm import rotated_codes as rc

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.98):
    ok = {}
    for k, v, label, _ in rows:
        if v is not None and label is not None and len(v) and None not in v:
            x = np.array(v, np.float32).astype(float)
            if np.isfinite(x).all() and x.any():
                ok[k] = (x, label)
    links = {k: set() for k, *_ in rows}
    for a in ok:
        for b in ok:
            (x, l1), (y, l2) = ok[a], ok[b]
            if a != b and l1 == l2 and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a].add(b)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out[k] = (len(links[k]), min(seen), min(seen) == k)
    return out


def corpus(dim=24):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(25):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 12)):
            v = base + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.14, 0.2, 0.3])
            rows.append((len(rows), (v * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), int(rng.integers(0, 2)), "x"))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, v, 1, None) for k, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None, None)] + [(2001 + k, rows[3][1], rows[3][2], None) for k in range(5)]
    return rows


def check(spark, rows):
    got = rc.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_hot_bands_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rc, "BLOCK", 5)
    check(spark, corpus(8))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    codes = rc.Codes(64, 16, 4)
    x, y = rc._unit(rng.standard_normal((400, 64))), rc._unit(rng.standard_normal((400, 64)))
    y[:200] = rc._unit(x[:200] + 0.3 * y[:200])
    value, bound = codes.estimate(*codes.code(x), y)
    error = value - x @ y.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= bound[:, None]).all()


def test_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 2.0], 1, None), (5, [1.0, 2.0], 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in rc.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (5, 0, 5, True)]
    assert rc.near_duplicates(df.limit(0)).count() == 0
