import random
import re

import numpy as np
import pytest

from factloom.llm import char_cnn as c

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(a, b, c.KINDS[k]) for a, k, b in sorted(out)]


def test_rules_against_plain_expressions():
    rng = random.Random(1)
    parts = ["token", "ToKeN", "api_key", "APIKEY", "passwd", "ſecret", "secret", "=", ":", " ", '"', "abc", "short", "AKIA", "Z9" * 8, "0a1b2c3d" * 3, "f" * 23, "é", "\n", "K"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert c.base_findings(text)[0] == plain(text), repr(text)


def corpus(n=400):
    rng = random.Random(2)
    chars = "0123456789abcdef"
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 14))) for _ in range(30)]
        if k % 3 == 0:
            words.insert(rng.randrange(30), 'token = "%s"' % "".join(rng.choice(chars) for _ in range(40)))
        if k % 3 == 1:
            words.insert(rng.randrange(30), "version2-of-the-long-name-%d" % k)
        rows.append((k, " ".join(words), "x"))
    return rows


@pytest.fixture(scope="module")
def network(spark):
    return c.learn(spark.createDataFrame(corpus(), "doc_id long, text string, secrets string"))


def test_held_out_secrets_are_recognised(network):
    rng = random.Random(77)
    good = ["x = '%s'" % "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(100)]
    bad = ["plain-words-and-the-%d-item-name" % k for k in range(100)]
    p = network.probabilities(np.stack([c.window(t, 5, len(t) - 1) for t in good] + [c.window(t, 0, len(t)) for t in bad]))
    assert (p[:100] >= network.threshold).mean() >= 0.9 and (p[100:] < network.threshold).mean() >= 0.9


def test_rows_nulls_and_redaction(spark, network):
    rows = [(1, 'my password: "hunter22x" ok', "y"), (1, 'my password: "hunter22x" ok', "y"), (None, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = c.find(docs, network).collect()
    assert sorted(len(r.secrets) for r in got) == [0, 0, 1, 1]
    new = c.redact(docs, network).collect()
    assert {r.text for r in new} == {'my [SECRET]" ok', None, ""} and new[0].secrets == "y"
    assert c.find(docs.limit(0), network).count() == 0
    nothing = c.learn(docs.limit(0))
    assert c.scan(nothing, [rows[0][1]])[0][0][2] == "assign"


def test_redacted_overlaps():
    assert c.redacted("abcdefgh", [(1, 4, "a"), (2, 6, "b"), (7, 8, "a")]) == "a[SECRET]g[SECRET]"


def test_every_finding_trains_or_calibrates(spark, monkeypatch):
    """Many shares give a network as good as one, and no finding is left out."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, secrets string")
    monkeypatch.setattr(c, "SHARE", 60)
    tables, counts = [], []
    write, count = c.materialize, c.Network.calibrate
    monkeypatch.setattr(c, "materialize", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    monkeypatch.setattr(c.Network, "calibrate", lambda self, x, label, n: counts.append(n.sum()) or count(self, x, label, n))
    learned = c.learn(docs)
    found, shares = dict(tables)["findings"], dict(tables)["shares"]
    dealt = [x.window for r in shares.collect() for x in r["items"]]
    assert shares.count() > 5 and sorted(dealt) == sorted(r.window for r in found.collect())
    assert counts == [found.where("pmod(h, 4) = 0").count()]
    test_held_out_secrets_are_recognised(learned)
