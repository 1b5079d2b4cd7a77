import fnmatch
import random

from factloom.llm import url_rules as u

RULES = [u.Rule("net/", "block"), u.Rule("example.net/en/", "allow"), u.Rule("example.com/de/", "block"), u.Rule("org/fr/", "allow")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = None
    for r in RULES:
        h, _, p = r.text.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if fit is None or len(r.text) > len(fit.text):
                fit = r
    return host, path, fit.text if fit else None, fit.verdict if fit else u.DEFAULT


def test_against_a_plain_evaluation(spark):
    rng = random.Random(1)
    parts = ["http", "://", "a.", "www.", "example", ".net", ".com", ".org", "net", "/", "en/", "de/", "fr/", "?x", "#y", "É", ":80", "EXAMPLE.NET"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    urls += [f"https://{h}{p}" for h in ("example.net", "b.example.net", "xexample.net", "net", "example.com", "a.org") for p in ("", "/", "/en/", "/en", "/de/x", "/fr/")]
    rows = [(k, x, "z") for k, x in enumerate([*urls, None])] + [(None, "http://net/", "z"), (0, urls[0], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = u.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    want = {k: plain(x) for k, x, _ in rows}
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], r
    assert u.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in u.judge(pages, []).collect()} == {u.DEFAULT}


def test_globs_over_several_words():
    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "ab", "*", "c"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = u.Automaton(globs).accepted([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert row.tolist() == [fnmatch.fnmatchcase(t, g) for g in globs], t
