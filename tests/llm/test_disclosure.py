import random
import re

from factloom.llm import disclosure as d

SMALL = "doc_id long, text string, spans string"


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19:
            total = sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(reversed(digits)))
            if total % 10 == 0:
                out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_rules_against_plain_expressions():
    rng = random.Random(1)
    parts = ["a", ".", "@", "x.y", "-", " ", "+1", "(555) 123", "4111111111111111", "4111 1111", "255", ".", "1.2.3.4", "256.1.1.1", "0", "é", "%", "b@c.de", "@@", "\n", "١"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert d.base_spans(text) == plain(text), repr(text)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(60):
        body = [word() for _ in range(40)]
        if k % 5 == 0:  # "Zanzifoo" stands only near one address, "shared" everywhere
            body[20:20] = ["shared", "Zanzifoo", "bob@mail.example.org", word()]
        else:
            body[7:7] = ["shared", word(), "user%d@mail.example.org" % k]
        rows.append((k, " ".join(body), "x"))
    return rows


def test_disclosing_words_are_added_and_others_not(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SMALL)
    got = {r.doc_id: r for r in d.personal_data(docs).collect()}
    for k, text, _ in rows:
        base = [(s.kind, s.start, s.end) for s in got[k].base]
        assert base == plain(text)
        terms = {text[s.start : s.end] for s in got[k].spans if s.kind == "term"}
        assert terms == ({"Zanzifoo"} if k % 5 == 0 else set())
        assert [(s.kind, s.start, s.end) for s in got[k].spans][: len(base)] == base
    new = {r.doc_id: r.text for r in d.sanitise(docs).collect()}
    assert "shared [NAME] [EMAIL]" in new[0] and "Zanzifoo" not in "".join(new.values())


def test_nulls_repeats_copies_and_empty_table(spark):
    copy = "alpha beta gamma me@x.org delta"
    rows = [(1, copy, "y"), (1, copy, "y"), (None, copy, None), (2, None, None), (3, "", None), (4, copy, "z")]
    docs = spark.createDataFrame(rows, SMALL)
    got = d.personal_data(docs).collect()
    assert len(got) == 6
    for r in got:  # one context, however often it is copied, discloses nothing
        assert [s.kind for s in r.spans] == (["email"] if r.doc_id not in (2, 3) else [])
    assert {r.text for r in d.sanitise(docs).where("doc_id = 1").collect()} == {"alpha beta gamma [EMAIL] delta"}
    assert d.personal_data(docs.limit(0)).count() == 0
    assert d.base_spans("@" * 50_000 + "1" * 50_000) == [] and d.base_spans("a" * 50_000 + "@") == []
