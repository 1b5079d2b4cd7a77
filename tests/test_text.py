"""Pages, tokens and spans: how their rows lie, and what a span's page is."""

import random

from pyspark.sql import functions as F

from factloom import session
from factloom.operators import text
from factloom.plans import text_queries as tq

SMALL = "/root/testdata/sf0.001"


def _plan(spark, make):
    session.prepare(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tokens_are_made_where_their_document_lies(spark):
    made = {
        "layout": lambda: text.layout_from_tokens(text.clean_ocr_tokens(tq.tokens(spark, SMALL))),
        "pages": lambda: tq._spans_on_pages(spark, SMALL),
    }
    for name, make in made.items():
        plan = _plan(spark, make)
        assert all("REPARTITION_BY" in line for line in plan.splitlines() if " Exchange " in line or "- Exchange " in line), name
    boxes = _plan(spark, lambda: tq._boxes(spark, SMALL))
    assert all("REPARTITION_BY" in line for line in boxes.splitlines() if "Exchange " in line and "Reused" not in line)


def test_page_of_a_span(spark):
    """Many empty and short pages of a document in a segment, spans that lie twice or nowhere."""
    rng = random.Random(1)
    pages = [("d", k + 1, "x" * rng.choice([0, 0, 3, 900, 9000])) for k in range(60)] + [("e", 1, "abc"), ("e", 2, "de")]
    at, starts = 0, []
    for d, k, t in pages:
        at = 0 if k == 1 else at
        starts.append((d, k, at, len(t)))
        at += len(t) + 2
    spans = [("d", rng.randrange(120_000), "r") for _ in range(200)] + [("e", s, "r") for s in (0, 0, 3, 4, 5, 6, 7, 99)] + [("f", 1, "r")]
    want = []
    for d, s, r in spans:
        k, a = next(((k, a) for e, k, a, n in starts if e == d and a <= s <= a + n), (1, 0))
        want.append((d, s, r, k, s - a))
    got = text.attach_pages(
        spark.createDataFrame(spans, "evidence_id string, start int, raw string"), spark.createDataFrame(pages, "evidence_id string, page_no int, text string")
    )
    assert sorted(map(tuple, got.select("evidence_id", "start", "raw", "page_number", "page_relative_start").collect())) == sorted(want)
    assert got.select(F.count_if(F.col("page_number") > 1)).first()[0] > 100


def test_raw_spans_of_normalised_text(spark):
    """Against the characters one by one; the texts themselves are joined, no arrays of their characters."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "\r\n", "\r", "\n", "​", "﻿", "￿", "क़", "Å", "\U0001f600", "é"]) for _ in range(n)) for n in (0, 1, 2, 7, 40, 90)]
    spans = [(str(i), s, e) for i, t in enumerate(texts) for s in range(len(t) + 2) for e in range(s, len(t) + 3, 3)] + [("9", 0, 1), ("0", None, 1)]
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)] + [("n", None)], "text_id string, text string")
    df = text.map_span_to_raw(spark.createDataFrame(spans, "text_id string, norm_start int, norm_end int"), t)
    want = []
    for key, s, e in spans:
        at = []
        raw = texts[int(key)] if int(key) < len(texts) else ""
        for i, c in enumerate(raw):
            if c in "​﻿￿" or raw[i - 1:i + 1] == "\r\n" and i:
                continue
            at += [i] * (2 if c == "क़" else 1)
        if s is not None and s < e <= len(at):
            want.append((key, s, e, at[s], at[e - 1] + (2 if raw[at[e - 1]:at[e - 1] + 2] == "\r\n" else 1)))
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 500
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
