"""Extraction in one pass over a text: both forms of the patterns find the same, and nothing is stored or moved."""

from pyspark.sql import functions as F

from factloom import session
from factloom.functions import event_search, matching, mention_search
from factloom.operators import entities, events
from factloom.plans import case_tables as ct
from factloom.plans import text_queries as tq

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "Order ORD-12345 placed on 2024-05-01. Total Due: USD 1,234.50. FedEx shipped it on 5th March 2023.\n12:30 – Customer\nRefund was not completed.",
    "Transaction ID: TXN-0O123 of Rs. 12,34,567.891 by x.y+z@foo-bar.org, see http://a.b:80/x?y). Call (022) 1234-5678 or +91 98765 43210 2 days ago.",
    "\n\n 9:01:02 - Store Support:\nIf approved, refund credited on 13/12/2022 or Jan 5, 2024; order for review, refund request, utr1234567890123 99 inr",
    "12, MG Road, Pune 411001. John Doe5 contacted support yesterday, FedEx12. Item delivered and refund requested but payment unsuccessful!",
]


def test_plain_and_general_forms_find_the_same():
    lex = event_search.lexicon()
    for text in TEXTS:
        assert matching.kind_of(text) == matching.PLAIN
        plain = mention_search.mentions_of(text, True, 0, "IN")
        told = event_search.triggers_of(text, lex)
        assert plain
        for tail, kind in ((" é.", matching.MIXED), (" कि ².", matching.ODD)):  # a letter, a mark and a number beyond ASCII
            other = text + "\n" + tail
            assert matching.kind_of(other) == kind
            assert mention_search.mentions_of(other, True, 0, "IN") == plain
            assert [t[:5] for t in event_search.triggers_of(other, lex)] == [t[:5] for t in told]


def test_numeric_dates_in_other_digits(spark):
    docs = spark.createDataFrame([("d", "Paid on ٣/٤/2020.")], "evidence_id string, text string")
    found = entities.mentions(entities.annotate(docs), ["DATE"]).first()
    assert found.raw == "٣/٤/2020" and found.candidate_dates == ["2020-04-03", "2020-03-04"]


def test_texts_are_neither_stored_nor_moved(spark, monkeypatch):
    session.prepare(spark)
    stored = []
    monkeypatch.setattr(ct, "stored", lambda s, p, name, build: stored.append(name))
    for make in (tq._grounding, tq._span_check, tq._matched, tq._consolidated, tq._doubled, tq._summary, tq._taxonomy, tq._relative):
        make(spark, SMALL)
    assert stored == []
    plan = tq._bound(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(moved) == 1 and "REPARTITION_BY" in moved[0]  # orders, before they become texts


def test_predictions_of_one_sentence_are_each_judged(spark):
    docs = entities.annotate(spark.createDataFrame([("d", "Item shipped. Hello."), ("e", None)], "evidence_id string, text string"))
    given = spark.createDataFrame(
        [("d", 0, "ITEM_DELIVERED", 0.9), ("d", 0, None, 0.5), ("d", 1, "ODD", None)], "evidence_id string, sent_ix int, label string, confidence double"
    )
    got = events.validate_sentences(docs, given).select("sent_ix", "label", F.round("model_confidence", 2), "decision_state").collect()
    assert sorted(map(tuple, got)) == [
        (0, "ITEM_DELIVERED", 0.9, "VALIDATED"), (0, "ITEM_SHIPPED", 0.5, "REVIEW_NEEDED"), (1, "ODD", 1.0, "REJECTED"),
    ]
