from pyspark.sql import functions as F

from factloom.operators import entities, events


def test_amounts_and_dates_in_other_ways_of_writing(spark):
    text = "Payment successful for order ORD-12345 of INR 1,250.50 on 2024-05-01. Refund completed on 2024-06-02."
    docs = spark.createDataFrame([("d", text)], "evidence_id string, text string")
    plain = entities.annotate(docs)
    away = plain.withColumn("mentions", F.transform("mentions", lambda m: m.withField("grounded", F.lit(False))))
    reasons = lambda a: {r for row in events.validate_sentences(a).select("review_reasons").collect() for r in row[0]}
    assert not [r for r in reasons(plain) if "verbatim" in r]
    assert not [r for r in reasons(away) if "verbatim" in r]  # 1,250.50 and the ISO dates stand in the text
    other = away.withColumn("text", F.replace(F.replace("text", F.lit("1,250.50"), F.lit("9,999.99")), F.lit("2024-05-01"), F.lit("1 May 2024")))
    assert [r for r in reasons(other) if "could not be confirmed verbatim" in r]
    assert [r for r in reasons(other) if "Temporal information '2024-05-01'" in r]


def test_argument_ids_are_those_of_the_mentions(spark):
    docs = spark.createDataFrame([("d", "Payment successful for order ORD-12345 of INR 1,250.50 on 2024-05-01.")], "evidence_id string, text string")
    annotated = entities.annotate(docs)
    ids = {r.etype: r.entity_id for r in entities.mentions(annotated).collect()}
    got = events.extract_events(annotated).first().argument_provenance
    assert got.amount_entity_id == ids["MONETARY_AMOUNT"] and got.order_entity_id == ids["ORDER_ID"] and got.temporal_entity_id == ids["DATE"]
    assert got.refund_entity_id is None and got.actor_entity_id is None


def test_predicted_events_must_stand_in_the_document(spark):
    docs = spark.createDataFrame([("d", "Payment failed. Item shipped.")], "evidence_id string, text string")
    rows = [("d", "Payment failed.", 0, 14, "Payment failed"), ("d", "Payment  failed.", 0, 14, "Payment failed"), ("d", "Item shipped.", 16, 99, "Item"), ("d", "Item shipped.", 16, 20, "Itxm"), ("gone", "x", 0, 1, "x")]
    got = events.grounding_errors(spark.createDataFrame(rows, "evidence_id string, sentence string, start int, end int, raw string"), docs).collect()
    by = {(r.evidence_id, r.sentence, r.end): r.errors for r in got}
    assert by["d", "Payment failed.", 14] == [] and by["d", "Payment  failed.", 14] == ["Sentence text does not exist verbatim in EvidenceText raw text."]
    assert by["d", "Item shipped.", 99] == ["Invalid trigger offsets: [16:99]."] and by["d", "Item shipped.", 20] == ["Trigger mismatch: expected 'Itxm', found 'Item'."]
    assert len(by["gone", "x", 1]) == 2
