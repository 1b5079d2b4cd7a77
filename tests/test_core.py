"""Edge cases of the library outside the numbered operators."""

from pyspark.sql import functions as F

from factloom.functions import display, refs
from factloom.operators import entities, findings, graph, reviews, skew


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_explicit_timestamps(spark):
    text = lambda t: one(spark, F.date_format(refs.explicit_timestamp(F.lit(t)), "yyyy-MM-dd HH:mm"))
    assert text("2026-01-05") == "2026-01-05 00:00"
    assert text("2026-01-05T10") == "2026-01-05 10:00"
    assert text("20260105") == "2026-01-05 00:00"
    assert text("2026-01-05T10:30:00+0530") == "2026-01-05 05:00"
    assert text("2026-01-05T10:30Z") == "2026-01-05 10:30"
    assert text("soon") is None and text("2026-13-05") is None


def test_digits_of_other_scripts(spark):
    assert one(spark, refs.ascii_digits(F.lit("٣٤a５"))) == "34a5"
    docs = spark.createDataFrame([("d", "Total INR ٥٠٠ due, call +٩١ ٩٨٧٦٥ ٤٣٢١٠ now")], "evidence_id string, text string")
    rows = entities.annotate(docs).first().asDict(recursive=True)
    kinds = {m["etype"] for m in rows["mentions"]}
    assert {"MONETARY_AMOUNT", "PHONE_NUMBER"} <= kinds


def test_export_names(spark):
    assert one(spark, display.export_name(F.lit("/case 1-é"))) == "case_1-"
    assert one(spark, display.export_name(F.lit("***"))) == "case"


def rows(spark, n):
    data = [("c", k, k % 4 if k % 5 else None) for k in range(n)]
    return spark.createDataFrame(data, "g string, uid long, v long")


def test_pairs_of_hot_groups_do_not_depend_on_the_block(spark):
    df, differ = rows(spark, 23), ~F.col("a_v").eqNullSafe(F.col("b_v"))
    got = []
    for block in (2, 5, 1000):
        pairs = skew.discordant_pairs(df, ["g"], ["v"], differ, F.lit(True), "uid", block)
        got.append(sorted((r.a_uid, r.b_uid) for r in pairs.collect()))
    value = lambda k: k % 4 if k % 5 else None
    want = [(a, b) for a in range(23) for b in range(a + 1, 23) if value(a) != value(b)]
    assert got[0] == got[1] == got[2] == want


def test_grid_join_is_an_equi_join(spark):
    a = rows(spark, 17).select("g", F.col("uid").alias("a_uid"))
    b = rows(spark, 9).select("g", F.col("uid").alias("b_uid"))
    got = sorted((r.a_uid, r.b_uid) for r in skew.grid_join(a, b, ["g"], "a_uid", "b_uid", 2).collect())
    assert got == [(x, y) for x in range(17) for y in range(9)]


def test_pair_counts(spark):
    data = [("c", "R", d, t) for d, t in [("d1", "A"), ("d1", "A"), ("d2", "A"), ("d2", "B"), ("d3", "B")]]
    members = spark.createDataFrame(data, "case_id string, ref_key string, evidence_id string, event_type string")
    got = {(r.type_a, r.type_b): r.pairs for r in findings.event_pair_counts(members).collect()}
    assert got == {("A", "A"): 2, ("A", "B"): 5, ("B", "B"): 1}


def test_review_history(spark):
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, k)"
    sent = [("f", 0, "DISMISSED", ""), ("f", 1, "DISMISSED", " dup"), ("f", 2, "DISMISSED", "dup "), ("f", 3, "RESOLVED", None), ("g", 0, "RESOLVED", "x")]
    subs = spark.createDataFrame([("c", f, k, "u", d, r) for f, k, d, r in sent], "case_id string, finding_id string, k int, reviewer_id string, decision string, reason string")
    subs = subs.withColumn("submitted_at", F.expr(at)).drop("k")
    known = spark.createDataFrame([("c", "f")], "case_id string, finding_id string")
    got = reviews.history(subs, known).orderBy("version").collect()
    assert [(r.decision, r.reason, r.version, r.is_active) for r in got] == [("DISMISSED", "dup", 1, False), ("RESOLVED", None, 2, True)]
    refused = {(r.finding_id, r.refused) for r in reviews.checked(subs, known).where("refused is not null").collect()}
    assert refused == {("f", "REASON_REQUIRED"), ("g", "FINDING_NOT_FOUND")}
    assert reviews.active(reviews.history(subs, known)).count() == 1


def test_graph_falls_back_to_the_case(spark):
    evidence = spark.createDataFrame([("c", "d1")], "case_id string, evidence_id string")
    events = spark.createDataFrame([("c", "d1", "e1"), ("c", "gone", "e2")], "case_id string, evidence_id string, event_id string")
    events = events.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.source, r.target, r.type) for r in graph.edges(evidence, events).collect()}
    assert got == {
        ("case-root", "doc-d1", "ASSOCIATION"), ("doc-d1", "evt-e1", "EXTRACTION"),
        ("case-root", "evt-e2", "EXTRACTION"), ("evt-e2", "evt-e1", "CHRONOLOGY"),
    }


def test_classifier_and_stratified_split(spark):
    from factloom.operators import classifier, curation

    words = {"paid": "invoice payment settled card", "shipped": "parcel courier tracking sent", "other": "hello weather thanks note"}
    rows = [(k, label, " ".join(f"{w} w{k % 7}" for w in text.split()[: 2 + k % 3])) for k, (label, text) in enumerate(list(words.items()) * 30)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    split = curation.stratified_split(df, "label", "id").cache()
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts[("paid", "train")] == 21 and counts[("paid", "val")] == 4 and counts[("paid", "test")] == 5
    part = lambda s: split.where(F.col("split") == s).select("id", "label", "text")
    model = classifier.train_classifier(part("train"), part("val"))
    got = classifier.classify(model, part("test").unionByName(spark.createDataFrame([(999, None, None)], "id long, label string, text string")))
    assert got.where("label = predicted").count() == 15 and got.count() == 16


def test_pairs_by_size_are_those_of_the_classes(spark):
    data = [(g, k // 2, k % 4 if k % 5 else None) for g, n in (("a", 9), ("b", 3), ("c", 23)) for k in range(n)]
    df, differ = spark.createDataFrame(data, "g string, uid long, v long"), F.coalesce(F.col("a_v") != F.col("b_v"), F.lit(False))
    found = lambda fn, block: sorted(tuple(r) for r in fn(df, ["g"], ["v"], differ, F.lit(True), "uid", block).select("g", "a_uid", "a_v", "b_uid", "b_v").collect())
    want = found(skew.discordant_pairs, 1000)
    assert want and all(found(skew.pairs_by_size, block) == want for block in (2, 10, 1000))


def test_comparable_events_know_their_other_reference(spark):
    data = [("c", f"e{k}", f"d{d}", o, t, k) for k, (d, o, t) in enumerate([(1, "ORD-1", "TXN-9"), (2, "ord 1", "TXN-9"), (2, "ORD-1", "TXN-8"), (3, None, "TXN-9"), (3, "ORD-5", "ORD-5")])]
    active = spark.createDataFrame(data, "case_id string, event_id string, evidence_id string, order_reference string, transaction_reference string, created_at long")
    for c in ("event_type", "decision_state", "trigger_raw_text", "temporal_information", "amount_currency", "polarity", "source_name"):
        active = active.withColumn(c, F.lit(""))
    active = active.withColumns({"char_start": F.lit(0), "char_end": F.lit(0), "page_number": F.lit(1), "amount_value": F.lit(1), "model_confidence": F.lit(1.0)})
    got = {(r.event_id, r.ref_key): (r.group_size, r.display_ref, r.other_rank and r.other_rank.ord.event_id)
           for r in findings.comparable_events(active).collect()}
    assert got == {
        ("e0", "ORD1"): (3, "ORD-1", "e0"), ("e1", "ORD1"): (3, "ORD-1", "e0"), ("e2", "ORD1"): (3, "ORD-1", None),
        ("e0", "TXN9"): (3, "TXN-9", "e0"), ("e1", "TXN9"): (3, "TXN-9", "e0"), ("e3", "TXN9"): (3, "TXN-9", None),
    }
