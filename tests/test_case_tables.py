"""The derived case tables: how their rows lie, so that joins move little."""

from factloom import session
from factloom.operators import findings, skew, versions
from factloom.plans import case_tables as ct, text_corpus

SMALL = "/root/testdata/sf0.001"


def test_events_are_not_shuffled_to_meet_their_documents(spark):
    session.prepare(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = versions.active_events(ct.events(spark, SMALL), ct.evidence(spark, SMALL))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan.split("Generate explode")[0]
    assert "SortMergeJoin" in above and "Exchange" not in above


def test_a_line_that_occurs_twice_gives_its_events_twice_and_its_document_once(spark):
    events, evidence = ct.events(spark, SMALL), ct.evidence(spark, SMALL)
    lines = ct.table(spark, SMALL, "lineitem").join(ct.table(spark, SMALL, "orders").selectExpr("o_orderkey AS l_orderkey"), "l_orderkey")
    shipped = lines.where("l_orderkey % 50 <> 7")
    assert events.where("event_type = 'ITEM_SHIPPED' AND event_id LIKE 'evt_%'").count() == shipped.count()
    assert evidence.where("evidence_id LIKE 'evi_s%'").count() == lines.select("l_orderkey", "l_suppkey").distinct().count()


def _written(monkeypatch):
    tables, write = [], findings.materialize
    monkeypatch.setattr(findings, "materialize", lambda df, name: tables.append((name, df)) or write(df, name))
    return tables


def test_sequence_classes_of_whole_cases_write_counts_by_instant_only(spark, monkeypatch):
    tables = _written(monkeypatch)
    active = versions.active_events(ct.events(spark, SMALL), ct.evidence(spark, SMALL))
    findings.sequence_classes(active, distinct_documents=False).count()
    assert {name for name, _ in tables} == {"instants"}
    assert all("n_early" in df.columns and "source_name" not in df.columns for _, df in tables)


def test_written_events_have_no_column_that_nothing_reads(spark, monkeypatch):
    tables = _written(monkeypatch)
    active = versions.active_events(ct.events(spark, SMALL), ct.evidence(spark, SMALL))
    findings.check_temporal(active).count()
    assert {c for _, df in tables for c in df.columns}.isdisjoint({"trigger_raw_text", "source_name", "char_start"})
    findings.stored_members(active)
    assert "processing_run_id" not in dict(tables)["active"].columns


def test_pairs_of_a_case_are_built_where_its_events_lie(spark, monkeypatch):
    from factloom.plans import finding_queries as fq
    session.prepare(spark)
    tables, write = [], skew.materialize
    monkeypatch.setattr(skew, "materialize", lambda df, name: tables.append(name) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = findings.date_findings(fq.members(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Window" in plan and "Exchange" not in plan.split("Generate explode")[0]
    assert tables == ["large"]


def test_rendered_documents_are_dealt_out_by_their_number(spark, monkeypatch):
    orders = ct.table(spark, SMALL, "orders")
    monkeypatch.setattr(text_corpus, "DOCUMENTS_PER_TASK", 100)
    made = text_corpus._documents(spark, SMALL)
    assert made.rdd.getNumPartitions() == -(-orders.count() // 100) > 1
    assert made.count() == orders.count()


def test_all_findings_write_neither_events_nor_their_index(spark, monkeypatch):
    session.prepare(spark)
    tables = _written(monkeypatch)
    findings.all_findings(ct.evidence(spark, SMALL), ct.events(spark, SMALL, "case_id"))
    assert {"active", "members"}.isdisjoint(name for name, _ in tables)


def test_reviews_and_dossiers_make_events_once(spark):
    """Advisories are stored, so what reads them several times doesn't make the events anew; a dossier's events lie by case."""
    from factloom.operators import reviews
    from factloom.plans import case_queries as cq
    session.prepare(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan(reviews.active(reviews.history(*cq._submissions(spark, SMALL))))
    dealt = [line for line in plan(cq._dossiers(spark, SMALL)).splitlines() if "RepartitionByExpression" in line]
    assert dealt and all("case_id" in line and "evidence_id" not in line.split("]")[0] for line in dealt)


def test_tasks_follow_the_number_of_line_items(spark, monkeypatch):
    """Few partitions of the session don't leave a task more lines than it can sort the events of."""
    session.prepare(spark)
    rows = lambda: versions.active_events(ct.events(spark, SMALL, "case_id"), ct.evidence(spark, SMALL))
    found = sorted(rows().select("event_id", "source_name").collect())
    monkeypatch.setattr(ct, "LINES_PER_TASK", 500)
    tasks = -(-ct.table(spark, SMALL, "lineitem").count() // 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows()._jdf.queryExecution().executedPlan().toString()
        assert tasks > 4 and f", {tasks}), REPARTITION_BY_NUM" in plan
        assert "Exchange" not in plan.split("Generate explode")[0]
        assert sorted(rows().select("event_id", "source_name").collect()) == found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
