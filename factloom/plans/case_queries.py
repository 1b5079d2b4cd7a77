"""Registered queries: listings, versions and runs, evaluation, reviews and the evidence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import session
from factloom.functions import display, refs
from factloom.operators import classifier, curation, dossier, evaluation, findings, graph, listing, reviews, versions
from factloom.plans import case_tables as ct
from factloom.plans.case_tables import sql
from factloom.plans.finding_queries import MISSING_SQL, active
from factloom.sources import files

NOW = "2024-01-02 00:00:00"


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _visible(spark, sf):
    return listing.list_case_events(ct.events(spark, sf), ct.evidence(spark, sf))


PAGE = "SELECT {k}, {i}, position, total, CAST(ceil(total/20.0) AS BIGINT) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY created_at DESC, {i} DESC) AS position, count(*) OVER (PARTITION BY {k}) AS total FROM {t}) WHERE position<=20"
# active versions without the activity flag: every event row is active here
SEEN = "seen AS (SELECT e.*, d.original_filename AS source_name FROM evt e JOIN evi d ON e.evidence_id=d.evidence_id AND e.case_id=d.case_id AND e.user_id=d.user_id AND e.processing_version=d.active_processing_version)"
STATED = "try_cast(replace(temporal_information,'Z','') AS TIMESTAMP)"


def _listings(add) -> None:
    add("list_cases", lambda s, p: listing.list_cases(ct.cases(s, p)).select("user_id", "case_id", "position", "total", "pages"),
        sql(PAGE.format(k="user_id", i="case_id", t="case_t")))
    add("list_evidence", lambda s, p: listing.list_evidence(ct.evidence(s, p)).select("case_id", "user_id", "evidence_id", "position", "total", "pages"),
        sql(PAGE.format(k="case_id, user_id", i="evidence_id", t="evi")))
    add("tenant_isolation", lambda s, p: versions.restrict_to_cases(
        ct.events(s, p), ct.cases(s, p).withColumn("user_id", F.when(F.col("status") != "READY", "usr_other").otherwise(F.col("user_id")))).select("event_id"),
        sql("SELECT event_id FROM evt JOIN case_t USING (case_id) WHERE status='READY'"))
    add("list_case_events", lambda s, p: _visible(s, p).select("case_id", "evidence_id", "event_id", "processing_version", "source_name"),
        sql("SELECT case_id, evidence_id, event_id, processing_version, source_name FROM seen", SEEN))
    add("evidence_event_lists", lambda s, p: _visible(s, p).groupBy("evidence_id").agg(
        F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("events")),
        sql("SELECT evidence_id, string_agg(event_id, ',' ORDER BY event_id) AS events FROM seen GROUP BY 1", SEEN))
    add("search_events", lambda s, p: listing.search_events(_visible(s, p), "Ship").select("event_id"),
        sql("""SELECT event_id FROM seen WHERE contains(lower(event_type),'ship') OR contains(lower(coalesce(trigger_raw_text,'')),'ship')
          OR contains(lower(coalesce(actor,'')),'ship') OR contains(lower(coalesce(order_reference,'')),'ship') OR contains(lower(coalesce(transaction_reference,'')),'ship')""", SEEN))
    add("search_cases", lambda s, p: listing.search_cases(ct.cases(s, p), "MACH").select("case_id"),
        sql("SELECT case_id FROM case_t WHERE contains(lower(title),'mach') OR contains(lower(description),'mach') OR contains(lower(c_mktsegment),'mach')"))
    add("timeline_order", lambda s, p: listing.with_timeline(_visible(s, p)).select("event_id", "grounded_date", _stamp(F.col("timeline_at")).alias("timeline_at")),
        sql(f"SELECT event_id, temporal_information AS grounded_date, strftime(coalesce({STATED}, created_at),'%Y-%m-%d %H:%M:%S') AS timeline_at FROM seen", SEEN))
    add("event_types", lambda s, p: listing.event_types(_visible(s, p)).select("case_id", F.array_join("event_types", ",").alias("event_types")),
        sql("SELECT case_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM seen GROUP BY 1", SEEN))
    add("event_labels", lambda s, p: _visible(s, p).select(
        "event_id", display.date_label(F.col("temporal_information")).alias("date_label"),
        display.amount_label(F.col("amount_value"), F.col("amount_currency")).alias("amount_label"),
        display.confidence_label(F.round("model_confidence", 4)).alias("confidence_label")),
        sql(f"""SELECT event_id, CASE WHEN {STATED} IS NULL THEN temporal_information ELSE strftime({STATED},'%b %-d, %Y') END AS date_label,
          coalesce(coalesce(amount_currency,'$')||format('{{:,.2f}}', CAST(amount_value AS DOUBLE)),'') AS amount_label,
          CAST(round(round(model_confidence,4)*100) AS INTEGER)||'%' AS confidence_label FROM seen""", SEEN))
    add("case_tags_and_titles", lambda s, p: ct.cases(s, p).select(
        "case_id", F.array_join(display.normalize_tags(F.col("tags")), ",").alias("tags"), display.tags_valid(F.col("tags")).alias("tags_valid"),
        display.title_valid(F.concat(F.substring("title", -2, 2), F.when(F.length("case_id") % 2 == 0, "x ").otherwise(" "))).alias("title_valid"),
        display.export_name(F.concat(F.lit("/"), "case_id", F.lit(" é"))).alias("export_name")),
        sql("""SELECT case_id, lower(c_mktsegment)||',vip' AS tags, true AS tags_valid, length(case_id)%2=0 AS title_valid, case_id AS export_name FROM case_t"""))
    add("lenient_amounts", lambda s, p: ct.table(s, p, "lineitem").groupBy(refs.parse_amount(
        F.when(F.col("l_linenumber") == 1, "None").when(F.col("l_linenumber") == 2, " ").when(F.col("l_linenumber") == 3, "12x")
        .otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".50 ")))).cast("double").alias("amount")).count(),
        """SELECT CASE WHEN l_linenumber<=3 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER)||'.50' AS DOUBLE) END AS amount, count(*) AS count FROM lineitem GROUP BY 1""")
    add("top_case_events", lambda s, p: listing.top_events(_visible(s, p)).select("case_id", "event_id", "position"),
        sql("SELECT case_id, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, event_id DESC) AS position FROM seen) WHERE position<=16", SEEN))


def _runs(spark, sf):
    """A finished run for every document; every third one lost its document to another run."""
    n = F.length("evidence_id")
    return ct.evidence(spark, sf).select(
        "evidence_id", F.when(n % 3 == 0, "run_old").otherwise(F.col("current_run_id")).alias("run_id"),
        F.col("active_processing_version").alias("prior_version"), F.when(n % 5 == 0, "REVIEW_NEEDED").otherwise("PASS").alias("quality_state"),
        F.lit(2).alias("page_count"), F.lit(50).alias("character_count"), F.lit(1).alias("entities_extracted"), F.lit("none found").alias("diagnostic"),
    )


def _staged(spark, sf):
    return ct.events(spark, sf).withColumn("processing_run_id", F.concat(F.lit("run_"), "evidence_id"))


RUN = """rn AS (SELECT *, length(evidence_id)%3<>0 AS wins, coalesce(active_processing_version,0)+1 AS next_version FROM evi),
  st AS (SELECT evidence_id, count(*) AS k, bool_or(decision_state='REVIEW_NEEDED') AS review FROM evt GROUP BY 1)"""


def _versions(add) -> None:
    older = "CASE WHEN d.active_processing_version > 0 THEN e.processing_version >= d.active_processing_version ELSE true END"
    add("purged_events", lambda s, p: versions.purge_superseded(ct.events(s, p), ct.evidence(s, p)).select("event_id", "processing_version"),
        sql(f"SELECT event_id, processing_version FROM evt e JOIN evi d USING (evidence_id) WHERE {older}"))
    failed = lambda s, p: ct.evidence(s, p).where(F.col("status") == "EXTRACTING").select("evidence_id", F.col("current_run_id").alias("run_id"))
    add("rolled_back_evidence", lambda s, p: versions.rollback_runs(ct.evidence(s, p), ct.events(s, p), failed(s, p))[0].select("evidence_id", "status", "error_code"),
        sql("SELECT evidence_id, CASE WHEN status='EXTRACTING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status='EXTRACTING' THEN 'EXTRACTION_FAILURE' END AS error_code FROM evi"))
    add("rolled_back_events", lambda s, p: versions.rollback_runs(ct.evidence(s, p), ct.events(s, p), failed(s, p))[1].select("event_id"),
        sql("SELECT event_id FROM evt e JOIN evi d USING (evidence_id) WHERE NOT (d.status='EXTRACTING' AND e.processing_run_id=d.current_run_id)"))
    add("synced_cases", lambda s, p: versions.sync_case_state(ct.cases(s, p), ct.evidence(s, p)).select("case_id", "status", "evidence_count"),
        sql("""SELECT case_id, coalesce(s, 'READY') AS status, coalesce(n, 0) AS evidence_count FROM case_t LEFT JOIN (SELECT case_id, count(*) AS n,
          CASE WHEN bool_or(status IN ('QUEUED','EXTRACTING','STRUCTURING','ANALYZING')) THEN 'PROCESSING'
            WHEN bool_or(status IN ('REVIEW_NEEDED','FAILED','INTERRUPTED')) THEN 'REVIEW_NEEDED' ELSE 'READY' END AS s FROM evi GROUP BY 1) USING (case_id)"""))
    stale = lambda s, p, k: versions.recover_stale(ct.evidence(s, p), ct.events(s, p), F.to_timestamp(F.lit(NOW)))[k]
    is_stale = f"d.status='EXTRACTING' AND d.heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND"
    add("stale_evidence", lambda s, p: stale(s, p, 0).select("evidence_id", "status", "error_code"),
        sql(f"SELECT evidence_id, CASE WHEN {is_stale} THEN 'INTERRUPTED' ELSE status END AS status, CASE WHEN {is_stale} THEN 'JOB_INTERRUPTED' END AS error_code FROM evi d"))
    add("events_after_recovery", lambda s, p: stale(s, p, 1).select("event_id"),
        sql(f"SELECT event_id FROM evt e JOIN evi d USING (evidence_id) WHERE NOT ({is_stale} AND e.processing_run_id=d.current_run_id)"))
    add("recovered_runs", lambda s, p: stale(s, p, 2), sql(f"SELECT evidence_id, current_run_id AS run_id FROM evi d WHERE {is_stale}"))
    asked = lambda s, p: ct.evidence(s, p).select("case_id", "user_id", F.when(F.length("evidence_id") % 7 == 0, F.concat("evidence_id", F.lit("x"))).otherwise(F.col("evidence_id")).alias("evidence_id"))
    add("retry_requests", lambda s, p: versions.request_retry(ct.evidence(s, p), asked(s, p)).select("evidence_id", "outcome", "status", "retry_count", "reason"),
        sql("""SELECT CASE WHEN lost THEN evidence_id||'x' ELSE evidence_id END AS evidence_id, CASE WHEN lost THEN 'NOT_FOUND' WHEN fit THEN 'ACCEPTED' ELSE 'REFUSED' END AS outcome,
          CASE WHEN lost THEN NULL WHEN fit THEN 'QUEUED' ELSE status END AS status, CASE WHEN lost THEN NULL WHEN fit THEN 1 ELSE 0 END AS retry_count,
          CASE WHEN NOT lost AND NOT fit THEN 'Cannot retry evidence with status '''||status||'''' END AS reason
          FROM (SELECT *, length(evidence_id)%7=0 AS lost, status IN ('FAILED','INTERRUPTED','REVIEW_NEEDED') AS fit FROM evi)"""))
    add("claimed_jobs", lambda s, p: versions.claim_jobs(ct.evidence(s, p)).select("evidence_id", "status", "current_run_id"),
        sql("""SELECT evidence_id, CASE WHEN fit THEN 'EXTRACTING' ELSE status END AS status, CASE WHEN fit THEN 'run_'||substr(sha256(evidence_id||'|0'),1,24) ELSE current_run_id END AS current_run_id
          FROM (SELECT *, status IN ('QUEUED','FAILED','INTERRUPTED','REVIEW_NEEDED') AS fit FROM evi)"""))
    add("duplicate_uploads", lambda s, p: versions.dedupe_evidence(ct.evidence(s, p)).select("evidence_id", "canonical_evidence_id", "is_duplicate"),
        sql("""SELECT evidence_id, c AS canonical_evidence_id, evidence_id<>c AS is_duplicate FROM (SELECT evidence_id,
          first_value(evidence_id) OVER (PARTITION BY case_id, user_id, sha256_hash ORDER BY created_at, evidence_id) AS c FROM evi)"""))
    add("restored_uploads", lambda s, p: versions.restore_uploads(
        ct.evidence(s, p).select("case_id", "user_id", "sha256_hash", F.concat(F.lit("up_"), "evidence_id").alias("upload_id")),
        ct.evidence(s, p), ct.evidence(s, p).where(F.col("status") == "READY").select("evidence_id")).select("upload_id", "evidence_id", "is_duplicate", "file_restored", "status"),
        sql("""SELECT 'up_'||u.evidence_id AS upload_id, k.evidence_id, true AS is_duplicate, k.status<>'READY' AS file_restored,
          CASE WHEN k.status IN ('FAILED','INTERRUPTED') THEN 'QUEUED' ELSE k.status END AS status
          FROM evi u JOIN (SELECT * FROM evi QUALIFY row_number() OVER (PARTITION BY case_id, user_id, sha256_hash ORDER BY created_at, evidence_id)=1) k USING (case_id, user_id, sha256_hash)"""))
    add("dashboard", lambda s, p: versions.dashboard(ct.cases(s, p)),
        sql("""SELECT count(*) AS total, count(*) FILTER (status='READY') AS ready, count(*) FILTER (status IN ('PROCESSING','EXTRACTING','STRUCTURING','ANALYZING','QUEUED')) AS processing,
          count(*) FILTER (status='REVIEW_NEEDED') AS review_needed FROM case_t"""))
    add("cases_in_flight", lambda s, p: versions.in_flight(ct.evidence(s, p)),
        sql("SELECT case_id, bool_or(status IN ('QUEUED','EXTRACTING','STRUCTURING','ANALYZING')) AS in_flight FROM evi GROUP BY 1"))
    add("activated_evidence", lambda s, p: versions.activate_runs(ct.evidence(s, p), _staged(s, p), _runs(s, p))[0].select(
        "evidence_id", "status", "active_processing_version", F.col("extraction_summary.events_extracted").alias("events_extracted")),
        sql("""SELECT evidence_id, CASE WHEN NOT wins THEN status WHEN length(evidence_id)%5=0 OR coalesce(review, false) THEN 'REVIEW_NEEDED' ELSE 'READY' END AS status,
          CASE WHEN wins THEN next_version ELSE active_processing_version END AS active_processing_version, CASE WHEN wins THEN coalesce(k, 0) ELSE events_extracted END AS events_extracted
          FROM rn LEFT JOIN st USING (evidence_id)""", RUN))
    add("activated_events", lambda s, p: versions.activate_runs(ct.evidence(s, p), _staged(s, p), _runs(s, p))[1].select("event_id", "processing_version"),
        sql("SELECT event_id, next_version AS processing_version FROM evt JOIN rn USING (evidence_id) WHERE wins", RUN))


PREDICTED = "pd AS (SELECT CASE l_returnflag WHEN 'N' THEN 'NO_EVENT' ELSE l_returnflag END AS gold, CASE p WHEN 'N' THEN 'NO_EVENT' ELSE p END AS predicted FROM (SELECT l_returnflag, CASE WHEN l_linenumber%4<>0 THEN l_returnflag WHEN l_returnflag='A' THEN 'N' WHEN l_returnflag='N' THEN 'R' ELSE 'A' END AS p FROM lineitem))"
COUNTS = "cc AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(s) AS BIGINT) AS support FROM (SELECT gold AS label, (gold=predicted)::INT AS tp, 0 AS fp, (gold<>predicted)::INT AS fn, 1 AS s FROM pd UNION ALL SELECT predicted, 0, (gold<>predicted)::INT, 0, 0 FROM pd) GROUP BY 1), pc AS (SELECT *, tp/(tp+fp) AS p, tp/(tp+fn) AS r FROM cc), pf AS (SELECT *, 2*p*r/(p+r) AS f FROM pc)"


def _predictions(spark, sf):
    flag = F.col("l_returnflag")
    shifted = F.when(F.col("l_linenumber") % 4 != 0, flag).when(flag == "A", "N").when(flag == "N", "R").otherwise("A")
    named = lambda c: F.when(c == "N", evaluation.NO).otherwise(c)
    return ct.table(spark, sf, "lineitem").select(named(flag).alias("gold"), named(shifted).alias("predicted"))


def _evaluation(add) -> None:
    add("binary_metrics", lambda s, p: evaluation.binary_metrics(_predictions(s, p)),
        f"""WITH {PREDICTED}, n AS (SELECT count(*) FILTER (g AND q) AS tp, count(*) FILTER (NOT g AND q) AS fp, count(*) FILTER (g AND NOT q) AS fn, count(*) FILTER (NOT g AND NOT q) AS tn
          FROM (SELECT gold<>'NO_EVENT' AS g, predicted<>'NO_EVENT' AS q FROM pd))
        SELECT tp, fp, fn, tn, round(tp/(tp+fp),4) AS precision, round(tp/(tp+fn),4) AS recall, round(2*tp/(2*tp+fp+fn),4) AS f1, round((tp+tn)/(tp+fp+fn+tn),4) AS accuracy FROM n""")
    add("per_class_metrics", lambda s, p: evaluation.per_class_metrics(_predictions(s, p)),
        f"WITH {PREDICTED}, {COUNTS} SELECT label, tp, fp, fn, support, round(p,4) AS precision, round(r,4) AS recall, round(f,4) AS f1 FROM pf")
    add("overall_metrics", lambda s, p: evaluation.overall_metrics(_predictions(s, p)),
        f"""WITH {PREDICTED}, {COUNTS} SELECT round(sum(tp)/sum(support),4) AS accuracy, round(avg(p),4) AS macro_precision, round(avg(r),4) AS macro_recall, round(avg(f),4) AS macro_f1,
          round(sum(p*support)/sum(support),4) AS weighted_precision, round(sum(r*support)/sum(support),4) AS weighted_recall, round(sum(f*support)/sum(support),4) AS weighted_f1 FROM pf""")
    add("event_only_metrics", lambda s, p: evaluation.event_only_metrics(_predictions(s, p)),
        f"""WITH {PREDICTED}, n AS (SELECT count(*) FILTER (g) AS gold_events, count(*) FILTER (q) AS predicted_events, count(*) FILTER (g AND e) AS exact_matches,
          count(*) FILTER (g AND q AND NOT e) AS wrong_type, count(*) FILTER (g AND NOT q) AS missed_events FROM (SELECT gold<>'NO_EVENT' AS g, predicted<>'NO_EVENT' AS q, gold=predicted AS e FROM pd))
        SELECT *, round(exact_matches/predicted_events,4) AS precision, round(exact_matches/gold_events,4) AS recall, round(2*exact_matches/(predicted_events+gold_events),4) AS f1 FROM n""")
    add("confusion_matrix", lambda s, p: evaluation.confusion_matrix(_predictions(s, p), ["A", "R", evaluation.NO]),
        f"""WITH {PREDICTED} SELECT gold, count(*) FILTER (predicted='A') AS "A", count(*) FILTER (predicted='R') AS "R", count(*) FILTER (predicted='NO_EVENT') AS "NO_EVENT" FROM pd GROUP BY 1""")
    add("boundary_confusions", lambda s, p: evaluation.boundary_confusions(_predictions(s, p), [("A", "R"), ("R", evaluation.NO)]),
        f"""WITH {PREDICTED} SELECT a||' -> '||b AS pair, (SELECT count(*) FROM pd WHERE gold=a AND predicted=b) AS confusions
          FROM (VALUES ('A','R'),('R','NO_EVENT'),('R','A'),('NO_EVENT','R')) v(a,b)""")
    add("disagreements", lambda s, p: evaluation.disagreements(ct.table(s, p, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("sample_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("predicted_a"),
        F.when(F.col("l_linestatus") == "F", "R").otherwise(F.when(F.col("l_linenumber") % 2 != 0, "N")).alias("predicted_b"))),
        """SELECT * FROM (SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey AS sample_id, CASE WHEN l_linenumber%3<>0 THEN l_returnflag END AS predicted_a,
          CASE WHEN l_linestatus='F' THEN 'R' WHEN l_linenumber%2<>0 THEN 'N' END AS predicted_b FROM lineitem) WHERE predicted_a IS DISTINCT FROM predicted_b""")


def _advisories(spark, sf):
    """Missing corroboration, stored: reviews and dossiers read it up to seven times, and events take long to make."""
    return ct.stored(spark, sf, "advisories", lambda s, p: findings.missing_corroboration(active(s, p)))


def _submissions(spark, sf):
    """Five submissions for every missing-corroboration advisory, and one for an unknown finding."""
    sent = [(0, "DISMISSED", " dup "), (1, "DISMISSED", "dup"), (2, "DISMISSED", " "), (3, "RESOLVED", None), (4, "DISMISSED", "dup")]
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("decision"), F.lit(r).alias("reason")) for k, d, r in sent])
    found = _advisories(spark, sf).select("case_id", "finding_id")
    known = found.select("case_id", "finding_id", F.inline(rows))
    unknown = found.select("case_id", F.lit("fnd_unknown").alias("finding_id"), F.lit(0).alias("k"), F.lit("RESOLVED").alias("decision"), F.lit("x").alias("reason"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 60)
    every = known.unionByName(unknown).select("case_id", "finding_id", F.lit("rev_1").alias("reviewer_id"), "decision", "reason", at.alias("submitted_at"))
    return every, found


HISTORY = f"""ms AS ({MISSING_SQL}), hs AS (SELECT case_id, finding_id, decision, reason, version, version=3 AS is_active,
    TIMESTAMP '2024-01-01' + to_minutes(a) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(b) AS updated_at
  FROM ms, (VALUES (1,'DISMISSED','dup',0,3),(2,'RESOLVED',NULL,3,4),(3,'DISMISSED','dup',4,4)) v(version, decision, reason, a, b))"""


def _reviews(add) -> None:
    add("review_history", lambda s, p: reviews.of_finding(reviews.history(*_submissions(s, p))).select(
        "case_id", "finding_id", "decision", "reason", "version", "is_active", _stamp(F.col("created_at")).alias("created_at"), _stamp(F.col("updated_at")).alias("updated_at"), "position"),
        sql("SELECT case_id, finding_id, decision, reason, version, is_active, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at,'%Y-%m-%d %H:%M:%S') AS updated_at, 4-version AS position FROM hs", HISTORY))
    add("active_reviews", lambda s, p: reviews.active(reviews.history(*_submissions(s, p))).select("case_id", "finding_id", "decision", "version", "review_id"),
        sql("SELECT case_id, finding_id, decision, version, 'rev_'||substr(sha256(case_id||'|'||finding_id||'|'||version),1,24) AS review_id FROM hs WHERE is_active", HISTORY))
    add("refused_reviews", lambda s, p: reviews.checked(*_submissions(s, p)).where("refused IS NOT NULL").groupBy("case_id", "refused").count(),
        sql("SELECT case_id, refused, count(*) AS count FROM ms, (VALUES ('FINDING_NOT_FOUND'),('REASON_REQUIRED')) v(refused) GROUP BY ALL", HISTORY))
    add("reviewed_findings", lambda s, p: _reviewed(s, p),
        sql("SELECT m.case_id, m.finding_id, severity, CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS severity_rank, decision, version FROM ms m JOIN hs USING (case_id, finding_id) WHERE is_active", HISTORY))


def _reviewed(spark, sf):
    found = _advisories(spark, sf)
    got = findings.attach_reviews(found, reviews.history(*_submissions(spark, sf)))
    return got.select(
        "case_id", "finding_id", "severity", findings.severity_rank(F.col("severity")).cast("int").alias("severity_rank"),
        F.col("active_review.decision").alias("decision"), F.col("active_review.version").alias("version"),
    )


TOP = SEEN + ", tp AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, event_id DESC) AS position FROM seen QUALIFY position<=16)"


def _graph(add) -> None:
    add("graph_nodes", lambda s, p: graph.nodes(ct.cases(s, p), ct.evidence(s, p), _visible(s, p)),
        sql("""SELECT case_id, 'case-root' AS node_id, title AS label, 'CASE' AS type, 'ACTIVE' AS status, coalesce(d,0)||' docs, '||coalesce(e,0)||' events' AS meta
          FROM case_t LEFT JOIN (SELECT case_id, count(*) AS d FROM evi GROUP BY 1) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS e FROM seen GROUP BY 1) USING (case_id)
          UNION ALL SELECT case_id, 'doc-'||evidence_id, original_filename, 'EVIDENCE', status, printf('%.1f KB', round(file_size_bytes/1024.0, 1))||' • '||replace(media_type,'application/','') FROM evi
          UNION ALL SELECT case_id, 'evt-'||event_id, CASE WHEN length(t)>32 THEN t[1:32]||'…' ELSE t END, 'EVENT', decision_state, temporal_information
            FROM (SELECT *, coalesce(trigger_raw_text, event_type) AS t FROM tp)""", TOP))
    add("graph_edges", lambda s, p: graph.edges(ct.evidence(s, p), _visible(s, p)),
        sql("""SELECT case_id, 'case-root' AS source, 'doc-'||evidence_id AS target, 'ASSOCIATION' AS type FROM evi
          UNION ALL SELECT case_id, 'doc-'||evidence_id, 'evt-'||event_id, 'EXTRACTION' FROM tp
          UNION ALL SELECT a.case_id, 'evt-'||a.event_id, 'evt-'||b.event_id, 'CHRONOLOGY' FROM tp a JOIN tp b ON a.case_id=b.case_id AND b.position=a.position+1""", TOP))


def _decided(spark, sf):
    found = _advisories(spark, sf)
    return found, reviews.history(*_submissions(spark, sf))


def _gaps(spark, sf):
    rows = dossier.gaps(ct.cases(spark, sf), ct.evidence(spark, sf), _advisories(spark, sf))
    return rows.select("case_id", "gap_type", "description", "related_reference", F.array_join("affected_evidence_ids", ",").alias("affected"))


def _summaries(spark, sf):
    found, history = _decided(spark, sf)
    decided = dossier.with_decisions(found, history)
    return dossier.summaries(ct.cases(spark, sf), ct.evidence(spark, sf), ct.events(spark, sf, "case_id"), decided)


def _dossiers(spark, sf):
    found, history = _decided(spark, sf)
    # events by case: a dossier holds its case whole, so they needn't be moved from their documents to it
    rows = dossier.build(ct.cases(spark, sf), ct.evidence(spark, sf), ct.events(spark, sf, "case_id"), found, history)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return rows.select(
        "case_id", "manifest_hash", n("document_inventory").alias("documents"), n("events_timeline").alias("events"),
        n("findings").alias("findings"), n("human_reviews").alias("reviews"),
    )


def _chips(spark, sf):
    found, history = _decided(spark, sf)
    evidence = ct.evidence(spark, sf)
    return dossier.report_chips(ct.cases(spark, sf), evidence, dossier.timeline(ct.events(spark, sf), evidence), found, history)


MANIFEST = "(SELECT case_id, sha256(case_id||'::'||strftime(any_value(case_t.created_at),'%Y-%m-%dT%H:%M:%S+00:00')||'::'||coalesce(string_agg(sha256_hash,'::' ORDER BY sha256_hash),'')) AS manifest_hash FROM case_t LEFT JOIN evi USING (case_id) GROUP BY 1)"
PER_CASE = "LEFT JOIN (SELECT case_id, count(*) AS d FROM evi GROUP BY 1) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS e FROM evt GROUP BY 1) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS f FROM ms GROUP BY 1) USING (case_id)"


def _dossier(add) -> None:
    add("dossier_inventory", lambda s, p: dossier.inventory(ct.evidence(s, p)).withColumn("uploaded_at", _stamp(F.col("uploaded_at"))),
        sql("SELECT case_id, evidence_id, original_filename, media_type, file_size_bytes, sha256_hash, status, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS uploaded_at, active_processing_version FROM evi"))
    add("dossier_timeline", lambda s, p: dossier.timeline(ct.events(s, p), ct.evidence(s, p)).select(
        "case_id", "event_id", "source_document", "event_type", "amount_value", "polarity", "trigger_raw_text", "stated_event_date"),
        sql("""SELECT e.case_id, event_id, d.original_filename AS source_document, event_type, CAST(amount_value AS DOUBLE) AS amount_value, polarity,
          coalesce(trigger_raw_text,'') AS trigger_raw_text, temporal_information AS stated_event_date FROM evt e JOIN evi d USING (evidence_id)"""))
    add("dossier_findings", lambda s, p: dossier.with_decisions(*_decided(s, p)).select(
        "case_id", "finding_id", "adjudication_status", F.array_join(F.transform("review_history", lambda r: r["version"].cast("string")), ",").alias("versions")),
        sql("SELECT case_id, finding_id, 'DISMISSED' AS adjudication_status, string_agg(version, ',' ORDER BY version DESC) AS versions FROM hs GROUP BY ALL", HISTORY))
    add("evidence_gaps", _gaps,
        sql("""SELECT case_id, 'MISSING_CORROBORATION' AS gap_type, summary AS description, CASE WHEN contains(title,'(') THEN replace(split(title,'(')[-1],')','') END AS related_reference, evidence_a AS affected FROM ms
          UNION ALL SELECT case_id, 'PROCESSING_ANOMALY', 'Evidence document '''||original_filename||''' is in state '||status||' and may contain incomplete extractions.', NULL, evidence_id
            FROM evi WHERE status IN ('REVIEW_NEEDED','FAILED','INTERRUPTED')
          UNION ALL SELECT case_id, 'DOCUMENT_UNAVAILABLE', 'No evidence documents have been uploaded to this case.', NULL, '' FROM case_t WHERE case_id NOT IN (SELECT case_id FROM evi)""", HISTORY))
    add("executive_summaries", _summaries,
        sql(f"""SELECT case_id, 'This dispute dossier compiles documentary evidence and cross-examination findings for Case '''||case_id||''' ('''||title||'''). The submitted record comprises '||coalesce(d,0)||' evidence document(s) yielding '||coalesce(e,0)||
          ' verified event assertion(s). Automated reasoning identified '||coalesce(f,0)||' potential inconsistency or documentation advisory findings. Human review records indicate 0 confirmed inconsistency(ies), 0 resolved matter(s), '||coalesce(f,0)||
          ' dismissed item(s), and 0 pending review. All citations refer to exact source document passages. This dossier organizes evidence and does not constitute a legal finding of fault or liability.' AS executive_summary
          FROM case_t {PER_CASE}""", HISTORY))
    add("report_rows", lambda s, p: dossier.report_rows(dossier.inventory(ct.evidence(s, p))),
        sql("""SELECT case_id, original_filename[:32] AS filename, evidence_id[:16] AS document_id, printf('%.1f KB', file_size_bytes/1024.0)||' • '||status AS size_status,
          sha256_hash[:18]||'...' AS digest FROM evi"""))
    add("report_chips", _chips, sql(f"""SELECT case_id, unnest(['Documents','Events','Findings','Adjudications']) AS label,
          unnest([CAST(coalesce(d,0) AS VARCHAR), CAST(coalesce(e,0) AS VARCHAR), CAST(coalesce(f,0) AS VARCHAR), CAST(3*coalesce(f,0) AS VARCHAR)]) AS value FROM case_t {PER_CASE}""", HISTORY))
    add("manifest_hashes", lambda s, p: dossier.manifests(ct.cases(s, p), ct.evidence(s, p)), sql(f"SELECT * FROM {MANIFEST}"))
    add("dossiers", _dossiers,
        sql(f"SELECT case_id, manifest_hash, coalesce(d,0) AS documents, coalesce(e,0) AS events, coalesce(f,0) AS findings, 3*coalesce(f,0) AS reviews FROM case_t JOIN {MANIFEST} m USING (case_id) {PER_CASE}", HISTORY))


def _curation(add) -> None:
    part = lambda: F.element_at(F.array(*[F.lit(x) for x in curation.SPLITS]), (F.col("doc_id") % 3 + 1).cast("int"))
    add("exact_leakage", lambda s, p: curation.exact_leakage(ct.table(s, p, "documents").select(part().alias("split"), F.concat(F.lit(" "), F.upper("text")).alias("text"))),
        """WITH k AS (SELECT DISTINCT CASE doc_id%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS s, lower(trim(' '||upper(text), ' ')) AS t FROM documents)
        SELECT a.s AS split_a, b.s AS split_b, count(*) AS texts FROM k a JOIN k b ON a.t=b.t AND a.s<b.s GROUP BY ALL""")
    labels = lambda s, p: ct.table(s, p, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    add("class_weights", lambda s, p: curation.class_weights(labels(s, p)).withColumn("weight", F.round("weight", 6)),
        """WITH c AS (SELECT quality*2+toxic AS label, count(*) AS support FROM labels GROUP BY 1), w AS (SELECT *, sum(support) OVER ()/(count(*) OVER ()*support) AS w FROM c)
        SELECT label, support, round(w/avg(w) OVER (), 6) AS weight FROM w""")
    add("stratified_split", lambda s, p: curation.stratified_split(labels(s, p), "label", "doc_id").groupBy("label", "split").count(),
        """WITH c AS (SELECT quality*2+toxic AS label, count(*) AS n FROM labels GROUP BY 1),
        k AS (SELECT label, n, greatest(1, CAST(floor(n*0.7) AS BIGINT)) AS a, greatest(1, CAST(floor(n*0.15) AS BIGINT)) AS b FROM c)
        SELECT label, split, count FROM (SELECT label, 'train' AS split, least(n, a) AS count FROM k UNION ALL SELECT label, 'val', least(greatest(n-a,0), b) FROM k UNION ALL SELECT label, 'test', n-a-b FROM k) WHERE count>0""")


def _uploads(spark, sf):
    """The bytes of every page as an upload; some get the head of a known format, some another name or type."""
    n = F.col("page_id") % 9
    head = F.when(n == 0, "25504446").when(n == 1, "89504E470D0A1A0A").when(n == 2, "FFD8FF").when(n == 3, "52494646").when(n == 4, "25504446").otherwise("")
    content = F.when(n != 5, F.concat(F.unhex(head), F.col("html").cast("binary"))).otherwise(F.lit("").cast("binary"))
    name = F.when(n == 6, ".pdf").when(n == 7, "page.exe").when(n == 2, "Page.JPG").otherwise("a.b/page.pdf")
    kind = F.when(n == 2, "image/jpg; x=1").when(n == 4, "Image/PNG").when(n == 3, "application/octet-stream")
    return ct.table(spark, sf, "pages").select("page_id", name.alias("filename"), kind.alias("declared_type"), content.alias("content"))


def _languages(spark, sf):
    """A classifier of the documents' languages, learned on a stratified part; its measures on the part for testing."""
    docs = ct.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    rows = session.materialize(curation.stratified_split(docs, "label", "doc_id"), "split")
    part = lambda name: rows.where(F.col("split") == name).select("doc_id", "text", "label")
    model = classifier.train_classifier(part("train"), part("val"))
    tested = classifier.classify(model, part("test"))
    return evaluation.per_class_metrics(tested.select(F.col("label").alias("gold"), "predicted"))


def _sources(add) -> None:
    add("classifier_metrics", _languages)
    add("checked_uploads", lambda s, p: files.checked_uploads(_uploads(s, p)).select("page_id", "media_type", "file_size_bytes", "sha256_hash", "reject_reason"),
        """WITH u AS (SELECT page_id, page_id%9 AS n, CASE page_id%9 WHEN 0 THEN '\\x25PDF'::BLOB WHEN 4 THEN '\\x25PDF'::BLOB WHEN 1 THEN '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB
          WHEN 2 THEN '\\xFF\\xD8\\xFF'::BLOB WHEN 3 THEN 'RIFF'::BLOB ELSE ''::BLOB END AS head, encode(html) AS html FROM pages),
        c AS (SELECT page_id, n, CASE WHEN n=5 THEN ''::BLOB ELSE head||html END AS content FROM u)
        SELECT page_id, CASE n WHEN 0 THEN 'application/pdf' WHEN 4 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS media_type,
          octet_length(content) AS file_size_bytes, sha256(content) AS sha256_hash,
          CASE WHEN n IN (6,7) THEN 'UNSUPPORTED_EXTENSION' WHEN n=5 THEN 'EMPTY_FILE' WHEN n=4 THEN 'TYPE_MISMATCH' WHEN n=8 THEN 'UNKNOWN_SIGNATURE' END AS reject_reason FROM c""")


def register(add) -> None:
    _listings(add)
    _versions(add)
    _evaluation(add)
    _reviews(add)
    _graph(add)
    _dossier(add)
    _curation(add)
    _sources(add)
