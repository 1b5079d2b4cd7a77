"""Registered queries: text layer, entities and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import refs
from factloom.functions.display import export_name
from factloom.operators import entities, evaluation, events, text
from factloom.plans import case_tables as ct
from factloom.plans import text_corpus as tc
from factloom.plans.text_corpus import sql


def prose(spark, sf):
    """The driver's prose as documents: whole texts of documents and conversations."""
    d = ct.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("evidence_id"), "text")
    c = ct.table(spark, sf, "conversations").select(F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("evidence_id"), "text")
    return d.unionByName(c)


PROSE = "prose AS (SELECT 'd'||doc_id AS evidence_id, text FROM documents UNION ALL SELECT 'c_'||conv_id||'_'||turn, text FROM conversations)"


def annotated(spark, sf):
    return entities.annotate(tc.documents(spark, sf), anchor="anchor", country="country")


def results(spark, sf):
    return events.validate_sentences(annotated(spark, sf))


def pages(spark, sf):
    """Pages of each document, which lie by document: tokens and spans made from them need no shuffle to meet."""
    return tc.documents(spark, sf).select("evidence_id", F.posexplode(F.array("page_one", "page_two")).alias("_p", "text")).select(
        "evidence_id", (F.col("_p") + 1).alias("page_no"), "text"
    )


PAGES = "pg AS (SELECT evidence_id, 1 AS page_no, page_one AS text, ok FROM doc UNION ALL SELECT evidence_id, 2, page_two, ok FROM doc)"


def tokens(spark, sf):
    """Words of each page with a box per word on a 2000 x 1000 page."""
    words = pages(spark, sf).select(
        "evidence_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "_l")
    ).select("*", F.posexplode(F.split("_l", " ")).alias("word_ix", "word"))
    return words.select(
        "evidence_id", "page_no", "word_ix", F.lit(0).alias("block_no"), "line_no", "word",
        F.when(F.length("word") == 2, -1).otherwise(F.length("word") * 12).cast("double").alias("confidence"),
        (F.col("word_ix") * 20).alias("left"), (F.col("line_no") * 20).alias("top"), F.lit(18).alias("width"),
        F.lit(18).alias("height"), F.lit(2000).alias("page_width"), F.lit(1000).alias("page_height"),
    )


TOKENS = PAGES + """,
ln AS (SELECT evidence_id, page_no, unnest(string_split(text,chr(10))) AS l, generate_subscripts(string_split(text,chr(10)),1)-1 AS line_no FROM pg),
tk AS (SELECT evidence_id, page_no, line_no, unnest(string_split(l,' ')) AS word, generate_subscripts(string_split(l,' '),1)-1 AS word_ix FROM ln)
"""
# expected mentions of a rendered document: (etype, raw, normal form, confidence, occurrence text in front)
EXPECTED = """
ex AS (
 SELECT ok, evidence_id, text, 'ORDER_ID' AS etype, 'ORD-'||pad AS raw, 'ORD-'||pad AS norm_text, 0.95 AS confidence, 'Order ' AS pre FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'DATE', CAST(day AS VARCHAR), CAST(day AS VARCHAR), 0.99, 'placed on ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'MONETARY_AMOUNT', cur||' '||format('{:,.2f}',o_totalprice), NULL, 0.98, 'Due: ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'TRANSACTION_ID', 'TXN-'||txn, txn, CASE WHEN regexp_matches(txn,'[0-9]') AND ok%5=0 THEN 0.75 ELSE 0.95 END, 'ID: ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'MONETARY_AMOUNT', 'INR '||(ok%9000+100), NULL, 0.98, 'Amount: ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'ORGANIZATION', 'FedEx', 'FedEx', 0.92, 'via ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'DATE', day(sday)||' '||mn[month(sday)]||' '||year(sday), CAST(sday AS VARCHAR), 0.98, 'FedEx on ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'MONETARY_AMOUNT', '$'||(ok%900+10)||'.50', NULL, 0.98, 'refund of ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'REFUND_ID', 'credited', 'CREDITED', 0.95, 'refund ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'DATE', strftime(rday,'%d/%m/%Y'), CASE WHEN day(rday)>12 THEN CAST(rday AS VARCHAR) END, CASE WHEN day(rday)>12 THEN 0.95 ELSE 0.75 END, 'credited on ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'TIME', clock, clock||':00', 0.95, chr(10) FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'PERSON', 'Customer', 'Customer', 0.95, '– ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'RELATIVE_TIME', 'yesterday', CASE WHEN anchor IS NOT NULL THEN CAST(CAST(anchor AS DATE)-1 AS VARCHAR) END, CASE WHEN anchor IS NOT NULL THEN 0.9 ELSE 0.7 END, 'support ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'PHONE_NUMBER', '+91 98765'||lpad(CAST(ok%100000 AS VARCHAR),5,'0'), NULL, 0.9, 'from ' FROM txt
 UNION ALL SELECT ok, evidence_id, text, 'ORDER_ID', 'ORD-'||pad, 'ORD-'||pad, 0.95, 'for order ' FROM txt),
men AS (SELECT *, CAST(strpos(text, pre||raw)+length(pre)-1 AS INTEGER) AS start FROM ex)
"""
# expected sentences of a rendered document with label, polarity, modality and tense
SENTENCES = """
mood AS (SELECT *, CASE ok%3 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN 'PLANNED' ELSE 'UNCERTAIN' END AS rm, mn[month(sday)]='May' AS in_may FROM txt),
se AS (
 SELECT evidence_id, ok, text, 1 AS k, s1 AS s, 'ORDER_PLACED' AS label, 'Order ORD-'||pad||' placed' AS trg, 'POSITIVE' AS pol, 'ASSERTED' AS modl, 'PAST' AS tense, 'VALIDATED' AS state FROM mood
 UNION ALL SELECT evidence_id, ok, text, 2, s2, 'NO_EVENT', NULL, NULL, NULL, NULL, 'VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 3, s3, CASE WHEN o_orderstatus='F' THEN 'PAYMENT_FAILED' ELSE 'PAYMENT_MADE' END, CASE WHEN o_orderstatus='F' THEN 'Payment failed' ELSE 'Payment successful' END, 'POSITIVE','ASSERTED','PAST','VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 4, s4, 'ITEM_SHIPPED','shipped','POSITIVE', CASE WHEN in_may THEN 'UNCERTAIN' ELSE 'ASSERTED' END,'PAST','VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 5, s5, 'REFUND_COMPLETED', substr(s5,5,length(s5)-5), CASE WHEN ok%3=0 THEN 'NEGATED' ELSE 'POSITIVE' END, rm, CASE WHEN ok%3=1 THEN 'FUTURE' ELSE 'PAST' END,'VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 6, s6, 'REFUND_COMPLETED','refund credited','POSITIVE','CONDITIONAL','PAST','VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 7, clock||' – Customer', 'NO_EVENT',NULL,NULL,NULL,NULL,'VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 8, s8, 'SUPPORT_CONTACTED','contacted support','POSITIVE','ASSERTED','PAST','VALIDATED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 9, s9, 'REFUND_REQUESTED','Refund requested','POSITIVE','ASSERTED','PAST','REVIEW_NEEDED' FROM mood
 UNION ALL SELECT evidence_id, ok, text, 10, s10, 'NO_EVENT',NULL,NULL,NULL,NULL,'VALIDATED' FROM mood WHERE s10 IS NOT NULL),
cand AS (SELECT *, CAST(strpos(text,s)-1+strpos(s,trg)-1 AS INTEGER) AS char_start FROM se WHERE trg IS NOT NULL
 UNION ALL SELECT evidence_id, ok, text, 9, s9, 'ITEM_DELIVERED','item delivered','POSITIVE','ASSERTED','PAST','REVIEW_NEEDED', CAST(strpos(text,s9)-1+strpos(s9,'item delivered')-1 AS INTEGER) FROM mood)
"""


def _mention_query(etypes):
    def run(s, p):
        m = entities.mentions(annotated(s, p), etypes)
        return m.select("evidence_id", "etype", "raw", "norm_text", "start", F.round("confidence", 2).alias("confidence"), "grounded")

    listed = ",".join(f"'{t}'" for t in etypes)
    return run, sql(
        f"SELECT evidence_id, etype, raw, norm_text, start, confidence, true AS grounded FROM men WHERE etype IN ({listed})", EXPECTED
    )


def _ambiguous(s, p):
    m = entities.mentions(annotated(s, p), ["DATE"]).where("is_ambiguous")
    return m.select("evidence_id", "raw", F.element_at("candidate_dates", 1).alias("day_first"), F.element_at("candidate_dates", 2).alias("month_first"))


def _money(s, p):
    m = entities.mentions(annotated(s, p), ["MONETARY_AMOUNT"])
    return m.select("evidence_id", "raw", F.col("money.value").cast("double").alias("value"), F.col("money.currency").alias("currency"))


def _phone(s, p):
    m = entities.mentions(annotated(s, p), ["PHONE_NUMBER"])
    return m.select("evidence_id", F.col("phone.country_code").alias("country_code"), F.col("phone.e164").alias("e164"))


def _relative(s, p):
    m = entities.mentions(annotated(s, p), ["RELATIVE_TIME"])
    return m.select("evidence_id", "raw", F.col("relative.status").alias("status"), F.col("relative.computed").alias("computed"))


def _bound(s, p):
    e = events.extract_events(annotated(s, p))
    return e.select(
        "evidence_id", "event_type", "trigger_raw_text", "char_start", "polarity", "modality", "tense", "order_reference",
        "transaction_reference", F.col("amount_value").cast("double").alias("amount_value"), "actor",
    )


BOUND_SQL = """SELECT evidence_id, label AS event_type, trg AS trigger_raw_text, c.char_start, pol AS polarity, modl AS modality, tense,
  arg_min(CASE WHEN etype='ORDER_ID' THEN raw END, CASE WHEN etype='ORDER_ID' THEN dist*100000+start END) AS order_reference,
  arg_min(CASE WHEN etype='TRANSACTION_ID' THEN raw END, CASE WHEN etype='TRANSACTION_ID' THEN dist*100000+start END) AS transaction_reference,
  CAST(arg_min(CASE WHEN etype='MONETARY_AMOUNT' THEN CAST(replace(regexp_replace(raw,'[^0-9.,]','','g'),',','') AS DOUBLE) END, CASE WHEN etype='MONETARY_AMOUNT' THEN dist*100000+start END) AS DOUBLE) AS amount_value,
  coalesce(arg_max(CASE WHEN etype IN ('PERSON','ORGANIZATION') AND fin<=c.char_start THEN raw END, CASE WHEN etype IN ('PERSON','ORGANIZATION') AND fin<=c.char_start THEN start END),
    arg_min(CASE WHEN etype IN ('PERSON','ORGANIZATION') THEN raw END, CASE WHEN etype IN ('PERSON','ORGANIZATION') THEN dist*100000+start END)) AS actor
 FROM (SELECT c.evidence_id, label, trg, c.char_start, pol, modl, tense, m.etype, m.raw, m.start, m.start+length(m.raw) AS fin,
     abs(2*m.start+length(m.raw)-2*c.char_start-length(trg)) AS dist
   FROM cand c JOIN men m ON m.evidence_id=c.evidence_id AND (
     m.start BETWEEN strpos(c.text,s)-1 AND strpos(c.text,s)-1+length(s) OR m.start+length(m.raw) BETWEEN strpos(c.text,s)-1 AND strpos(c.text,s)-1+length(s)
     OR least(abs(m.start-c.char_start-length(trg)), abs(m.start+length(m.raw)-c.char_start))<=300)) c GROUP BY ALL"""


def _email(s, p):
    return entities.extract(prose(s, p), "email").groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("emails"), F.array_join(F.array_sort(F.collect_set("raw")), " ").alias("addresses")
    )


def _page_emails(s, p):
    d = ct.table(s, p, "pages").select(F.col("page_id").cast("string").alias("evidence_id"), F.col("html").alias("text"))
    return entities.extract(d, "email", "url").groupBy("evidence_id", "rule").agg(F.count(F.lit(1)).alias("matches"))


def _phones(s, p):
    """Documents with phone-like numbers of 7 to 15 digits and how many."""
    m = entities.extract(prose(s, p), "phone")
    ok = F.length(F.regexp_replace("raw", r"\D", "")).between(7, 15)
    return m.where(ok).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("phones"))


def _normalize(s, p):
    d = prose(s, p).select(F.col("evidence_id").alias("text_id"), F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("​!\r")).alias("text"))
    n = text.normalize_text(d)
    return n.select(
        "text_id", F.md5("norm_text").alias("norm_md5"), F.size("offset_map").alias("chunks"),
        F.element_at("offset_map", 1)["raw_start"].alias("first_raw_start"), F.element_at("offset_map", -1)["raw_end"].alias("last_raw_end"),
        F.try_element_at("offset_map", F.lit(2))["raw_start"].alias("second_raw_start"),
    )


NORMALIZE_SQL = f"""WITH {PROSE} SELECT evidence_id AS text_id, md5(text||'!'||chr(10)) AS norm_md5, CAST(ceil((length(text)+2)/50.0) AS BIGINT) AS chunks,
  1 AS first_raw_start, 1+length(replace(text,chr(10),chr(13)||chr(10)))+3 AS last_raw_end,
  CASE WHEN length(text)+2>50 THEN CASE WHEN length(text)>=50 THEN 1+length(replace(substr(text,1,50),chr(10),chr(13)||chr(10))) ELSE 1+length(replace(text,chr(10),chr(13)||chr(10)))+CASE WHEN length(text)=49 THEN 2 ELSE 1 END END END AS second_raw_start FROM prose"""


def _raw_spans(s, p):
    t = prose(s, p).select(F.col("evidence_id").alias("text_id"), F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"), F.length("text").alias("n"))
    sp = t.select("text_id", (F.col("n") / 2).cast("int").alias("norm_start"), F.col("n").alias("norm_end"))
    return text.map_span_to_raw(sp, t).select("text_id", "norm_start", "norm_end", "raw_start", "raw_end")


RAW_SPAN_SQL = f"""WITH {PROSE} SELECT evidence_id AS text_id, length(text)//2 AS norm_start, length(text) AS norm_end,
  length(replace(substr(text,1,length(text)//2),chr(10),chr(13)||chr(10))) AS raw_start, length(replace(text,chr(10),chr(13)||chr(10))) AS raw_end FROM prose"""


def _quality(s, p):
    d = ct.table(s, p, "documents").select(
        F.col("doc_id").alias("evidence_id"), F.lit(1).alias("page_no"), "text",
        F.when(F.col("doc_id") % 7 == 0, 0.5).alias("token_confidence"), (F.col("doc_id") % 11 == 0).alias("has_raster"),
        F.when(F.col("doc_id") % 11 == 0, 1e12).otherwise(1.0).alias("page_area"),
    )
    return text.page_quality(d)


QUALITY = f"""q AS (SELECT doc_id AS evidence_id, text, length(text) AS n, doc_id,
   len(list_filter(regexp_split_to_array(text,'[\\s\\x{{00A0}}\\x{{2028}}]+'), lambda w: w<>'')) AS words,
   len(list_filter(regexp_split_to_array(text,'[\\s\\x{{00A0}}\\x{{2028}}]+'), lambda w: lower(w) IN ({",".join(repr(w) for w in rules.DISPUTE_WORDS)}))) AS known,
   length(regexp_replace(text,'[^\\p{{L}}\\p{{N}}]','','g')) AS alnum, length(text)-length(replace(text,chr(65533),'')) AS glyphs,
   CASE WHEN doc_id%7=0 THEN 0.5 ELSE 1.0 END AS conf, doc_id%11=0 AS scanned FROM documents),
q2 AS (SELECT *, CASE WHEN scanned OR glyphs/n>0.05 THEN 'OCR_RECOMMENDED' WHEN conf<0.55 OR alnum/n<0.45 THEN 'REVIEW_NEEDED' ELSE 'PASS' END AS state FROM q)"""


def _doc_quality(s, p):
    q = text.page_quality(pages(s, p).withColumn("token_confidence", F.when((F.col("page_no") == 2) & F.col("evidence_id").endswith("7"), 0.4).otherwise(0.9)))
    return text.document_quality(q).select("evidence_id", "quality_state", "raw_character_count", "word_count", "mean_token_confidence", "page_count")


def _route(s, p):
    native = pages(s, p).withColumn(
        "quality_state", F.when(F.col("evidence_id").rlike("[37]$"), "OCR_RECOMMENDED").otherwise("PASS")
    )
    ocr = native.where(F.col("evidence_id").endswith("3")).select("evidence_id", "page_no", F.upper("text").alias("text"), F.lit("PASS").alias("quality_state"))
    return text.route_pages(native, ocr).select("evidence_id", "page_no", F.md5("text").alias("text_md5"), "quality_state", "method")


def _spans_on_pages(s, p):
    """Mentions of each document with their page, over the assembled two-page text."""
    pg = pages(s, p)
    docs = text.assemble_documents(pg)
    found = entities.extract(docs, "order", "date_iso", "date_numeric").select("evidence_id", "rule", "start", "end", "raw")
    return text.attach_pages(found, pg).select("evidence_id", "raw", "start", "page_number", "page_relative_start")


def _boxes(s, p):
    t = text.clean_ocr_tokens(tokens(s, p).withColumn("confidence", F.lit(90.0)))
    pg = text.layout_from_tokens(t).select(F.concat_ws("#", "evidence_id", "page_no").alias("evidence_id"), "text")
    found = entities.extract(pg, "date_day_first")
    key = F.split("evidence_id", "#")
    sp = found.select(F.element_at(key, 1).alias("evidence_id"), F.element_at(key, 2).cast("int").alias("page_no"), "start", "end", "raw")
    sp = tc.by_document(s, p, sp)  # the id was taken apart, so spans have to be moved back, once
    return text.attach_bbox(sp, t).select("evidence_id", "page_no", "raw", "x0", "y0", "x1", "y1")


def _cer(s, p):
    d = ct.table(s, p, "benchmark").select(
        F.col("item_id").alias("sample_id"), F.col("text").alias("reference"), F.replace("text", F.lit("e"), F.lit("3")).alias("baseline"),
        F.replace("text", F.lit("th"), F.lit("t")).alias("improved"),
    )
    return text.cer_report(d)


CER_SQL = """WITH c AS (SELECT item_id AS sample_id, round(levenshtein(trim(text), trim(replace(text,'e','3')))/length(trim(text)),4) AS a,
   round(levenshtein(trim(text), trim(replace(text,'th','t')))/length(trim(text)),4) AS b FROM benchmark)
 SELECT sample_id, a AS baseline_cer, b AS improved_cer, round(a-b,4) AS cer_delta, CASE WHEN round(a-b,4)>0 THEN 'IMPROVED' WHEN round(a-b,4)<0 THEN 'DEGRADED' ELSE 'UNCHANGED' END AS verdict FROM c"""


def _states(s, p):
    return results(s, p).select("evidence_id", "context_sentence", "label", "decision_state", "polarity", "modality", "tense", "trigger_raw_text", "char_start", "is_compound_sentence")


STATES_SQL = """SELECT evidence_id, s AS context_sentence, label, CASE WHEN k=10 THEN 'VALIDATED' ELSE state END AS decision_state, pol AS polarity, modl AS modality, tense, trg AS trigger_raw_text,
  CASE WHEN trg IS NOT NULL THEN CAST(strpos(text,s)-1+strpos(s,trg)-1 AS INTEGER) END AS char_start, k=9 AS is_compound_sentence FROM se"""


def _predicted(s, p):
    """Labels from a model table: all shipments called deliveries, one unknown label, some unsure ones."""
    sent = events.with_candidates(events.split_sentences(tc.documents(s, p)))
    first = F.try_element_at("candidates", F.lit(1))["etype"]
    preds = sent.where(first.isin("ITEM_SHIPPED", "ORDER_PLACED", "SUPPORT_CONTACTED")).select(
        "evidence_id", "sent_ix",
        F.when(first == "ITEM_SHIPPED", "ITEM_DELIVERED").when(first == "ORDER_PLACED", "ORDER_TELEPORTED").otherwise(first).alias("label"),
        F.when(first == "SUPPORT_CONTACTED", 0.5).otherwise(0.99).alias("confidence"),
    )
    r = events.validate_sentences(annotated(s, p), preds)
    return r.where(F.col("label").isin("ITEM_DELIVERED", "ORDER_TELEPORTED", "SUPPORT_CONTACTED")).select(
        "evidence_id", "label", "decision_state", F.array_join("review_reasons", ";").alias("reasons"),
        F.array_join("validation_errors", ";").alias("errors"), "trigger_raw_text",
    )


PREDICTED_SQL = """SELECT evidence_id, CASE label WHEN 'ITEM_SHIPPED' THEN 'ITEM_DELIVERED' WHEN 'ORDER_PLACED' THEN 'ORDER_TELEPORTED' ELSE label END AS label,
  CASE label WHEN 'ORDER_PLACED' THEN 'REJECTED' WHEN 'SUPPORT_CONTACTED' THEN 'REVIEW_NEEDED' ELSE 'VALIDATED' END AS decision_state,
  CASE WHEN label='SUPPORT_CONTACTED' THEN 'Model classification confidence (0.5000) below validation threshold (0.7).' ELSE '' END AS reasons,
  CASE WHEN label='ORDER_PLACED' THEN 'Predicted type ''ORDER_TELEPORTED'' is not an approved canonical EventType.' ELSE '' END AS errors,
  CASE label WHEN 'ORDER_PLACED' THEN NULL WHEN 'ITEM_SHIPPED' THEN s ELSE trg END AS trigger_raw_text
 FROM se WHERE label IN ('ITEM_SHIPPED','ORDER_PLACED','SUPPORT_CONTACTED')"""


def _consolidated(s, p):
    e = events.consolidate_events(results(s, p))
    return e.select("evidence_id", "event_type", "polarity", "modality", "decision_state", F.size("corroborating_mentions").alias("corroborations"))


CONSOLIDATED_SQL = """SELECT evidence_id, label AS event_type, pol AS polarity, modl AS modality, state AS decision_state, 0 AS corroborations FROM se WHERE label<>'NO_EVENT'"""


def _doubled(s, p):
    """Every document said twice: each event must come back once, with one corroborating mention."""
    d = tc.documents(s, p).select("evidence_id", F.concat_ws("\n\n", F.element_at(F.split("text", "\n"), 2), F.element_at(F.split("text", "\n"), 2)).alias("text"))
    e = events.run_cascade(entities.annotate(d))
    return e.select(
        "evidence_id", "event_type", "char_start", "transaction_reference", F.size("corroborating_mentions").alias("corroborations"),
        F.element_at("corroborating_mentions", 1)["char_start"].alias("second_start"),
    )


DOUBLED_SQL = """SELECT evidence_id, label AS event_type, 0 AS char_start, substr(s, strpos(s,'TXN-'), 13) AS transaction_reference,
  1 AS corroborations, length(s)+2 AS second_start FROM se WHERE k=3"""


def _rows(s, p):
    d = tc.documents(s, p).select("evidence_id", F.concat(F.lit("case_"), (F.col("ok") % 100).cast("string")).alias("case_id"), F.lit("usr_1").alias("user_id"))
    e = events.to_event_rows(events.validated_events(events.consolidate_events(results(s, p))), d, F.lit(1), F.concat(F.lit("run_"), F.col("evidence_id")))
    return e.select("case_id", "evidence_id", "event_type", "trigger_raw_text", "char_start", "processing_version", "processing_run_id", "decision_state")


def _guards(s, p):
    """Every guard's own cue phrase, attached to every order text."""
    label = F.element_at(F.array(*[F.lit(g[0]) for g in rules.LIFECYCLE_GUARDS]), (F.col("ok") % len(rules.LIFECYCLE_GUARDS)).cast("int") + 1)
    cue = F.element_at(F.array(*[F.lit(g[1][0]) for g in rules.LIFECYCLE_GUARDS]), (F.col("ok") % len(rules.LIFECYCLE_GUARDS)).cast("int") + 1)
    low = F.concat(cue, F.lit(" "), F.when(F.col("ok") % 16 >= 8, "delivered not").otherwise("ok"))
    return tc.documents(s, p).select("evidence_id", label.alias("label"), events.lifecycle_conflict(label, low).alias("reason"))


def _guards_sql():
    q = lambda x: "'" + x.replace("'", "''") + "'"
    arr = lambda i: "[" + ",".join(q(g[i]) for g in rules.LIFECYCLE_GUARDS) + "]"
    return sql(f"""SELECT evidence_id, {arr(0)}[ok%8+1] AS label,
      CASE WHEN ok%16>=8 AND ok%8 IN (0,7) THEN NULL ELSE {arr(3)}[ok%8+1] END AS reason FROM doc""")


def _taxonomy(s, p):
    rows = events.detect_triggers(tc.documents(s, p)).select("evidence_id", "event_type")
    li = ct.table(s, p, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("evidence_id"),
        F.element_at(F.array(*[F.lit(t) for t in rules.EVENT_TYPES + [rules.NO_EVENT]]), (F.col("l_partkey") % 29).cast("int") + 1).alias("event_type"),
    )
    return rows.unionByName(li)


TAX = "lt AS (SELECT label AS t FROM cand UNION ALL SELECT " + "[" + ",".join(f"'{t}'" for t in rules.EVENT_TYPES + [rules.NO_EVENT]) + "][l_partkey%29+1] FROM lineitem)"


def _tax_case():
    parts = [f"WHEN t IN ({','.join(repr(x) for x in rules.CANONICAL_TYPES)}) THEN 'CANONICAL'",
             f"WHEN t IN ({','.join(repr(x) for x in rules.ALIASES)}) THEN 'COMPATIBILITY_ALIAS'",
             f"WHEN t IN ({','.join(repr(x) for x in rules.LEGACY_TYPES)}) THEN 'LEGACY_DISPUTE'", "WHEN t='NO_EVENT' THEN 'NEGATIVE_SAMPLE'"]
    return "CASE " + " ".join(parts) + " END"


def _canonical_case():
    return "CASE " + " ".join(f"WHEN t='{a}' THEN '{b}'" for a, b in rules.ALIASES.items()) + f" WHEN t IN ({','.join(repr(x) for x in rules.CANONICAL_TYPES)},'NO_EVENT') THEN t END"


def _summary(s, p):
    from factloom.operators import versions

    a = annotated(s, p)
    docs = tc.documents(s, p).select("evidence_id", F.when(F.col("ok") % 10 == 0, F.element_at(F.split("text", "\n"), -1)).when(F.col("ok") % 10 == 1, "").otherwise(F.col("text")).alias("text"))
    ev = results(s, p).where(F.col("has_event") & ~F.substring("evidence_id", -1, 1).isin("0", "1"))
    return versions.extraction_summary(docs, entities.mentions(a), ev)


SUMMARY_SQL = """SELECT d.evidence_id, CASE WHEN ok%10=0 THEN length(s10) WHEN ok%10=1 THEN 0 ELSE length(text) END AS character_count, 15 AS entities_extracted,
  CASE WHEN ok%10 IN (0,1) THEN 0 ELSE 7 END AS events_extracted,
  CASE WHEN ok%10=1 THEN 'Document text is empty; no textual content available for event extraction.'
   WHEN ok%10=0 THEN 'Document text consists of non-affirmative disclaimers or simulated statements; no validated real-world lifecycle events were asserted.' END AS diagnostic FROM txt d"""


def _safety(s, p):
    return evaluation.safety_checks(entities.mentions(annotated(s, p)))


SAFETY_SQL = """SELECT true AS money_exact, count(*) FILTER (etype='DATE' AND confidence=0.75) AS ambiguous_dates_kept, 0 AS unanchored_phones,
  count(*) FILTER (etype='TRANSACTION_ID' AND confidence=0.75) AS ocr_ambiguous_ids FROM men"""


def _entity_scores(s, p):
    g = tc.documents(s, p).select("evidence_id", F.explode(F.array(
        F.struct(F.lit("ORDER_ID").alias("etype"), F.element_at(F.split("text", " "), 2).alias("raw")),
        F.struct(F.lit("ORGANIZATION").alias("etype"), F.lit("FedEx").alias("raw")),
        F.struct(F.lit("URL").alias("etype"), F.lit("http://x").alias("raw")),
    )).alias("g")).select(F.col("evidence_id").alias("document_id"), "g.*")
    m = entities.mentions(annotated(s, p), ["ORDER_ID", "ORGANIZATION"]).withColumnRenamed("evidence_id", "document_id")
    return evaluation.total_scores(evaluation.entity_scores(g, m))


def _grounding(s, p):
    e = results(s, p).where("has_event").withColumn("char_start", F.when(F.col("evidence_id").endswith("9"), F.col("char_start") + 1).otherwise(F.col("char_start")))
    return evaluation.grounding_rate(e, tc.documents(s, p))


GROUNDING_SQL = """SELECT count(*) AS events, count(*) FILTER (evidence_id NOT LIKE '%9') AS grounded, round(avg(CASE WHEN evidence_id NOT LIKE '%9' THEN 1.0 ELSE 0.0 END),4) AS grounding_rate FROM se WHERE label<>'NO_EVENT'"""


def _span_check(s, p):
    m = entities.mentions(annotated(s, p), ["PHONE_NUMBER"]).select(
        "evidence_id", F.when(F.col("evidence_id").endswith("3"), F.col("start") - 1000000).otherwise(F.col("start")).alias("start"), "end",
        F.when(F.col("evidence_id").endswith("4"), F.lit("x")).otherwise(F.col("raw")).alias("raw"),
    )
    return events.check_grounding(m, tc.documents(s, p)).select("evidence_id", F.substring_index("grounding_error", ":", 1).alias("problem"))


def _matched(s, p):
    """Gold from the rendering rules against extracted events, k-th to k-th."""
    d = tc.documents(s, p)
    ok = F.col("ok")
    gold = d.select(F.col("evidence_id").alias("case_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("gold_ix"), F.lit("REFUND_COMPLETED").alias("event_type"), F.when(ok % 3 == 0, "NEGATED").otherwise("POSITIVE").alias("gold_polarity"),
                 F.when(ok % 3 == 0, "ASSERTED").when(ok % 3 == 1, "PLANNED").otherwise("UNCERTAIN").alias("gold_modality"),
                 F.when(ok % 3 == 1, "FUTURE").otherwise("PAST").alias("gold_tense"), F.lit(True).alias("gold_has_amount"), F.lit(False).alias("gold_missing_order")),
        F.struct(F.lit(2).alias("gold_ix"), F.lit("REFUND_COMPLETED").alias("event_type"), F.lit("POSITIVE").alias("gold_polarity"),
                 F.lit("CONDITIONAL").alias("gold_modality"), F.lit("PAST").alias("gold_tense"), F.lit(False).alias("gold_has_amount"), F.lit(True).alias("gold_missing_order")),
    )).alias("g")).select("case_id", "g.*").withColumns({c: F.lit(False) for c in ("gold_has_order", "gold_has_txn", "gold_has_temporal", "gold_missing_amount")})
    e = events.extract_events(annotated(s, p)).withColumnRenamed("evidence_id", "case_id")
    return evaluation.nuance_accuracy(evaluation.match_events(gold, e))


def register(add) -> None:
    add("normalize_text", _normalize, NORMALIZE_SQL)
    add("map_span_to_raw", _raw_spans, RAW_SPAN_SQL)
    add("page_quality", lambda s, p: _quality(s, p).select(
        "evidence_id", "raw_character_count", "word_count", "alphanumeric_ratio", "dictionary_word_ratio", "mean_token_confidence",
        "suspected_glyph_substitution_count", "is_scanned_page", "quality_state"),
        f"WITH {QUALITY} SELECT evidence_id, n AS raw_character_count, words AS word_count, round(alnum/n,4) AS alphanumeric_ratio, round(known/words,4) AS dictionary_word_ratio, conf AS mean_token_confidence, glyphs AS suspected_glyph_substitution_count, scanned AS is_scanned_page, state AS quality_state FROM q2")
    add("document_quality", _doc_quality, sql("""SELECT evidence_id, CASE WHEN evidence_id LIKE '%7' THEN 'REVIEW_NEEDED' ELSE 'PASS' END AS quality_state,
        sum(length(text)) AS raw_character_count, sum(len(regexp_split_to_array(text,'\\s+'))) AS word_count,
        CASE WHEN evidence_id LIKE '%7' THEN 0.65 ELSE 0.9 END AS mean_token_confidence, 2 AS page_count FROM pg GROUP BY evidence_id""", PAGES))
    add("assemble_documents", lambda s, p: text.assemble_documents(pages(s, p)).select("evidence_id", F.md5("text").alias("text_md5"), "page_count"),
        sql("SELECT evidence_id, md5(page_one||chr(10)||chr(10)||page_two) AS text_md5, 2 AS page_count FROM doc"))
    add("page_offsets", lambda s, p: text.page_offsets(pages(s, p)),
        sql("SELECT evidence_id, page_no, CASE WHEN page_no=1 THEN 0 ELSE length(page_one)+2 END AS page_start, length(pg.text) AS page_length FROM pg JOIN doc USING (evidence_id)", PAGES))
    add("clean_ocr_tokens", lambda s, p: text.clean_ocr_tokens(tokens(s, p)).select(
        "evidence_id", "page_no", "line_no", "word_ix", "word", F.round("confidence", 4).alias("confidence"), *[F.element_at("box", i + 1).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]),
        sql("""SELECT evidence_id, page_no, line_no, word_ix, word, least(1.0, round(length(word)*12/100.0,4)) AS confidence, word_ix*10.0 AS x0, line_no*20.0 AS y0,
          word_ix*10.0+9 AS x1, line_no*20.0+18 AS y1 FROM tk WHERE length(word)<>2""", TOKENS))
    add("layout_from_tokens", lambda s, p: text.layout_from_tokens(text.clean_ocr_tokens(tokens(s, p).withColumn("confidence", F.lit(90.0)))).select(
        "evidence_id", "page_no", F.md5("text").alias("text_md5"), "blocks", "lines", F.round("token_confidence", 4).alias("token_confidence")),
        sql("SELECT evidence_id, page_no, md5(text) AS text_md5, 1 AS blocks, len(string_split(text,chr(10))) AS lines, 0.9 AS token_confidence FROM pg", PAGES))
    add("token_offsets", lambda s, p: text.token_offsets(tokens(s, p)).select("evidence_id", "page_no", "line_no", "word_ix", "word", "char_start", "char_end"),
        sql("""SELECT evidence_id, page_no, line_no, word_ix, word, CAST(e-length(word) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM (SELECT *,
          sum(length(word)+1) OVER (PARTITION BY evidence_id, page_no ORDER BY line_no, word_ix)-1 AS e FROM tk)""", TOKENS))
    add("route_pages", _route, sql("""SELECT evidence_id, page_no, CASE WHEN evidence_id LIKE '%3' THEN md5(upper(text)) ELSE md5(text) END AS text_md5,
        CASE WHEN evidence_id LIKE '%7' THEN 'REVIEW_NEEDED' ELSE 'PASS' END AS quality_state, CASE WHEN evidence_id LIKE '%3' THEN 'OCR' ELSE 'NATIVE_PDF' END AS method FROM pg""", PAGES))
    add("attach_pages", _spans_on_pages, sql("""SELECT evidence_id, raw, CASE WHEN k=1 THEN r ELSE r+length(page_one)+2 END AS start, k AS page_number, r AS page_relative_start FROM (
        SELECT evidence_id, page_one, 1 AS k, 'Order ORD-'||pad AS x, 'ORD-'||pad AS raw, 6 AS r FROM txt
        UNION ALL SELECT evidence_id, page_one, 1, '', CAST(day AS VARCHAR), strpos(page_one,' placed on ')+10 FROM txt
        UNION ALL SELECT evidence_id, page_one, 2, '', strftime(rday,'%d/%m/%Y'), strpos(page_two,'credited on ')+11 FROM txt
        UNION ALL SELECT evidence_id, page_one, 2, '', 'ORD-'||pad, strpos(page_two,'for order ')+9 FROM txt)""").replace("'ORD-'||pad AS raw, 6", "'Order ORD-'||pad AS raw, 0").replace("'ORD-'||pad, strpos(page_two,'for order ')+9", "'order ORD-'||pad, strpos(page_two,'for order ')+3"))
    add("attach_bbox", _boxes, sql("""SELECT evidence_id, 1 AS page_no, day(sday)||' '||mn[month(sday)]||' '||year(sday) AS raw, 50.0 AS x0, 40.0 AS y0, 79.0 AS x1, 58.0 AS y1 FROM doc"""))
    add("cer_report", _cer, CER_SQL)
    add("split_sentences", lambda s, p: events.split_sentences(tc.documents(s, p)).select("evidence_id", "s_start", "s_end", "s_text"),
        sql("SELECT evidence_id, CAST(strpos(text,s)-1 AS BIGINT) AS s_start, CAST(strpos(text,s)-1+length(s) AS BIGINT) AS s_end, s AS s_text FROM se", SENTENCES))
    add("email_mentions_in_prose", _email, f"""WITH {PROSE}, e AS (SELECT evidence_id, unnest(regexp_extract_all(text,'\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,7}}\\b')) AS m FROM prose)
        SELECT evidence_id, count(*) AS emails, array_to_string(list_sort(list(DISTINCT m)),' ') AS addresses FROM e GROUP BY 1""")
    add("email_and_url_in_pages", _page_emails, """WITH e AS (SELECT CAST(page_id AS VARCHAR) AS evidence_id, 'email' AS rule, unnest(regexp_extract_all(html,'\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,7}\\b')) AS m FROM pages
        UNION ALL SELECT CAST(page_id AS VARCHAR), 'url', unnest(regexp_extract_all(html,'(?i)\\bhttps?://[A-Za-z0-9.\\-]+(?::\\d+)?(?:/[^\\s<>''"`]*)?')) FROM pages)
        SELECT evidence_id, rule, count(*) AS matches FROM e GROUP BY ALL""")
    add("phone_numbers_in_prose", _phones)
    for name, etypes in [
        ("mentions_ids", ["ORDER_ID", "TRANSACTION_ID", "REFUND_ID", "INVOICE_ID"]), ("mentions_dates", ["DATE"]),
        ("mentions_times", ["TIME", "RELATIVE_TIME"]), ("mentions_people", ["PERSON", "ORGANIZATION"]),
        ("mentions_money", ["MONETARY_AMOUNT"]), ("mentions_phones", ["PHONE_NUMBER"]),
    ]:
        add(name, *_mention_query(etypes))
    add("normalized_money", _money, sql("""SELECT evidence_id, raw, CAST(replace(regexp_replace(raw,'[^0-9.,]','','g'),',','') AS DOUBLE) AS value,
        CASE WHEN raw LIKE '$%' THEN 'USD' ELSE substr(raw,1,3) END AS currency FROM men WHERE etype='MONETARY_AMOUNT'""", EXPECTED))
    add("normalized_phones", _phone, sql("SELECT evidence_id, '+91' AS country_code, replace(raw,' ','') AS e164 FROM men WHERE etype='PHONE_NUMBER'", EXPECTED))
    add("ambiguous_dates", _ambiguous, sql("""SELECT evidence_id, strftime(rday,'%d/%m/%Y') AS raw, strftime(rday,'%Y-%m-%d') AS day_first, strftime(rday,'%Y-%d-%m') AS month_first FROM txt WHERE day(rday)<=12"""))
    add("relative_times", _relative, sql("""SELECT evidence_id, 'yesterday' AS raw, CASE WHEN anchor IS NULL THEN 'UNRESOLVED_NO_ANCHOR' ELSE 'RESOLVED_WITH_ANCHOR' END AS status, CAST(CAST(anchor AS DATE)-1 AS VARCHAR) AS computed FROM txt"""))
    add("mention_counts_in_prose", lambda s, p: entities.mentions(entities.annotate(prose(s, p))).groupBy("etype").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("grounded")).alias("grounded")))
    add("detect_triggers", lambda s, p: events.detect_triggers(tc.documents(s, p)).select("evidence_id", "event_type", "trigger_raw_text", "char_start", "polarity", "modality", "tense", F.round("model_confidence", 2).alias("model_confidence")),
        sql("""SELECT evidence_id, label AS event_type, trg AS trigger_raw_text, char_start, pol AS polarity, modl AS modality, tense,
          CASE WHEN pol='NEGATED' THEN 0.92 WHEN modl<>'ASSERTED' THEN 0.9 ELSE 0.95 END AS model_confidence FROM cand""", SENTENCES))
    add("disclaimers", lambda s, p: events.with_nuances(events.split_sentences(tc.documents(s, p))).where("disclaimer").select("evidence_id", "s_text"),
        sql("SELECT evidence_id, s10 AS s_text FROM doc WHERE s10 IS NOT NULL"))
    add("extract_events", _bound, sql(BOUND_SQL, EXPECTED + "," + SENTENCES))
    add("validate_sentences", _states, sql(STATES_SQL, SENTENCES))
    add("validate_with_predictions", _predicted, sql(PREDICTED_SQL, SENTENCES))
    add("lifecycle_guards", _guards, _guards_sql)
    add("check_grounding", _span_check, sql("""SELECT evidence_id, CASE WHEN evidence_id LIKE '%3' THEN 'Invalid trigger offsets' WHEN evidence_id LIKE '%4' THEN 'Trigger mismatch' END AS problem FROM doc"""))
    add("consolidate_events", _consolidated, sql(CONSOLIDATED_SQL, SENTENCES))
    add("consolidate_repeated_statements", _doubled, sql(DOUBLED_SQL, SENTENCES))
    add("stored_event_rows", _rows, sql("""SELECT 'case_'||(ok%100) AS case_id, evidence_id, label AS event_type, trg AS trigger_raw_text, CAST(strpos(text,s)-1+strpos(s,trg)-1 AS INTEGER) AS char_start,
        1 AS processing_version, 'run_'||evidence_id AS processing_run_id, state AS decision_state FROM se WHERE label<>'NO_EVENT' AND state='VALIDATED'""", SENTENCES))
    add("map_taxonomy", lambda s, p: events.map_taxonomy(_taxonomy(s, p)).groupBy("event_type", "canonical_event_type", "taxonomy_category", "is_canonical").agg(F.count(F.lit(1)).alias("rows")),
        sql(f"SELECT t AS event_type, {_canonical_case()} AS canonical_event_type, {_tax_case()} AS taxonomy_category, {_canonical_case()} IS NOT NULL AS is_canonical, count(*) AS rows FROM lt GROUP BY ALL", SENTENCES + "," + TAX))
    add("taxonomy_summary", lambda s, p: events.taxonomy_summary(_taxonomy(s, p)),
        sql(f"SELECT {_tax_case()} AS taxonomy_category, count(DISTINCT t) AS labels, count(*) AS rows FROM lt GROUP BY 1", SENTENCES + "," + TAX))
    add("event_categories", lambda s, p: _taxonomy(s, p).groupBy(events.event_category(F.col("event_type")).alias("category")).agg(F.count(F.lit(1)).alias("rows")),
        sql("SELECT CASE " + " ".join(f"WHEN t IN ({','.join(repr(x) for x in ts)}) THEN '{c}'" for c, ts in rules.EVENT_CATEGORIES.items()) + " END AS category, count(*) AS rows FROM lt GROUP BY 1", SENTENCES + "," + TAX))
    add("extraction_summary", _summary, sql(SUMMARY_SQL))
    add("safety_checks", _safety, sql(SAFETY_SQL, EXPECTED))
    add("entity_scores", _entity_scores, sql("""SELECT 3*count(*) AS gold, 3*count(*) AS extracted, 2*count(*) AS tp, 0.6667 AS precision, 0.6667 AS recall, 0.6667 AS f1 FROM doc"""))
    add("grounding_rate", _grounding, sql(GROUNDING_SQL, SENTENCES))
    add("event_match_accuracy", _matched, sql("""SELECT 2*count(*) AS matched, 1.0 AS negation_accuracy, 1.0 AS modality_accuracy, round(count(*)/(2.0*count(*)),4) AS argument_accuracy FROM doc"""))
