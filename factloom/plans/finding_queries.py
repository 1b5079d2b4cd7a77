"""Registered queries: cross-document findings, versions and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import rules, session
from factloom.functions import refs
from factloom.operators import evaluation, findings, versions
from factloom.plans import case_tables as ct
from factloom.plans.case_tables import sql

SHOWN = [
    "case_id", "finding_id", "kind", "finding_type", "title", "summary", "severity", "conflict_state",
    "reference", "event_a", "event_b", "evidence_a", "evidence_b", "field", "value_a", "source_a", "value_b",
    "source_b",
]


def active(spark, sf) -> DataFrame:
    """Active events as they lie by case: what compares the documents of a case needs no other shuffle."""
    return versions.active_events(ct.events(spark, sf, "case_id"), ct.evidence(spark, sf))


def members(spark, sf) -> DataFrame:
    return findings.comparable_events(active(spark, sf))


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN, F.round("model_confidence", 4).alias("model_confidence"))


REFX = """
refx AS (SELECT act.*, okey AS ref_key, 0 AS pos, trim(order_reference) AS disp FROM act WHERE okey IS NOT NULL
  UNION ALL SELECT act.*, tkey, 1, trim(transaction_reference) FROM act WHERE tkey IS NOT NULL AND tkey IS DISTINCT FROM okey),
grp AS (SELECT case_id, ref_key, count(*) AS group_size, first(disp ORDER BY created_at, event_id, pos) AS display_ref,
    min(strftime(created_at,'%Y-%m-%d %H:%M:%S')||' '||event_id||' '||pos) AS group_rank
  FROM refx GROUP BY ALL HAVING min(evidence_id)<max(evidence_id)),
mem AS (SELECT refx.*, display_ref, group_rank FROM refx JOIN grp USING (case_id, ref_key)),
pr AS (SELECT a.case_id, a.ref_key, a.display_ref, a.group_rank,
    a.event_id AS ea, b.event_id AS eb, a.evidence_id AS da, b.evidence_id AS db, a.source_name AS sa, b.source_name AS sb,
    a.source_name||' (p. '||a.page_number||')' AS pa, b.source_name||' (p. '||b.page_number||')' AS pb,
    a.event_type AS ta, b.event_type AS tb, a.amount_value AS va, b.amount_value AS vb, a.currency AS ca, b.currency AS cb,
    a.polarity AS pola, b.polarity AS polb, a.temporal_information AS tia, b.temporal_information AS tib,
    a.model_confidence AS cfa, b.model_confidence AS cfb,
    (a.decision_state='REVIEW_NEEDED' OR b.decision_state='REVIEW_NEEDED') AS rev
  FROM mem a JOIN mem b ON a.case_id=b.case_id AND a.ref_key=b.ref_key AND a.evidence_id<>b.evidence_id
    AND (a.created_at<b.created_at OR (a.created_at=b.created_at AND a.event_id<b.event_id))),
pu AS (SELECT *, (rev OR cfa<0.7 OR cfb<0.7) AS unsure FROM pr)
"""
FIELDS = "field, value_a, source_a, value_b, source_b"
VERIFY = "but extraction certainty is flagged for review. Manual verification is advised before evaluating inconsistency."


def fid(kind: str, disc: str, a: str = "ea", b: str | None = "eb") -> str:
    ids = f"least({a},{b})||'|'||greatest({a},{b})" if b else a
    return f"'fnd_'||substr(sha256(case_id||'|'||{kind}||'|'||{disc}||'|'||{ids}),1,16)"


def money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def words(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}),'_'), lambda w: upper(w[1])||w[2:]),' ')"


def pair_sql(kind, title, summary, severity, state, field, va, vb, src, disc="ref_key"):
    return f"""SELECT case_id, {fid(kind, disc)} AS finding_id, {kind} AS kind, 'POTENTIAL_INCONSISTENCY' AS finding_type,
      {title} AS title, {summary} AS summary, {severity} AS severity, {state} AS conflict_state, {disc} AS reference,
      ea AS event_a, eb AS event_b, da AS evidence_a, db AS evidence_b, {field} AS field, {va} AS value_a, pa AS source_a,
      {vb} AS value_b, pb AS source_b, round(least(cfa,cfb),4) AS model_confidence FROM {src}"""


def once(cond: str) -> str:
    return f"(SELECT * FROM pu WHERE {cond} QUALIFY row_number() OVER (PARTITION BY case_id, ea, eb ORDER BY group_rank)=1)"


SYM = "coalesce(nullif(ca,''),nullif(cb,''),'$')"
CURRENCY_SQL = pair_sql(
    "'CURRENCY_MISMATCH'", "'Potential Inconsistency: Currency Denomination Mismatch on Reference '||display_ref",
    "'Reference '''||display_ref||''' is denominated in '||ca||' in '||sa||' and in '||cb||' in '||sb||'. Direct numeric comparison requires exchange rate verification.'",
    "'MEDIUM'", "'POTENTIAL_CONFLICT'", "'Currency Denomination'", f"ca||' '||{money('va')}", f"cb||' '||{money('vb')}",
    "pr WHERE va IS NOT NULL AND vb IS NOT NULL AND ca<>'' AND cb<>'' AND ca<>cb",
)
AMOUNT_SQL = pair_sql(
    "CASE WHEN rev THEN 'MONETARY_DISCREPANCY_UNCERTAIN' ELSE 'MONETARY_DISCREPANCY_POTENTIAL' END",
    "CASE WHEN rev THEN 'Uncertain Comparison' ELSE 'Potential Inconsistency' END||': Amount Divergence on Reference '||display_ref",
    f"""CASE WHEN rev THEN 'Extracted amounts differ by '||{SYM}||{money('abs(va-vb)')}||' ('||{SYM}||{money('va')}||' vs '||{SYM}||{money('vb')}||'), {VERIFY}'
     ELSE replace(ta,'_',' ')||' ('||{SYM}||{money('va')}||' in '||sa||') differs from '||replace(tb,'_',' ')||' ('||{SYM}||{money('vb')}||' in '||sb||') by '||{SYM}||{money('abs(va-vb)')}||'. '||
       CASE WHEN ta<>tb THEN 'Differing stages allow for partial payments, adjustments, or fee structures.' ELSE 'Differing line items, tax inclusions, revisions, or partial milestones may account for this divergence.' END END""",
    "CASE WHEN rev THEN 'LOW' ELSE 'MEDIUM' END", "CASE WHEN rev THEN 'INSUFFICIENT_CONTEXT' ELSE 'POTENTIAL_CONFLICT' END",
    "'Amount'", f"{SYM}||{money('va')}", f"{SYM}||{money('vb')}",
    "pr WHERE va IS NOT NULL AND vb IS NOT NULL AND (ca=cb OR ca='' OR cb='') AND abs(va-vb)>0.01",
)
UNSURE = ("CASE WHEN unsure THEN 'LOW' ELSE 'MEDIUM' END", "CASE WHEN unsure THEN 'INSUFFICIENT_CONTEXT' ELSE 'POTENTIAL_CONFLICT' END")
POLARITY_SQL = pair_sql(
    "'POLARITY_CONFLICT'",
    "CASE WHEN unsure THEN 'Uncertain Comparison' ELSE 'Potential Inconsistency' END||': Opposing Assertion on '||replace(ta,'_',' ')||' ('||display_ref||')'",
    f"""CASE WHEN unsure THEN 'One document asserts this milestone positively while another asserts negative polarity for reference '''||display_ref||''', {VERIFY}'
      ELSE 'One document asserts this milestone positively, while another document asserts negative polarity for reference '''||display_ref||'''. This indicates divergent factual claims regarding whether this event occurred.' END""",
    *UNSURE, "'Assertion Polarity'", "pola", "polb", once("ta=tb AND pola<>polb"),
)
TSA, TSB = "try_cast(replace(tia,'Z','') AS TIMESTAMP)", "try_cast(replace(tib,'Z','') AS TIMESTAMP)"
RETRY = f"coalesce(CASE WHEN ta LIKE '%FAILED%' THEN {TSA}<{TSB} ELSE {TSB}<{TSA} END,false)"
DOMAIN = "CASE WHEN ta LIKE 'PAYMENT%' THEN 'Payment Settlement Outcome' ELSE 'Refund Processing Outcome' END"
OUTCOME_SQL = pair_sql(
    "'OUTCOME_CONFLICT'",
    f"CASE WHEN unsure THEN 'Uncertain Comparison' ELSE 'Potential Inconsistency' END||': Opposing Outcome on '||{DOMAIN}||' ('||display_ref||')'",
    f"""CASE WHEN unsure THEN 'One document asserts '''||{words('ta')}||''' while another asserts '''||{words('tb')}||''' for reference '''||display_ref||''', {VERIFY}'
      ELSE 'One document asserts '''||{words('ta')}||''' ('||sa||') while another asserts '''||{words('tb')}||''' ('||sb||') for reference '''||display_ref||'''.'||
       CASE WHEN {RETRY} THEN ' Chronological records indicate a failed attempt followed by a subsequent successful settlement (probable retry).' ELSE ' Chronology, retry attempts, or asynchronous gateway settlement latencies should be verified before inferring an operational conflict.' END END""",
    f"CASE WHEN unsure OR {RETRY} THEN 'LOW' ELSE 'MEDIUM' END", UNSURE[1], "'Transaction Status'", words("ta"), words("tb"),
    once("(ta,tb) IN (('PAYMENT_MADE','PAYMENT_FAILED'),('PAYMENT_FAILED','PAYMENT_MADE'),('REFUND_COMPLETED','REFUND_FAILED'),('REFUND_FAILED','REFUND_COMPLETED'))"),
)
DATE_SQL = pair_sql(
    "'DATE_DISCREPANCY'", f"'Potential Inconsistency: Event Date Discrepancy on '||{words('ta')}||' ('||display_ref||')'",
    f"''''||{words('ta')}||''' is recorded on '||tia||' in '||sa||' and on '||tib||' in '||sb||' for reference '''||display_ref||'''. This indicates divergent chronological records regarding when this milestone occurred.'",
    "'MEDIUM'", "'POTENTIAL_CONFLICT'", "'Event Date'", "tia", "tib", once("ta=tb AND trim(tia)<>trim(tib)"),
)
DOCSET = """
ds AS (SELECT case_id, evidence_id, list_sort(list(DISTINCT okey)) AS rs, first(event_id ORDER BY created_at, event_id) AS ev,
   min(created_at) AS ca, first(model_confidence ORDER BY created_at, event_id) AS cf, first(source_name) AS sn
  FROM act WHERE okey IS NOT NULL GROUP BY ALL),
dp AS (SELECT a.case_id, a.rs[1] AS ra, b.rs[1] AS rb, a.ev AS ea, b.ev AS eb, a.evidence_id AS da, b.evidence_id AS db,
   a.sn AS pa, b.sn AS pb, a.cf AS cfa, b.cf AS cfb FROM ds a JOIN ds b ON a.case_id=b.case_id
   AND (a.ca<b.ca OR (a.ca=b.ca AND a.ev<b.ev)) AND NOT list_has_any(a.rs,b.rs))
"""
ORDER_REF_SQL = pair_sql(
    "'ORDER_REFERENCE_MISMATCH'",
    "'Potential Inconsistency: Divergent Order References Across Case Evidence ('||ra||' vs '||rb||')'",
    "'Evidence '''||pa||''' cites order reference '''||ra||''', whereas evidence '''||pb||''' cites order reference '''||rb||'''. Multiple discordant order identifiers within a single dispute case may indicate mismatched documentation or unrelated transactions.'",
    "'MEDIUM'", "'POTENTIAL_CONFLICT'", "'Order Reference'", "ra", "rb", "dp", disc="ra||'_'||rb",
)
DIVERGENCE_SQL = """SELECT a.case_id, CASE WHEN a.rs<b.rs THEN array_to_string(a.rs,',') ELSE array_to_string(b.rs,',') END AS refs_a,
  CASE WHEN a.rs<b.rs THEN array_to_string(b.rs,',') ELSE array_to_string(a.rs,',') END AS refs_b,
  CASE WHEN a.rs<b.rs THEN a.n ELSE b.n END AS documents_a, CASE WHEN a.rs<b.rs THEN b.n ELSE a.n END AS documents_b
  FROM (SELECT case_id, rs, count(*) AS n FROM ds GROUP BY ALL) a JOIN (SELECT case_id, rs, count(*) AS n FROM ds GROUP BY ALL) b
  ON a.case_id=b.case_id AND a.rs<b.rs AND NOT list_has_any(a.rs,b.rs)"""
NOFIELD = "NULL AS field, NULL AS value_a, NULL AS source_a, NULL AS value_b, NULL AS source_b"
REFD = "coalesce(okey,tkey)"
MISSING_SQL = f"""SELECT case_id, {fid("'MISSING_CORROBORATION_'||event_type", REFD, "event_id", None)} AS finding_id,
  'MISSING_CORROBORATION_'||event_type AS kind, 'MISSING_EVIDENCE_ADVISORY' AS finding_type,
  'Unconfirmed Transaction Reference ('||trim(coalesce(order_reference,transaction_reference))||')' AS title,
  CASE WHEN event_type='PAYMENT_SENT' THEN 'An outgoing transaction is asserted in evidence, but no corresponding settlement or confirmation document is present in the case. This indicates an uncorroborated claim or documentation gap, not proof of a contradiction.'
   ELSE 'A refund request or claim is asserted in evidence, but no corresponding settlement, refund completion, or payout confirmation document is present in the case. This indicates an uncorroborated claim or documentation gap, not proof of a contradiction.' END AS summary,
  'MEDIUM' AS severity, 'POTENTIAL_CONFLICT' AS conflict_state, {REFD} AS reference, event_id AS event_a, NULL AS event_b,
  evidence_id AS evidence_a, NULL AS evidence_b, {NOFIELD}, round(model_confidence,4) AS model_confidence
 FROM act x WHERE event_type IN ('PAYMENT_SENT','REFUND_REQUESTED','REFUND_INITIATED','REFUND_APPROVED') AND {REFD} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM act y WHERE y.case_id=x.case_id AND y.evidence_id<>x.evidence_id
   AND y.event_type IN ('PAYMENT_MADE','PAYMENT_CONFIRMED','REFUND_ISSUED','REFUND_PROCESSED','REFUND_COMPLETED')
   AND coalesce(y.okey,y.tkey)=coalesce(x.okey,x.tkey))"""
ZERO_SQL = f"""SELECT case_id, 'fnd_'||substr(sha256(case_id||'|ZERO_EVENT_EXTRACTION_ADVISORY|'||evidence_id||'|'),1,16) AS finding_id,
  'ZERO_EVENT_EXTRACTION_ADVISORY' AS kind, 'MISSING_EVIDENCE_ADVISORY' AS finding_type,
  CASE WHEN status='REVIEW_NEEDED' THEN 'Extraction Advisory: Manual Review Required for Evidence (' ELSE 'Extraction Advisory: Zero Actionable Events Extracted (' END||original_filename||')' AS title,
  CASE WHEN status='REVIEW_NEEDED' THEN 'Evidence document '''||original_filename||''' is flagged for manual review due to scan quality or low OCR confidence. Manual verification is recommended before evaluating factual consistency.'
   ELSE 'Uploaded evidence document '''||original_filename||''' produced zero validated business lifecycle events. The document may consist of legal disclaimers, non-actionable text, or non-dispute content.' END AS summary,
  'LOW' AS severity, 'INSUFFICIENT_CONTEXT' AS conflict_state, evidence_id AS reference, NULL AS event_a, NULL AS event_b,
  evidence_id AS evidence_a, NULL AS evidence_b, {NOFIELD}, 1.0 AS model_confidence
 FROM evi d WHERE (status='REVIEW_NEEDED' OR events_extracted=0)
  AND NOT EXISTS (SELECT 1 FROM act a WHERE a.evidence_id=d.evidence_id)
  AND EXISTS (SELECT 1 FROM evi e WHERE e.case_id=d.case_id AND e.active_processing_version>0)"""
TIMED = """
tm AS (SELECT *, coalesce(okey,tkey) AS rk, try_cast(replace(temporal_information,'Z','') AS TIMESTAMP) AS at FROM act),
tp AS (SELECT a.case_id, a.event_id AS ea, b.event_id AS eb, a.evidence_id AS da, b.evidence_id AS db, a.event_type AS ta, b.event_type AS tb,
   a.at AS aa, b.at AS ab, coalesce(a.rk,b.rk,'CASE_SCOPE') AS disc, a.model_confidence AS cfa, b.model_confidence AS cfb
  FROM tm a JOIN tm b ON a.case_id=b.case_id AND a.evidence_id<>b.evidence_id AND (a.rk IS NULL OR b.rk IS NULL OR a.rk=b.rk) AND b.at<a.at
   AND (a.event_type,b.event_type) IN (('ORDER_PLACED','ITEM_SHIPPED'),('REFUND_REQUESTED','REFUND_COMPLETED')))
"""
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')||'+00:00'"
TEMPORAL_KIND = "'TEMPORAL_VIOLATION_'||ta||'_'||tb"
TEMPORAL_SQL = f"""SELECT case_id, {fid(TEMPORAL_KIND, 'disc')} AS finding_id, {TEMPORAL_KIND} AS kind,
  'POTENTIAL_INCONSISTENCY' AS finding_type, 'Potential Inconsistency: Temporal Sequence Anomaly ('||disc||')' AS title,
  replace(tb,'_',' ')||' recorded at '||{ISO.format('ab')}||' precedes '||replace(ta,'_',' ')||' recorded at '||{ISO.format('aa')}||' for reference '''||disc||'''. Differing timezones, retrospective logging, or batch entry delays may account for this chronological inversion.' AS summary,
  'MEDIUM' AS severity, 'POTENTIAL_CONFLICT' AS conflict_state, disc AS reference, ea AS event_a, eb AS event_b, da AS evidence_a, db AS evidence_b,
  {NOFIELD}, round(least(cfa,cfb),4) AS model_confidence FROM tp"""

COUNTED = "SELECT kind, severity, conflict_state, count(*) AS findings, count(DISTINCT case_id) AS cases FROM ({}) GROUP BY ALL"


def all_found(spark, sf):
    return findings.all_findings(ct.evidence(spark, sf), ct.events(spark, sf, "case_id"))


def _summary(spark, sf):
    return all_found(spark, sf).groupBy("kind", "severity", "conflict_state").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("case_id").alias("cases")
    )


ALL_PARTS = [CURRENCY_SQL, AMOUNT_SQL, POLARITY_SQL, OUTCOME_SQL, DATE_SQL, ORDER_REF_SQL, MISSING_SQL, ZERO_SQL, TEMPORAL_SQL]
ALL_EXTRA = ",".join([REFX, DOCSET, TIMED])
ALL_SQL = " UNION ALL BY NAME ".join(f"({p})" for p in ALL_PARTS)


def _amount_pairs(spark, sf):
    """Order total against the sum of its line prices, for every order."""
    lines = ct.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount_b")
    )
    o = ct.table(spark, sf, "orders")
    ok = F.col("o_orderkey")
    pairs = o.join(lines, ok == F.col("l_orderkey")).select(
        ok.alias("order_key"), F.lit("Order").alias("label_a"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount_a"),
        F.when(ok % 3 == 0, " usd").otherwise("INR").alias("currency_a"), F.lit("Lines").alias("label_b"), "amount_b",
        F.when(ok % 5 == 0, "INR").when(ok % 3 == 0, "USD").otherwise("INR ").alias("currency_b"),
    )
    return findings.compare_amounts(pairs).select("order_key", "title", "summary", "severity", "conflict_state")


def _identifier_pairs(spark, sf):
    ok = F.col("o_orderkey").cast("string")
    pairs = ct.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.concat(F.lit("ORD-"), ok).alias("id_a"), F.lit("Invoice").alias("label_a"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("ord "), ok)).otherwise(F.concat(F.lit("ORD-"), ok, F.lit("X"))).alias("id_b"),
        F.lit("Receipt").alias("label_b"),
    )
    return findings.compare_identifiers(pairs).select("order_key", "summary", "severity")


def _coverage(spark, sf):
    li = ct._lines(spark, sf).join(ct._orders(spark, sf).select("ok", "case_id"), "ok")
    claims = li.where(F.col("l_returnflag") == "R").select(
        "case_id", F.col("lid").alias("claim_id"), F.when(F.col("ln") % 2 == 0, "ISSUED_REFUND").otherwise("OTHER").alias("predicate"),
        F.when(F.col("ln") == 3, "REFUND_PROCESSED").alias("event_reference"),
        F.when(F.col("ln") % 4 == 0, "OBJECTIVE").otherwise("SUBJECTIVE_ASSERTION").alias("modality"),
    )
    settled = li.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("ok") % 9 == 0)).select(
        "case_id", F.lit("REFUND_RECEIVED").alias("event_type"), F.lit("BANK_STATEMENT").alias("source_type")
    )
    ranges = ct._orders(spark, sf).where(F.col("ok") % 2 == 0).groupBy("case_id").agg(
        F.min("odate").alias("range_start"), F.max("odate").alias("range_end")
    )
    return findings.refund_coverage(claims, settled, ranges)


COVERAGE_SQL = """SELECT case_id, lid AS claim_id, 'MISSING_EVIDENCE_ADVISORY' AS finding_type,
  'Missing Evidence Advisory: Refund Transaction Record' AS title,
  'Supporting evidence for the refund transaction was not found in the uploaded evidence.'||
   coalesce(' Uploaded financial records span '||strftime(rs,'%b %d')||' to '||strftime(re,'%b %d')||'. Review recommended.','') AS summary,
  'NOT_FOUND_IN_UPLOADED_EVIDENCE' AS coverage_state, 'MEDIUM' AS severity
 FROM l LEFT JOIN (SELECT case_id, min(odate) AS rs, max(odate) AS re FROM o WHERE ok%2=0 GROUP BY 1) r USING (case_id)
 WHERE l_returnflag='R' AND (ln%2=0 OR ln=3) AND ln%4<>0
  AND case_id NOT IN (SELECT case_id FROM l WHERE l_returnflag='A' AND l_linestatus='F' AND ok%9=0)"""


def _renamed(spark, sf):
    """Active events under the first generation's names of milestones."""
    return active(spark, sf).withColumn(
        "event_type",
        F.when(F.col("event_type") == "ITEM_SHIPPED", "ORDER_SHIPPED")
        .when(F.col("event_type") == "REFUND_COMPLETED", "REFUND_PROCESSED").otherwise(F.col("event_type")),
    )


V0_TYPES = "(('ORDER_PLACED','ORDER_SHIPPED'),('REFUND_REQUESTED','REFUND_PROCESSED'))"
V0 = """
v0 AS (SELECT case_id, event_id, tm.at AS at, CASE event_type WHEN 'ITEM_SHIPPED' THEN 'ORDER_SHIPPED' WHEN 'REFUND_COMPLETED' THEN 'REFUND_PROCESSED' ELSE event_type END AS et FROM tm)
"""
V0_SQL = f"""SELECT a.case_id, 'Potential Inconsistency: Temporal Sequence Violation' AS title,
  b.et||' recorded at '||{ISO.format('b.at')}||' precedes '||a.et||' recorded at '||{ISO.format('a.at')}||'.' AS summary,
  'HIGH' AS severity, 'DIRECT_CONTRADICTION' AS conflict_state, a.event_id AS event_a, b.event_id AS event_b
 FROM v0 a JOIN v0 b ON a.case_id=b.case_id AND (a.et,b.et) IN {V0_TYPES} AND b.at<a.at"""
#: Classes of values that disagree, counted from the pairs themselves.
CLASS_PARTS = [
    ("CURRENCY_MISMATCH", "''", "ca", "cb", "va IS NOT NULL AND vb IS NOT NULL AND ca<>'' AND cb<>'' AND ca<>cb"),
    ("MONETARY_DISCREPANCY", "''", "ca||' '||va", "cb||' '||vb", "va IS NOT NULL AND vb IS NOT NULL AND (ca=cb OR ca='' OR cb='') AND abs(va-vb)>0.01"),
    ("POLARITY_CONFLICT", "ta", "pola", "polb", "ta=tb AND pola<>polb"),
    ("OUTCOME_CONFLICT", DOMAIN, "ta", "tb", "(ta,tb) IN (('PAYMENT_MADE','PAYMENT_FAILED'),('PAYMENT_FAILED','PAYMENT_MADE'),('REFUND_COMPLETED','REFUND_FAILED'),('REFUND_FAILED','REFUND_COMPLETED'))"),
    ("DATE_DISCREPANCY", "ta", "trim(tia)", "trim(tib)", "ta=tb AND trim(tia)<>trim(tib)"),
]


def _class_sql() -> str:
    """Each pair's two values in their order, then counts, and the cited pair by the documents' ends."""
    parts = " UNION ALL ".join(
        f"SELECT case_id, ref_key, '{k}' AS kind, {scope} AS scope, {a} AS x, {b} AS y, ea, eb, da, db FROM pr WHERE {cond}" for k, scope, a, b, cond in CLASS_PARTS
    )
    return f"""WITH {{prelude}}, {REFX},
        p AS ({parts}),
        q AS (SELECT case_id, ref_key, kind, scope, least(x,y) AS v, greatest(x,y) AS w, count(*) AS pairs FROM p GROUP BY ALL)
        SELECT case_id, ref_key, kind, scope, v AS value_lo, w AS value_hi, pairs FROM q"""


SEQUENCE_SQL = """SELECT case_id, ta AS type_early, tb AS type_late,
    CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN '= '||ra WHEN rb IS NULL THEN 'late open' ELSE 'early open' END AS scope, count(*) AS pairs,
    first(ea ORDER BY ab-aa, aa DESC, ea DESC, eb) AS event_a, first(eb ORDER BY ab-aa, aa DESC, ea DESC, eb) AS event_b,
    CAST(max(epoch_us(aa)-epoch_us(ab))//1000000 AS BIGINT) AS seconds_apart
  FROM (SELECT tp.*, x.rk AS ra, y.rk AS rb FROM tp JOIN tm x ON x.event_id=ea AND x.case_id=tp.case_id JOIN tm y ON y.event_id=eb AND y.case_id=tp.case_id) GROUP BY ALL"""


def _classes(spark, sf):
    """Classes with their two values in one order, so that sides don't matter."""
    c = findings.finding_classes(members(spark, sf))
    lo, hi = F.least("value_a", "value_b"), F.greatest("value_a", "value_b")
    return c.select("case_id", "ref_key", "kind", "scope", lo.alias("value_lo"), hi.alias("value_hi"), "pairs")


def _fallback(spark, sf):
    return shown(findings.missing_corroboration(active(spark, sf), ["PAYMENT_SENT", "REFUND_INITIATED"]))


def _citations(spark, sf):
    a = active(spark, sf)
    c = refs.citation(
        F.col("evidence_id"), F.col("source_name"), F.col("page_number"), F.col("char_start"), F.col("char_end"),
        F.col("trigger_raw_text"), F.col("event_id"),
    )
    return a.select(c.alias("c")).select("c.*")


def register(add) -> None:
    add("active_events", lambda s, p: active(s, p).select(
        "case_id", "evidence_id", "event_id", "processing_version", "event_type", "source_name",
        F.col("amount_value").cast("double").alias("amount_value")),
        sql("SELECT case_id, evidence_id, event_id, processing_version, event_type, source_name, CAST(amount_value AS DOUBLE) AS amount_value FROM act"))
    add("normalize_reference", lambda s, p: ct.events(s, p).select(
        "event_id", refs.normalize_reference(F.col("order_reference")).alias("order_key"),
        refs.coalesced_reference(F.col("order_reference"), F.col("transaction_reference")).alias("ref_key"),
        F.date_format(refs.explicit_timestamp(F.col("temporal_information")), "yyyy-MM-dd HH:mm:ss").alias("stated_at")),
        sql(f"""SELECT event_id, {ct._norm('order_reference')} AS order_key, coalesce({ct._norm('order_reference')},{ct._norm('transaction_reference')}) AS ref_key,
          strftime(try_cast(replace(temporal_information,'Z','') AS TIMESTAMP),'%Y-%m-%d %H:%M:%S') AS stated_at FROM evt"""))
    add("event_citations", _citations, sql("""SELECT evidence_id, source_name AS original_filename, page_number,
        CASE WHEN char_start=0 AND char_end=0 THEN NULL ELSE char_start END AS char_start,
        CASE WHEN char_start=0 AND char_end=0 THEN NULL ELSE char_end END AS char_end,
        coalesce(trigger_raw_text,'[No textual trigger span recorded]') AS trigger_raw_text, event_id FROM act"""))
    add("reference_index", lambda s, p: findings.reference_index(active(s, p)).select("case_id", "ref_key", "ref_pos", "ref_display", "event_id"),
        sql("SELECT case_id, ref_key, pos AS ref_pos, disp AS ref_display, event_id FROM refx", REFX))
    add("reference_groups", lambda s, p: findings.reference_groups(findings.reference_index(active(s, p))).select(
        "case_id", "ref_key", "group_size", "display_ref"),
        sql("SELECT case_id, ref_key, group_size, display_ref FROM grp", REFX))
    add("event_pairs", lambda s, p: findings.event_pair_counts(members(s, p)),
        sql("""SELECT case_id, ref_key, least(ta,tb) AS type_a, greatest(ta,tb) AS type_b, count(*) AS pairs FROM pr GROUP BY ALL""", REFX))
    for name, fn, text in [
        ("currency_findings", findings.currency_findings, CURRENCY_SQL),
        ("amount_findings", findings.amount_findings, AMOUNT_SQL),
        ("polarity_findings", findings.polarity_findings, POLARITY_SQL),
        ("outcome_findings", findings.outcome_findings, OUTCOME_SQL),
        ("date_findings", findings.date_findings, DATE_SQL),
    ]:
        add(name, lambda s, p, fn=fn: shown(fn(members(s, p))), sql(text, REFX))
    add("order_ref_findings", lambda s, p: shown(findings.order_ref_findings(active(s, p))), sql(ORDER_REF_SQL, DOCSET))
    add("order_ref_divergence", lambda s, p: findings.order_ref_divergence(active(s, p)), sql(DIVERGENCE_SQL, DOCSET))
    add("missing_corroboration", lambda s, p: shown(findings.missing_corroboration(active(s, p))), sql(MISSING_SQL))
    add("missing_corroboration_fallback", _fallback, sql(
        f"SELECT * FROM ({MISSING_SQL}) WHERE kind='MISSING_CORROBORATION_PAYMENT_SENT'"))
    add("zero_event_findings", lambda s, p: shown(findings.zero_event_findings(ct.evidence(s, p), active(s, p))), sql(ZERO_SQL))
    add("temporal_findings", lambda s, p: shown(findings.temporal_findings(active(s, p))), sql(TEMPORAL_SQL, TIMED))
    add("check_temporal", lambda s, p: findings.check_temporal(_renamed(s, p)), sql(V0_SQL, TIMED + "," + V0))
    add("finding_classes", _classes, _class_sql().replace("{prelude}", ct.PRELUDE))
    add("sequence_classes", lambda s, p: findings.sequence_classes(active(s, p)), sql(SEQUENCE_SQL, TIMED))
    add("sequence_classes_first_generation", lambda s, p: findings.sequence_classes(_renamed(s, p), rules.PRECEDENCE_V0, False).select(
        "case_id", "type_early", "type_late", "pairs", "seconds_apart"),
        sql(f"""SELECT a.case_id, a.et AS type_early, b.et AS type_late, count(*) AS pairs, CAST(max(epoch_us(a.at)-epoch_us(b.at))//1000000 AS BIGINT) AS seconds_apart
          FROM v0 a JOIN v0 b ON a.case_id=b.case_id AND (a.et,b.et) IN {V0_TYPES} AND b.at<a.at GROUP BY ALL""", TIMED + "," + V0))
    add("case_findings_summary", _summary, sql(COUNTED.format(ALL_SQL), ALL_EXTRA))
    add("compare_amounts", _amount_pairs, f"""WITH p AS (SELECT o_orderkey AS order_key, CAST(o_totalprice AS DECIMAL(18,2)) AS a, b,
          CASE WHEN o_orderkey%3=0 THEN 'USD' ELSE 'INR' END AS ca, CASE WHEN o_orderkey%5=0 THEN 'INR' WHEN o_orderkey%3=0 THEN 'USD' ELSE 'INR' END AS cb
          FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS b FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey)
        SELECT order_key, CASE WHEN ca<>cb THEN 'Potential Inconsistency: Currency Mismatch' ELSE 'Potential Inconsistency: Amount Discrepancy' END AS title,
          CASE WHEN ca<>cb THEN 'Order is denominated in '||ca||' while Lines is in '||cb||'. Direct comparison requires exchange rate verification.'
           ELSE CASE WHEN a>b THEN 'Order' ELSE 'Lines' END||' ('||ca||' '||{money('greatest(a,b)')}||') differs from '||CASE WHEN a>b THEN 'Lines' ELSE 'Order' END||' ('||cb||' '||{money('least(a,b)')}||') by '||ca||' '||{money('abs(a-b)')}||'.' END AS summary,
          CASE WHEN ca<>cb THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN ca<>cb THEN 'POTENTIAL_CONFLICT' ELSE 'DIRECT_CONTRADICTION' END AS conflict_state
        FROM p WHERE ca<>cb OR abs(a-b)>0.01""")
    add("compare_identifiers", _identifier_pairs, """SELECT o_orderkey AS order_key, 'Invoice ''ORD-'||o_orderkey||''' does not match Receipt ''ORD-'||o_orderkey||'X''.' AS summary,
        'HIGH' AS severity FROM orders WHERE o_orderkey%4<>0""")
    add("refund_coverage", _coverage, sql(COVERAGE_SQL))
    add("language_violations", lambda s, p: evaluation.language_violations(_tainted(s, p)),
        sql(f"""SELECT finding_id, 'fraud' AS word FROM ({ALL_SQL}) WHERE substr(finding_id,5,1) IN ('0','1') """, ALL_EXTRA))
    add("citation_violations", lambda s, p: evaluation.citation_violations(_broken(s, p)),
        sql(f"""SELECT finding_id, CASE WHEN substr(finding_id,5,1)='0' THEN 'missing evidence_id' WHEN substr(finding_id,5,1)='1' THEN 'missing original_filename'
          ELSE 'raw 0..0 offsets' END AS problem FROM ({ALL_SQL}) WHERE substr(finding_id,5,1) IN ('0','1','2')""", ALL_EXTRA))


def _tainted(spark, sf):
    """Findings of all detectors of which some are given a forbidden word, to audit the audit."""
    f = session.materialize(all_found(spark, sf), "findings")
    return f.withColumn("title", F.when(F.substring("finding_id", 5, 1).isin("0", "1"), F.concat("title", F.lit(" Fraud"))).otherwise(F.col("title")))


def _broken(spark, sf):
    """Findings of all detectors; the first citation of some is spoiled."""
    f = all_found(spark, sf)  # read once, so only ids and citations are made
    digit = F.substring("finding_id", 5, 1)
    fix = lambda c: c.withField("evidence_id", F.when(digit == "0", "").otherwise(c["evidence_id"])).withField(
        "original_filename", F.when(digit == "1", "").otherwise(c["original_filename"])
    ).withField("char_start", F.when(digit == "2", 0).otherwise(F.coalesce(c["char_start"], F.lit(1)))).withField(
        "char_end", F.when(digit == "2", 0).otherwise(F.coalesce(c["char_end"], F.lit(1)))
    )
    return f.withColumn("citations", F.transform("citations", lambda c, k: F.when(k == 0, fix(c)).otherwise(c)))
