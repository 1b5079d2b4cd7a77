"""Streams over the events table, replayed in slices out of order, and the same operators over the stored table.

A message's slice follows its time plus a pseudo-random lag, so neighbours come in different slices and
late. The last slice is a clock: a message far ahead that lets all time pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session
from factloom.plans import case_tables as ct
from factloom.operators import findings
from factloom.operators.versions import active_events
from factloom.plans import finding_queries as fq
from factloom.streaming import incremental, machines, ordered

SLICES, LAG_SECONDS, AHEAD_SECONDS = 4, 43_200, 315_360_000
#: Silence after which a document is interrupted; requests of a key and window.
TIMEOUT, MOST, WINDOW = 21_600, 3, 21_600
#: When all timeouts are over, for the stored table.
LATER = 4_102_444_800 * machines.SECOND


def replayed(rows: DataFrame, at: str, key: str) -> tuple[DataFrame, str]:
    """The rows as a stream in slices, and the delay that covers their disorder."""
    spark = ordered.settings(rows.sparkSession)
    ends = rows.agg(F.min(F.unix_seconds(at)).alias("a"), F.max(F.unix_seconds(at)).alias("b")).first()
    first, last = (ends.a or 0), (ends.b or 0) + LAG_SECONDS
    width = (last - first) // SLICES + 1
    arrival = F.unix_seconds(at) + F.pmod(F.xxhash64(key), F.lit(LAG_SECONDS))
    path = f"{session.shared_folder(spark).rstrip('/')}/messages-{uuid.uuid4().hex[:12]}"
    for k in range(SLICES):
        rows.where(F.floor((arrival - first) / width) == k).write.mode("append").parquet(path)
    clock = [F.timestamp_seconds(F.lit(last + AHEAD_SECONDS)) if f.name == at else F.lit(None).cast(f.dataType) for f in rows.schema]
    spark.range(1).select(*[c.alias(f.name) for c, f in zip(clock, rows.schema)]).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)
    return stream, f"{width + LAG_SECONDS} seconds"


def _run(out: DataFrame, name: str, key: str) -> DataFrame:
    return ordered.run_to_end(out, f"{name}-{uuid.uuid4().hex[:12]}").where(F.col(key).isNotNull())


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status messages of a document for each user, with a run a day."""
    n, kind = F.col("event_id"), F.col("event_type")
    status = (
        F.when(kind == "signup", "QUEUED").when(kind == "click", "EXTRACTING")
        .when(kind == "view", F.when(n % 2 == 0, "STRUCTURING").otherwise("ANALYZING")).when(kind == "purchase", "READY")
        .when(n % 3 == 0, "REVIEW_NEEDED").otherwise("FAILED")
    )
    text = lambda c: c.cast("string")
    user = F.col("user_id")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("case_"), text(user % 20)).alias("case_id"), F.concat(F.lit("evi_"), text(user)).alias("evidence_id"), text(n).alias("seq"),
        status.alias("status"), F.concat(F.lit("run_"), text(user), F.lit("_"), F.date_format("at", "yyyyMMdd")).alias("run_id"), "at",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; half of the users aren't named and share two addresses."""
    user = F.col("user_id")
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("action"), F.when(user % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), user.cast("string"))).alias("user_id"),
        F.concat(F.lit("10.0.0."), (user % 4).cast("string")).alias("ip"), F.col("event_id").cast("string").alias("request_id"), "at",
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads whose contents recur."""
    user = F.col("user_id")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("case_"), user.cast("string")).alias("case_id"), F.concat(F.lit("usr_"), (user % 5).cast("string")).alias("user_id"),
        F.sha2(F.concat("event_type", F.lit("|"), (F.floor("value") % 7).cast("string")), 256).alias("sha256_hash"),
        F.concat(F.lit("evi_"), F.col("event_id").cast("string")).alias("evidence_id"), F.col("at").alias("created_at"),
    )


def _lifecycle_stream(spark, sf_dir):
    rows, delay = replayed(messages(spark, sf_dir), "at", "seq")
    return _run(machines.lifecycle(rows, delay, TIMEOUT), "lifecycle", "evidence_id")


def _case_state_stream(spark, sf_dir):
    rows, delay = replayed(messages(spark, sf_dir), "at", "seq")
    return _run(machines.case_states(rows, delay, TIMEOUT), "case-states", "case_id")


def _throttle_stream(spark, sf_dir):
    rows, delay = replayed(requests(spark, sf_dir), "at", "request_id")
    return _run(machines.throttle(rows, delay, MOST, WINDOW), "throttle", "seq")


def _upload_stream(spark, sf_dir):
    rows, delay = replayed(uploads(spark, sf_dir), "created_at", "evidence_id")
    return _run(machines.first_uploads(rows, delay), "uploads", "case_id")


def _repeat_stream(spark, sf_dir):
    """Contents that come through, one row each: the delay covers the whole replay."""
    rows, delay = replayed(uploads(spark, sf_dir), "created_at", "evidence_id")
    out = machines.drop_repeats(rows, f"{AHEAD_SECONDS} seconds")
    return _run(out, "repeats", "case_id").select("case_id", "user_id", "sha256_hash")


def _detect(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Two advisories and one rule on pairs: what a batch recomputes is for the caller to choose."""
    active = session.materialize(active_events(events, evidence), "active")
    pairs = findings.currency_findings(findings.stored_members(active))
    return findings.zero_event_findings(evidence, active).unionByName(findings.missing_corroboration(active)).unionByName(pairs)


def _findings_stream(spark, sf_dir):
    """Findings after three batches that deal the events of each case out by a hash."""
    events, evidence = ct.stored(spark, sf_dir, "events", ct.events), ct.stored(spark, sf_dir, "evidence", ct.evidence)
    store = f"{session.shared_folder(spark).rstrip('/')}/findings-{uuid.uuid4().hex[:12]}"
    for k in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(4).write.mode("append").parquet(f"{store}/arriving")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{store}/arriving")
    incremental.findings_stream(arriving, evidence, store, _detect).awaitTermination()
    kept = incremental.current(spark, store)
    return kept.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("finding_id").alias("ids"), F.countDistinct("case_id").alias("cases"))


_KEPT = " UNION ALL BY NAME ".join(f"({p})" for p in (fq.ZERO_SQL, fq.MISSING_SQL, fq.CURRENCY_SQL))
_LIFECYCLE = f"""
RECURSIVE m AS (SELECT 'case_'||(user_id%20) AS case_id, 'evi_'||user_id AS evidence_id, CAST(event_id AS VARCHAR) AS seq,
    CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'EXTRACTING' WHEN 'purchase' THEN 'READY'
      WHEN 'view' THEN CASE WHEN event_id%2=0 THEN 'STRUCTURING' ELSE 'ANALYZING' END
      ELSE CASE WHEN event_id%3=0 THEN 'REVIEW_NEEDED' ELSE 'FAILED' END END AS asked,
    'run_'||user_id||'_'||strftime(ts, '%Y%m%d') AS run_id, epoch_us(ts) AS t,
    row_number() OVER w AS rn, lead(epoch_us(ts)) OVER w AS next_t
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR))),
s AS (
  SELECT case_id, evidence_id, CAST(NULL AS VARCHAR) AS seq, CAST(NULL AS VARCHAR) AS asked, CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS BIGINT) AS t,
    CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS next_t, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS before,
    CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS run, CAST(NULL AS BIGINT) AS beat, 0 AS retries
  FROM m WHERE rn=1
  UNION ALL
  SELECT case_id, evidence_id, seq, asked, run_id, t, rn, next_t, outcome, pre,
    CASE WHEN outcome='APPLIED' THEN asked ELSE pre END, CASE WHEN outcome='APPLIED' AND asked='EXTRACTING' THEN run_id ELSE run END,
    CASE WHEN outcome='APPLIED' THEN t ELSE beat END, CASE WHEN outcome='APPLIED' AND asked='QUEUED' AND pre IS NOT NULL THEN retries+1 ELSE retries END
  FROM (SELECT *, CASE WHEN asked='QUEUED' THEN CASE WHEN pre IS NULL OR pre IN ('FAILED','INTERRUPTED','REVIEW_NEEDED') THEN 'APPLIED' ELSE 'REFUSED' END
      WHEN pre IS NULL THEN 'NOT_FOUND'
      WHEN asked='EXTRACTING' THEN CASE WHEN pre IN ('QUEUED','FAILED','INTERRUPTED','REVIEW_NEEDED') OR (run_id=run AND pre=asked) THEN 'APPLIED' ELSE 'REFUSED' END
      WHEN run_id=run THEN 'APPLIED' ELSE 'STALE_RUN' END AS outcome
    FROM (SELECT m.*, s.run, s.beat, s.retries,
        CASE WHEN s.status IN ('EXTRACTING','STRUCTURING','ANALYZING') AND m.t > s.beat+{TIMEOUT * machines.SECOND} THEN 'INTERRUPTED' ELSE s.status END AS pre
      FROM s JOIN m ON m.evidence_id=s.evidence_id AND m.rn=s.rn+1))),
o AS (
  SELECT case_id, evidence_id, t AS "at", seq, asked, run_id, outcome, before, status, CAST(retries AS INTEGER) AS retry_count FROM s WHERE rn>0
  UNION ALL
  SELECT case_id, evidence_id, beat+{TIMEOUT * machines.SECOND}, NULL, NULL, run, 'TIMED_OUT', status, 'INTERRUPTED', CAST(retries AS INTEGER) FROM s
  WHERE rn>0 AND status IN ('EXTRACTING','STRUCTURING','ANALYZING') AND (next_t IS NULL OR next_t > beat+{TIMEOUT * machines.SECOND}))
"""
LIFECYCLE_SQL = f"WITH {_LIFECYCLE} SELECT * FROM o"
CASE_STATE_SQL = f"""WITH {_LIFECYCLE},
c AS (SELECT case_id, "at", concat_ws(':', evidence_id, seq) AS seq,
    CAST(before IS NULL AS INTEGER) AS d_all,
    CAST(status IN ('QUEUED','EXTRACTING','STRUCTURING','ANALYZING') AS INTEGER) - CAST(coalesce(before IN ('QUEUED','EXTRACTING','STRUCTURING','ANALYZING'), false) AS INTEGER) AS d_busy,
    CAST(status IN ('REVIEW_NEEDED','FAILED','INTERRUPTED') AS INTEGER) - CAST(coalesce(before IN ('REVIEW_NEEDED','FAILED','INTERRUPTED'), false) AS INTEGER) AS d_due
  FROM o WHERE status IS NOT NULL AND (before IS NULL OR before<>status)),
r AS (SELECT case_id, "at", seq, CAST(sum(d_all) OVER w AS BIGINT) AS evidence_count,
    CASE WHEN sum(d_busy) OVER w > 0 THEN 'PROCESSING' WHEN sum(d_due) OVER w > 0 THEN 'REVIEW_NEEDED' ELSE 'READY' END AS status
  FROM c WINDOW w AS (PARTITION BY case_id ORDER BY "at", seq))
SELECT case_id, "at", seq, status, evidence_count FROM r WINDOW v AS (PARTITION BY case_id ORDER BY "at", seq)
QUALIFY evidence_count>0 AND (lag(evidence_count) OVER v IS DISTINCT FROM evidence_count OR lag(status) OVER v IS DISTINCT FROM status)"""
THROTTLE_SQL = f"""WITH RECURSIVE q AS (SELECT event_type||CASE WHEN user_id%2=0 THEN ':ip:10.0.0.'||(user_id%4) ELSE ':user:'||user_id END AS key,
    CAST(event_id AS VARCHAR) AS seq, epoch_us(ts) AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS rn FROM q),
s AS (SELECT key, CAST(NULL AS VARCHAR) AS seq, CAST(NULL AS BIGINT) AS t, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, true AS accepted, CAST(NULL AS BIGINT) AS retry_after FROM n WHERE rn=1
  UNION ALL
  SELECT key, seq, t, rn, CASE WHEN len(recent) < {MOST} THEN list_append(recent, t) ELSE recent END, len(recent) < {MOST},
    CASE WHEN len(recent) >= {MOST} THEN greatest(1, (recent[1]+{WINDOW * machines.SECOND}-t)//{machines.SECOND}) END
  FROM (SELECT n.*, list_filter(s.kept, lambda x: x > n.t-{WINDOW * machines.SECOND}) AS recent FROM s JOIN n ON n.key=s.key AND n.rn=s.rn+1))
SELECT key, t AS "at", seq, accepted, retry_after FROM s WHERE rn>0"""
_UPLOADS = """u AS (SELECT 'case_'||user_id AS case_id, 'usr_'||(user_id%5) AS user_id, sha256(event_type||'|'||(CAST(floor(value) AS BIGINT)%7)) AS sha256_hash,
  'evi_'||event_id AS evidence_id, epoch_us(ts) AS t FROM events)"""


def register(add) -> None:
    add("stream_lifecycle", _lifecycle_stream, LIFECYCLE_SQL)
    add("lifecycle_outcomes", lambda s, p: machines.lifecycle_batch(messages(s, p), LATER, TIMEOUT), LIFECYCLE_SQL)
    add("stream_case_states", _case_state_stream, CASE_STATE_SQL)
    add("case_state_history", lambda s, p: machines.case_states_batch(messages(s, p), LATER, TIMEOUT), CASE_STATE_SQL)
    add("stream_throttle", _throttle_stream, THROTTLE_SQL)
    add("throttled_requests", lambda s, p: machines.throttle_batch(requests(s, p), MOST, WINDOW), THROTTLE_SQL)
    add("stream_first_uploads", _upload_stream, f"""WITH {_UPLOADS},
        f AS (SELECT *, first_value(evidence_id) OVER (PARTITION BY case_id, user_id, sha256_hash ORDER BY t, evidence_id) AS first FROM u)
        SELECT case_id, user_id, sha256_hash, t AS "at", evidence_id, first AS canonical_evidence_id, first<>evidence_id AS is_duplicate FROM f""")
    add("stream_distinct_uploads", _repeat_stream, f"WITH {_UPLOADS} SELECT DISTINCT case_id, user_id, sha256_hash FROM u")
    add("stream_findings", _findings_stream, ct.sql(
        f"SELECT kind, severity, count(*) AS findings, count(DISTINCT finding_id) AS ids, count(DISTINCT case_id) AS cases FROM ({_KEPT}) GROUP BY ALL", fq.REFX))
