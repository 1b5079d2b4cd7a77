"""Document versions, processing runs and case state (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import refs

DOC = ["case_id", "user_id", "evidence_id"]


def active_events(
    events: DataFrame, evidence: DataFrame, check_active: bool = True, check_version: bool = True
) -> DataFrame:
    """Events visible in the active version of their document, with the document's name.

    The listing of events checks only the version, the dossier only the flag, the
    findings both.
    """
    docs = evidence.select(
        *DOC,
        F.col("active_processing_version").alias("_active"),
        F.coalesce(refs.blank_to_null(F.col("original_filename")), F.col("evidence_id")).alias("source_name"),
    )
    rows = events.where(F.col("is_active")) if check_active else events
    if check_version:
        docs = docs.where(F.col("_active") > 0)
        return rows.join(docs, DOC).where(F.col("processing_version") == F.col("_active")).drop("_active")
    joined = rows.join(docs.drop("_active"), DOC, "left")
    return joined.withColumn("source_name", F.coalesce("source_name", "evidence_id"))


def owned_cases(cases: DataFrame, user_id: str) -> DataFrame:
    return cases.where(F.col("user_id") == user_id)


def restrict_to_cases(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Tenant isolation: rows of cases that belong to the same user."""
    return rows.join(cases.select("case_id", "user_id"), ["case_id", "user_id"], "left_semi")


def target_version(active: Column) -> Column:
    return F.when(F.coalesce(active, F.lit(0)) > 0, active + 1).otherwise(1)


def activate_runs(evidence: DataFrame, staged: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Switch documents to the version of a finished run, if the run still owns the document.

    runs(evidence_id, run_id, prior_version, quality_state, page_count,
    character_count, entities_extracted, diagnostic); staged events carry
    evidence_id, processing_run_id, decision_state. Returns the new evidence
    snapshot and the staged events that became visible.
    """
    per_run = staged.groupBy("evidence_id", F.col("processing_run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("_events"),
        F.bool_or(F.col("decision_state") == "REVIEW_NEEDED").alias("_review"),
    )
    done = runs.join(per_run, ["evidence_id", "run_id"], "left").select(
        "evidence_id",
        F.struct(
            "run_id", "prior_version", "quality_state", "page_count", "character_count", "entities_extracted",
            "diagnostic", F.coalesce("_events", F.lit(0)).alias("events"), F.coalesce("_review", F.lit(False)).alias("review"),
        ).alias("_run"),
    )
    joined = evidence.join(done, "evidence_id", "left")
    unchanged = F.coalesce("active_processing_version", F.lit(0)) == F.coalesce("_run.prior_version", F.lit(0))
    wins = F.coalesce((F.col("current_run_id") == F.col("_run.run_id")) & unchanged, F.lit(False))
    version = target_version(F.col("_run.prior_version"))
    status = F.when((F.col("_run.quality_state") == "REVIEW_NEEDED") | F.col("_run.review"), "REVIEW_NEEDED").otherwise("READY")
    marked = joined.withColumn("_wins", wins).withColumn("_version", version)
    summary = F.struct(
        F.col("_run.page_count").alias("page_count"),
        F.col("_run.character_count").alias("character_count"),
        F.col("_run.quality_state").alias("quality_state"),
        F.col("_run.entities_extracted").alias("entities_extracted"),
        F.col("_run.events").cast("int").alias("events_extracted"),
        F.col("_version").alias("processing_version"),
        F.when(F.col("_run.events") == 0, F.col("_run.diagnostic")).alias("diagnostic"),
    )
    pick = lambda new, old: F.when(F.col("_wins"), new).otherwise(F.col(old)).alias(old)
    changed = {
        "active_processing_version": pick(F.col("_version"), "active_processing_version"),
        "status": pick(status, "status"),
        "extraction_summary": pick(summary, "extraction_summary"),
    }
    snapshot = marked.select(*[changed.get(c, F.col(c)) for c in evidence.columns])
    switched = marked.where("_wins").select(
        "evidence_id", F.col("current_run_id").alias("processing_run_id"), F.col("_version").alias("_v")
    )
    visible = staged.join(switched, ["evidence_id", "processing_run_id"])
    visible = visible.withColumn("processing_version", F.col("_v")).drop("_v")
    return snapshot, visible


def purge_superseded(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drop events of versions older than the active one."""
    docs = evidence.where(F.col("active_processing_version") > 0).select(
        "evidence_id", F.col("active_processing_version").alias("_active")
    )
    return (
        events.join(docs, "evidence_id", "left")
        .where(F.col("_active").isNull() | (F.col("processing_version") >= F.col("_active")))
        .drop("_active")
    )


def rollback_runs(evidence: DataFrame, events: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove staged events of failed runs; their documents become FAILED. failed(evidence_id, run_id)."""
    kept = events.join(
        failed.select("evidence_id", F.col("run_id").alias("processing_run_id")),
        ["evidence_id", "processing_run_id"], "left_anti",
    )
    hit = failed.select("evidence_id", F.col("run_id").alias("current_run_id"), F.lit(True).alias("_failed")).distinct()
    docs = evidence.join(hit, ["evidence_id", "current_run_id"], "left")
    docs = docs.withColumn("status", F.when(F.col("_failed"), "FAILED").otherwise(F.col("status"))).withColumn(
        "error_code", F.when(F.col("_failed"), "EXTRACTION_FAILURE").otherwise(F.col("error_code"))
    )
    return docs.drop("_failed").select(*evidence.columns), kept


def case_state(evidence: DataFrame) -> DataFrame:
    """Status and document count per case that has documents."""
    return evidence.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.when(F.bool_or(F.col("status").isin(*rules.IN_FLIGHT_STATUSES)), "PROCESSING")
        .when(F.bool_or(F.col("status").isin(*rules.ATTENTION_STATUSES)), "REVIEW_NEEDED")
        .otherwise("READY")
        .alias("status"),
    )


def sync_case_state(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cases with status and count recomputed from their documents."""
    state = case_state(evidence)
    base = cases.drop("status", "evidence_count")
    return (
        base.join(state, "case_id", "left")
        .withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
        .withColumn("status", F.coalesce("status", F.lit("READY")))
    )


def recover_stale(
    evidence: DataFrame, events: DataFrame, now: Column, timeout_seconds: int = 300
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interrupt silent runs. Returns (evidence, events, recovered documents)."""
    cutoff = now - F.make_interval(secs=F.lit(timeout_seconds))
    stale = F.coalesce(
        F.col("status").isin(*rules.RUNNING_STATUSES) & (F.col("heartbeat_at") < cutoff), F.lit(False)
    )
    recovered = evidence.where(stale).select(
        "evidence_id", F.col("current_run_id").alias("_run"), F.col("active_processing_version").alias("_active")
    )
    snapshot = (
        evidence.withColumn("_stale", stale)
        .withColumn("status", F.when(F.col("_stale"), "INTERRUPTED").otherwise(F.col("status")))
        .withColumn("error_code", F.when(F.col("_stale"), "JOB_INTERRUPTED").otherwise(F.col("error_code")))
        .drop("_stale")
    )
    doomed = F.when(
        F.col("_run").isNotNull(), F.col("processing_run_id").eqNullSafe(F.col("_run"))
    ).otherwise(~F.col("processing_version").eqNullSafe(F.col("_active")))
    # one left join tells both kinds of drop apart
    kept = (
        events.join(recovered.withColumn("_hit", F.lit(True)), "evidence_id", "left")
        .where(F.col("_hit").isNull() | ~doomed)
        .drop("_run", "_active", "_hit")
    )
    return snapshot, kept, recovered.select("evidence_id", F.col("_run").alias("run_id"))


def request_retry(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer retry requests(case_id, user_id, evidence_id): queued, refused or not found."""
    docs = evidence.select(*DOC, "status", "retry_count", "error_code")
    ok = F.col("status").isin(*rules.RETRYABLE_STATUSES)
    found = F.col("status").isNotNull()
    return requests.join(docs, DOC, "left").select(
        *DOC,
        F.when(~found, "NOT_FOUND").when(ok, "ACCEPTED").otherwise("REFUSED").alias("outcome"),
        F.when(ok, "QUEUED").otherwise(F.col("status")).alias("status"),
        F.when(ok, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(~ok, F.col("error_code")).alias("error_code"),
        F.when(found & ~ok, F.concat(F.lit("Cannot retry evidence with status '"), F.col("status"), F.lit("'"))).alias(
            "reason"
        ),
    )


def claim_jobs(evidence: DataFrame) -> DataFrame:
    """Documents a worker may claim move to EXTRACTING under a replayable run id."""
    ok = F.col("status").isin(*rules.CLAIMABLE_STATUSES)
    run = refs.natural_id("run_", F.col("evidence_id"), F.coalesce("retry_count", F.lit(0)))
    return evidence.withColumn("current_run_id", F.when(ok, run).otherwise(F.col("current_run_id"))).withColumn(
        "status", F.when(ok, "EXTRACTING").otherwise(F.col("status"))
    )


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """Mark later uploads of the same content in a case as duplicates of the first.

    The first upload per content hash comes from a partially aggregated minimum,
    so one content uploaded very often is no single-task group.
    """
    key = ["case_id", "user_id", "sha256_hash"]
    first = evidence.groupBy(*key).agg(F.min(F.struct("created_at", "evidence_id")).alias("_first"))
    return (
        evidence.join(first, key)
        .withColumn("canonical_evidence_id", F.col("_first.evidence_id"))
        .withColumn("is_duplicate", F.col("evidence_id") != F.col("canonical_evidence_id"))
        .drop("_first")
    )


def restore_uploads(uploads: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Re-upload of known content: keep the known record, restore a missing file, requeue failed ones.

    uploads(case_id, user_id, sha256_hash, upload_id), stored(evidence_id) = files present.
    """
    key = ["case_id", "user_id", "sha256_hash"]
    known = (
        evidence.groupBy(*key)
        .agg(F.min_by(F.struct("evidence_id", "status"), F.struct("created_at", "evidence_id")).alias("_k"))
        .select(*key, F.col("_k.evidence_id").alias("evidence_id"), F.col("_k.status").alias("status"))
    )
    present = stored.select("evidence_id", F.lit(True).alias("_present")).distinct()
    joined = uploads.join(known, key, "left").join(present, "evidence_id", "left")
    restored = F.col("evidence_id").isNotNull() & F.col("_present").isNull()
    requeue = restored & F.col("status").isin("FAILED", "INTERRUPTED")
    return joined.select(
        *key, "upload_id", "evidence_id",
        F.col("evidence_id").isNotNull().alias("is_duplicate"),
        restored.alias("file_restored"),
        F.when(requeue, "QUEUED").otherwise(F.col("status")).alias("status"),
    )


def zero_event_diagnostic(text: Column) -> Column:
    """Why a document without events has none."""
    disclaimer = F.lit(False)
    for pattern in rules.DISCLAIMERS:
        disclaimer = disclaimer | F.lower(text).rlike("(?U)" + pattern)
    return (
        F.when(F.trim(text) == "", "Document text is empty; no textual content available for event extraction.")
        .when(
            disclaimer,
            "Document text consists of non-affirmative disclaimers or simulated statements; no validated real-world "
            "lifecycle events were asserted.",
        )
        .otherwise("No recognized event triggers or verifiable business action statements identified in source text.")
    )


def extraction_summary(docs: DataFrame, mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Per document: size, counts of entities and events, and a diagnostic when there are no events."""
    m = mentions.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("entities_extracted"))
    e = events.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("events_extracted"))
    joined = docs.select("evidence_id", "text").join(m, "evidence_id", "left").join(e, "evidence_id", "left")
    n_events = F.coalesce("events_extracted", F.lit(0))
    return joined.select(
        "evidence_id",
        F.length("text").alias("character_count"),
        F.coalesce("entities_extracted", F.lit(0)).alias("entities_extracted"),
        n_events.alias("events_extracted"),
        F.when(n_events == 0, zero_event_diagnostic(F.col("text"))).alias("diagnostic"),
    )


def dashboard(cases: DataFrame) -> DataFrame:
    """Four counters over all given cases."""
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "READY").alias("ready"),
        F.count_if(F.col("status").isin(*rules.DASHBOARD_PROCESSING)).alias("processing"),
        F.count_if(F.col("status") == "REVIEW_NEEDED").alias("review_needed"),
    )


def in_flight(evidence: DataFrame) -> DataFrame:
    """Per case: is any document still being processed."""
    return evidence.groupBy("case_id").agg(
        F.bool_or(F.col("status").isin(*rules.IN_FLIGHT_STATUSES)).alias("in_flight")
    )


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be unique and are not."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)

