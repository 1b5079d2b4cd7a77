"""Stored tables, labelled lines, scenario files, uploads, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions.refs import blank_to_null

LABELLED = (
    "sample_id string, text string, trigger_text string, polarity string, modality string, tense string, "
    "order_reference string, amount string, temporal string, event_type string"
)
SCENARIOS = (
    "scenarios array<struct<scenario_id:string, category:string, description:string, "
    "evidence_documents:array<struct<evidence_id:string, filename:string, active_processing_version:int, status:string>>, "
    "events:array<struct<event_id:string, evidence_id:string, processing_version:int, is_active:boolean, event_type:string, "
    "decision_state:string, trigger_raw_text:string, char_start:int, char_end:int, page_number:int, order_reference:string, "
    "transaction_reference:string, temporal_information:string, amount_currency:string, amount_value:string, polarity:string, "
    "model_confidence:double>>, expected:struct<findings_count:int, conflict_state:string, severity:string, finding_type:string, "
    "expected_title_contains:string, citations_min:int, is_consistent:boolean, rationale:string>>>"
)


def load(spark: SparkSession, root: str, name: str, case_id: str | None = None, user_id: str | None = None) -> DataFrame:
    """A stored table, of one case or user if given; the conditions reach the scan."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    for column, value in (("case_id", case_id), ("user_id", user_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def read_labelled(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """One JSON object on each line that isn't blank."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, events and expectations of scenario files, each row with its scenario's id as case_id."""
    rows = spark.read.schema(SCENARIOS).option("multiLine", True).json(path).select(F.inline("scenarios"))
    key = F.col("scenario_id").alias("case_id")
    return (
        rows.select(key, F.inline("evidence_documents")),
        rows.select(key, F.inline("events")),
        rows.select(key, "category", "description", "expected.*"),
    )


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads(filename, declared_type, content) with detected type, size, hash and why one is rejected (null: accepted)."""
    prefix = F.hex(F.substring("content", 1, 8))
    detected: Column = F.lit(None).cast("string")
    for magic, kind in rules.MAGIC_PREFIX.items():
        detected = F.coalesce(detected, F.when(prefix.startswith(magic), kind))
    extension = F.lower(F.regexp_extract("filename", r"[^/\\]\.([^./\\]*)$", 1))
    declared = F.trim(F.substring_index(F.lower(F.coalesce("declared_type", F.lit(""))), ";", 1))
    declared = F.when(declared == "image/jpg", "image/jpeg").otherwise(declared)
    size = F.coalesce(F.length("content"), F.lit(0))
    reason = (
        F.when(~F.coalesce(extension.isin(*rules.ALLOWED_EXTENSIONS), F.lit(False)), "UNSUPPORTED_EXTENSION")
        .when(size == 0, "EMPTY_FILE")
        .when(detected.isNull(), "UNKNOWN_SIGNATURE")
        .when(blank_to_null(declared).isNotNull() & (declared != "application/octet-stream") & (declared != detected), "TYPE_MISMATCH")
        .when(size > rules.MAX_UPLOAD_BYTES, "FILE_TOO_LARGE")
    )
    return uploads.withColumns({
        "media_type": detected, "file_size_bytes": size, "sha256_hash": F.sha2("content", 256), "reject_reason": reason,
    })


def ingest_evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder; a rejected one keeps its reason. Spark's scan passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = checked_uploads(files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit("").alias("declared_type"), "content"
    ))
    return rows.where("reject_reason IS NULL").drop("reject_reason"), rows.where("reject_reason IS NOT NULL").drop("content")


def write_confusion_csv(matrix: DataFrame, path: str, classes: list[str]) -> None:
    """A confusion matrix under a header of its classes; its rows are as many as the classes."""
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("gold"))
    rows = matrix.orderBy(order).select(F.col("gold").alias("Gold \\ Pred"), *classes)
    rows.coalesce(1).write.option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON documents, nested columns kept."""
    metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value")).write.text(path)
