"""Findings kept up to date as events arrive: each batch computes the cases it touches again, and only those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Parts of both tables; a batch reads and writes the parts of the cases it touches.
BUCKETS = 64

Detect = Callable[[DataFrame, DataFrame], DataFrame]


def _bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int"))


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The findings as of the last batch; None before the first.

    A batch writes whole parts under its own version, by one commit; of each part the last version holds.
    """
    try:
        rows = spark.read.parquet(f"{store}/findings")
    except AnalysisException:
        return None
    latest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each part
    return rows.join(latest, ["bucket", "version"], "left_semi").where("finding_id is not null").drop("version", "bucket")


def update(batch: DataFrame, number: int, evidence: DataFrame, store: str, detect: Detect, buckets: int = BUCKETS) -> None:
    """Add a batch of events and replace the findings of its cases; the same batch again changes nothing.

    ``detect(evidence, events)`` gives findings with case_id and finding_id from the documents and events of the
    touched cases. Events that repeat an event_id of an earlier batch count once.
    """
    spark = batch.sparkSession
    _bucket(batch, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/events/batch={number}")
    mine = spark.read.parquet(f"{store}/events").where(F.col("batch") == number)
    touched = mine.select("case_id", "bucket").distinct()
    parts = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most as many as there are parts
    if not parts:
        return
    stored = spark.read.parquet(f"{store}/events").where(F.col("bucket").isin(parts) & (F.col("batch") <= number))
    events = stored.join(touched.select("case_id"), "case_id", "left_semi").dropDuplicates(["case_id", "event_id"]).drop("batch", "bucket")
    found = detect(evidence.join(touched.select("case_id"), "case_id", "left_semi"), events)
    rows = _bucket(found, buckets)
    # a part without findings is written, too: a row without an id marks it
    marks = spark.createDataFrame([(b,) for b in parts], "bucket int")
    rows = rows.unionByName(marks, allowMissingColumns=True)
    old = current_before(spark, store, number, parts)
    if old is not None:
        rows = rows.unionByName(old.join(touched.select("case_id"), "case_id", "left_anti"), allowMissingColumns=True)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/findings/version={number}")


def current_before(spark: SparkSession, store: str, number: int, parts: list[int]) -> DataFrame | None:
    """The findings of some parts as they were before a batch."""
    try:
        rows = spark.read.parquet(f"{store}/findings")
    except AnalysisException:
        return None
    rows = rows.where(F.col("bucket").isin(parts) & (F.col("version") < number))
    latest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(latest, ["bucket", "version"], "left_semi").where("finding_id is not null").drop("version")


def findings_stream(events: DataFrame, evidence: DataFrame, store: str, detect: Detect, buckets: int = BUCKETS):
    """Start a query that keeps the findings table of ``store`` up to date with a stream of events; ends with what is there."""
    return (
        events.writeStream.foreachBatch(lambda batch, number: update(batch, number, evidence, store, detect, buckets))
        .option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
    )
