"""Session helpers. On a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows dealt out by document stay where they are when joined by case, owner and document
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def local_session(cores: str | None = None, partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName("factloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.maxResultSize", "4g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Only for the detectors' wide plans, whose many derived columns make inferring filters take minutes.
WIDE_PLANS = {"spark.sql.constraintPropagation.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on (UTC times, adaptive plans)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    A session that runs in one process (local mode: tests, the benchmark) and names none gets
    a temporary folder; on a cluster the missing setting is an error, as executors share no disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _own_folders[context.applicationId]


def write_shared(df: DataFrame, name: str) -> str:
    """Write a table to the shared folder and return its path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as a table and read them back.

    Columnar, so later steps still prune columns, and it survives lost executors.
    """
    return df.sparkSession.read.parquet(write_shared(df, name))
