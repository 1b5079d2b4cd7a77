"""Arrow batches for operators whose inner work runs in Python tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.session import prepare

#: Rows and bytes of one Arrow batch: what a Python task holds at a time follows these, not the table.
ROWS_PER_BATCH = 256
BYTES_PER_BATCH = 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: UTC, adaptive plans and bounded Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns replaced in place, or added at its end."""
    names, columns = list(batch.schema.names), list(batch.columns)
    for name, values in new.items():
        if name in names:
            columns[names.index(name)] = values
        else:
            names.append(name)
            columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)


def schema_with(df: DataFrame, **added: str) -> str:
    """DDL of the frame's columns with some replaced or added."""
    parts = {f.name: f.dataType.simpleString() for f in df.schema.fields} | added
    return ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in parts.items())
