"""Sums of arrays that tasks have made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that add up; the driver gets one array from each.
SLOTS = 4


def merged(parts: DataFrame, length: int) -> np.ndarray:
    """The sum of rows of doubles (a binary column ``values``), each of a task.

    They are added up in SLOTS tasks, and the driver adds up what those give, so what
    any of them holds is one array, whatever the number of rows.
    """

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            for x in batch.column("values"):
                values = np.frombuffer(x.as_buffer())
                total = values.copy() if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["values"])

    dealt = parts.withColumn("slot", F.spark_partition_id() % SLOTS).repartition(SLOTS, "slot").select("values")
    rows = dealt.mapInArrow(add, "values binary").collect()
    return sum((np.frombuffer(r.values) for r in rows), np.zeros(length))
