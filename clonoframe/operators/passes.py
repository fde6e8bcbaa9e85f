"""Sums over all rows by one pass of vectorised tasks, for iterative fits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def added(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all Arrow batches of the flat vectors ``sums(batch)``.

    A task adds up its batches, the tasks' vectors are added up in about sqrt(tasks) tasks and then
    in one, so one vector reaches the driver, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [np.asarray(total, float).tobytes()]})

    parts = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    tasks = parts.getNumPartitions()
    if tasks == 1:
        return parts.first()
    fan = math.isqrt(tasks) if tasks > 16 else 1
    some = parts.mapPartitionsWithIndex(lambda i, vectors: ((i % fan, v) for v in vectors)).reduceByKey(np.add, fan)
    if fan > 1:
        some = some.map(lambda kv: (0, kv[1])).reduceByKey(np.add, 1)
    return some.values().first()
