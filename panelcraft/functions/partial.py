"""Sums of numpy arrays over the rows of a table: a partial array per task, added up by position.

Only arrays of a fixed length leave the tasks, so the driver's share does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partial_sums(df: DataFrame, length: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``add(batch)``, flat arrays of ``length`` numbers, over all Arrow batches of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(length), False
        for batch in batches:
            if batch.num_rows:
                total += add(batch)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = df.mapInArrow(run, "v array<double>")
    out = np.zeros(length)
    for row in parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out
