"""Partitioning helpers.

``spread``: CPU-heavy per-row work (regex tokenisation of whole texts, HTML parsing) must not run in
fewer tasks than the cluster has cores.  A scan yields one task per file split / row group; inputs
written as a few large row groups give too few tasks.  ``spread`` adds a round-robin repartition ONLY
when the scan has fewer partitions than the default parallelism -- on well-split inputs (the normal
case at scale) it is a no-op and adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a small dimension, given only when its counted rows allow; beyond that Spark joins by a
    shuffle, with the same result."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
