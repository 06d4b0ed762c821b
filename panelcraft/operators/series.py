"""Time-series shaping: annual means, merging several series, long-to-wide, grid counts per topic.

A3 annual mean of monthly/yearly series, J6 full outer merge of series on the key (as one union +
aggregate: one shuffle instead of two full outer joins), A5 per-topic counts on the full grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annual_mean(df: DataFrame, unit: Sequence[str], date: str, value: str, out: str | None = None,
                time: str = "year") -> DataFrame:
    """A3: mean of the non-missing observations per (unit, calendar year)."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*unit, F.year(date).alias(time))
            .agg(F.avg(value).alias(out or value)))


def outer_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of frames that are each unique on ``keys`` and have disjoint value columns.

    Implemented as ``unionByName(allowMissingColumns)`` + one ``groupBy(keys)``: every value column is
    non-missing in at most one frame per key, so ``max`` picks exactly that frame's value.
    """
    keys = list(keys)
    value_cols = []
    for f in frames:
        value_cols += [c for c in f.columns if c not in keys]
    if len(set(value_cols)) != len(value_cols):
        raise ValueError("value columns of the merged frames must be disjoint")
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in value_cols])


def long_to_wide(df: DataFrame, keys: Sequence[str], name_col: str, value_col: str,
                 names: Sequence[str], agg: str = "first") -> DataFrame:
    """Pivot a long (key, series name, value) table with a KNOWN list of names (no extra pass)."""
    g = df.groupBy(*keys).pivot(name_col, list(names))
    return getattr(g, agg)(value_col) if agg != "first" else g.agg(F.first(value_col, ignorenulls=True))


def topic_counts_on_grid(events: DataFrame, grid: DataFrame, keys: Sequence[str], topic_col: str,
                         topics: dict[str, str]) -> DataFrame:
    """A5: count of events per key and topic, one column per topic (``{topic: out_col}``), 0 when none.

    The topic list is given, so the pivot needs no distinct pass; the grid join keeps every key.
    """
    keys = list(keys)
    counts = (events.where(F.col(topic_col).isin(list(topics)))
              .groupBy(*keys).agg(*[F.count_if(F.col(topic_col) == t).alias(c) for t, c in topics.items()]))
    out = grid.join(counts, on=keys, how="left")
    return out.select(*[F.col(c) for c in grid.columns],
                      *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in topics.values()])
