"""Ordered scans within a key: running totals, row index and row shifts (lag/lead).

Two execution strategies, same results:

* ``bucket=None``: a plain window ``partitionBy(key).orderBy(order)``.  Right when the rows per key are
  bounded by construction, e.g. a panel with unique (unit, time) cells has at most #periods rows per
  unit.
* ``bucket=<Column>``: for raw rows where one key may hold a large share of all rows.  The key's
  ordered axis is cut into buckets (the expression must be non-decreasing in ``order``, e.g.
  ``date_trunc('month', ts)``).  The window then runs per (key, bucket), and the bucket prefixes come
  from a window over the per-bucket totals (rows = #buckets, not #rows).  Shifts by one row run inside
  the bucket and only each bucket's boundary row reads its neighbour bucket's last / first row (a
  per-bucket table joined on (key, bucket), which the window already partitioned by); larger shifts
  become an equi-join on (key, row index).  Either way a hot key is spread over all partitions.

A ``bucket`` may also be the name of a column the caller already added: chained scans (shift, then
running totals) then keep one (key, bucket) partitioning instead of re-shuffling per step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _with_bucket(df: DataFrame, bucket) -> tuple[DataFrame, str, list[str]]:
    """(frame with the bucket column, its name, columns to drop at the end)."""
    if isinstance(bucket, str):
        return df, bucket, []
    return df.withColumn(_B, bucket), _B, [_B]


def running_totals(df: DataFrame, part: Sequence[str], order: Sequence, totals: dict[str, Column],
                   bucket: Column | None = None) -> DataFrame:
    """Inclusive running sums of the ``totals`` expressions within ``part`` by ``order``."""
    part = list(part)
    if bucket is None:
        w = Window.partitionBy(*part).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(expr).over(w) for name, expr in totals.items()})

    names = list(totals)
    tmp = {f"__v_{n}": e for n, e in totals.items()}
    d, b, made = _with_bucket(df, bucket)
    d = d.withColumns(tmp)
    w_in = Window.partitionBy(*part, b).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(w_in) for n in names})
    per_bucket = d.groupBy(*part, b).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    w_b = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*part, b, *[
        F.coalesce(F.sum(f"__s_{n}").over(w_b), F.lit(0)).alias(f"__o_{n}") for n in names])
    # as many rows as there are buckets, up to the input's own number: never a broadcast, whatever the estimate
    d = d.join(offsets.hint("merge"), on=[*part, b], how="inner")
    d = d.withColumns({n: F.col(f"__o_{n}") + F.col(f"__r_{n}") for n in names})
    drop = [*made, *tmp, *[f"__r_{n}" for n in names], *[f"__o_{n}" for n in names]]
    return d.drop(*drop)


def row_index(df: DataFrame, part: Sequence[str], order: Sequence, name: str = "row_idx",
              bucket: Column | None = None) -> DataFrame:
    """1-based position of each row within ``part`` by ``order`` (callers pass a total order)."""
    if bucket is None:
        w = Window.partitionBy(*part).orderBy(*_cols(order))
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    return running_totals(df, part, order, {name: F.lit(1).cast("bigint")}, bucket)


def shift_rows(df: DataFrame, part: Sequence[str], order: Sequence, cols: Sequence[str],
               offsets: Sequence[int], bucket: Column | None = None,
               suffix=lambda c, k: f"{c}_lag{k}" if k > 0 else f"{c}_lead{-k}") -> DataFrame:
    """Row-based lag (k > 0) / lead (k < 0) of ``cols``; the first/last rows get NULL."""
    part, cols, offsets = list(part), list(cols), list(offsets)
    if bucket is None:
        w = Window.partitionBy(*part).orderBy(*_cols(order))
        return df.withColumns({suffix(c, k): (F.lag(c, k) if k > 0 else F.lead(c, -k)).over(w)
                               for k in offsets for c in cols})

    if all(abs(k) == 1 for k in offsets):
        return _shift_one(df, part, order, cols, offsets, bucket, suffix)
    idx = "__idx"
    d = row_index(df, part, order, idx, bucket)
    # each source row is sent to the rows that read it: target index = idx + k
    src = (d.select(*part, F.col(idx), *cols)
           .withColumn("__k", F.explode(F.array(*[F.lit(k) for k in offsets])))
           .withColumn(idx, F.col(idx) + F.col("__k")))
    agg = src.groupBy(*part, idx).agg(*[
        F.max(F.when(F.col("__k") == k, F.col(c))).alias(suffix(c, k)) for k in offsets for c in cols])
    # max over at most one matching row per (target, k): it only picks that row's value
    return d.join(agg, on=[*part, idx], how="left").drop(idx)


def _shift_one(df: DataFrame, part: list, order: Sequence, cols: list, offsets: list, bucket, suffix) -> DataFrame:
    """Lag 1 / lead 1 with buckets: shift inside (key, bucket); a bucket's first row takes the previous
    non-empty bucket's last row, its last row the next bucket's first row (per-bucket table, #buckets rows)."""
    d, b, made = _with_bucket(df, bucket)
    w_in = Window.partitionBy(*part, b).orderBy(*_cols(order))
    d = d.withColumns({"__sh_first": F.lag(F.lit(1)).over(w_in).isNull(),
                       "__sh_last": F.lead(F.lit(1)).over(w_in).isNull(),
                       **{f"__sh_{c}_{k}": (F.lag(c) if k > 0 else F.lead(c)).over(w_in)
                          for k in offsets for c in cols}})
    key = F.struct(*_cols(order))
    row = F.struct(*[F.col(c) for c in cols])
    # per-bucket first/last rows: a column-pruned scan aggregated map-side to one row per bucket
    ends = df if not made else df.withColumn(b, bucket)
    ends = ends.groupBy(*part, b).agg(F.min_by(row, key).alias("__sh_head"), F.max_by(row, key).alias("__sh_tail"))
    w_b = Window.partitionBy(*part).orderBy(b)
    edges = ends.select(*part, b, F.lag("__sh_tail").over(w_b).alias("__sh_prev"), F.lead("__sh_head").over(w_b).alias("__sh_next"))
    # a broadcast of all buckets would go through the driver; the window has already dealt and sorted the rows for the merge
    d = d.join(edges.hint("merge"), on=[*part, b], how="left")
    d = d.withColumns({suffix(c, k): (F.when(F.col("__sh_first"), F.col("__sh_prev")[c]) if k > 0
                                      else F.when(F.col("__sh_last"), F.col("__sh_next")[c])).otherwise(F.col(f"__sh_{c}_{k}"))
                       for k in offsets for c in cols})
    return d.drop(*made, "__sh_first", "__sh_last", "__sh_prev", "__sh_next", *[f"__sh_{c}_{k}" for k in offsets for c in cols])
