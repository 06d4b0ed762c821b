"""Validity intervals and base-period imputation.

``point_in_interval`` is the reference's 51 x 21 Python loop, as a join.  A pure range join would plan as
a nested loop; with the unit key it becomes an equi-join with a residual.  To keep one unit with very
many intervals from landing in one task, an interval is filed under the day blocks of its own length's scale: an interval of
at most 2^l days covers one or two blocks of 2^l days, and a point looks into its block on every scale in use.  A unit's
short intervals so spread over its days, a long one costs two rows, and the residual only compares rows of one
(unit, scale, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def day_scale(start: Column, end: Column) -> Column:
    """The smallest l with 2^l days at least as long as the interval, its last day included."""
    days = F.datediff(end, start)
    return F.when(days <= 0, 0).otherwise(F.length(F.bin(days)))


def day_block(day: Column, scale: Column) -> Column:
    return F.call_function("shiftright", F.unix_date(day.cast("date")), scale)


def point_in_interval(points: DataFrame, intervals: DataFrame, unit: Sequence[str], point: str,
                      start: str, end: str, value: str, out: str = "value",
                      tiebreak: Sequence[str] = (), default: str | Column | None = None,
                      matched_col: str | None = "matched") -> DataFrame:
    """For every point row, the value of the first interval (by start, then ``tiebreak``) with
    ``start <= point <= end`` of the same unit.

    * A matched interval whose value is NULL gives NULL -- the default is NOT used (N8).
    * Only when no interval matched is ``default`` (a column of ``points`` or an expression) used.
    * ``matched_col`` keeps the flag.
    """
    unit = list(unit)
    iv = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    order_key = F.struct(F.col(start), *[F.col(t) for t in tiebreak])
    iv = iv.select(*unit, F.col(start).alias("__s"), F.col(end).alias("__e"),
                   F.col(value).alias("__v"), order_key.alias("__ord"), day_scale(F.col(start), F.col(end)).alias("__l"))
    scales = sorted(r[0] for r in iv.select("__l").distinct().collect())  # about 20: the bits of a number of days
    iv = iv.withColumn("__b", F.explode(F.sequence(day_block(F.col("__s"), F.col("__l")), day_block(F.col("__e"), F.col("__l")))))
    keys = points.select(*unit, F.col(point).alias("__p")).distinct()
    keys = (keys.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in scales]).cast("array<int>")))
            .withColumn("__b", day_block(F.col("__p"), F.col("__l"))))
    # Catalyst's estimate does not see how many rows an explode makes of one, so it would broadcast all points of a small table
    hits = (keys.join(iv.hint("merge"), on=[*unit, "__l", "__b"], how="inner")
            .where((F.col("__s") <= F.col("__p")) & (F.col("__p") <= F.col("__e")))
            .groupBy(*unit, "__p")
            .agg(F.min_by("__v", "__ord").alias("__v"))
            .withColumn("__m", F.lit(True)))
    res = points.join(hits.withColumnRenamed("__p", point), on=[*unit, point], how="left")
    matched = F.coalesce(F.col("__m"), F.lit(False))
    val = F.col("__v")
    if default is not None:
        d = F.col(default) if isinstance(default, str) else default
        val = F.when(matched, F.col("__v")).otherwise(d)
    res = res.withColumn(out, val)
    if matched_col:
        res = res.withColumn(matched_col, matched)
    return res.drop("__v", "__m")


def missing_periods(grid: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid keys that no loaded row covers (left anti join)."""
    keys = list(keys)
    return grid.select(*keys).join(loaded.select(*keys), on=keys, how="left_anti")


def ratio_to_base(series: DataFrame, time: str, value: str, base_time: int, out: str = "ratio") -> DataFrame:
    """Value / value at the base period, per period of a (time, value) series (one row per period).

    The base value is one number (a filtered one-row aggregate fetched as a scalar), so the ratio is a
    projection -- no join at all.
    """
    base = series.where(F.col(time) == base_time).agg(F.first(value, ignorenulls=True)).first()[0]
    b = F.lit(None).cast("double") if base is None else F.lit(float(base))
    return series.select(F.col(time), F.try_divide(F.col(value).cast("double"), b).alias(out))


def impute_from_base(loaded: DataFrame, grid: DataFrame, unit: Sequence[str], time: str, value: str,
                     ratios: DataFrame, base_time: int, ratio_col: str = "ratio",
                     flag_col: str = "imputed") -> DataFrame:
    """Periods missing from ``loaded`` get ``value(unit, base) * ratio(period)``.

    Periods without a ratio stay missing (not produced); the result holds loaded rows (flag 0) and
    imputed rows (flag 1), unique on (unit, time).  The ratio table has one row per period.
    """
    unit = list(unit)
    miss = missing_periods(grid, loaded, [*unit, time])
    base = loaded.where(F.col(time) == base_time).select(*unit, F.col(value).alias("__base"))
    imputed = (miss.join(base, on=unit, how="inner")
               .join(ratios.select(time, ratio_col), on=time, how="inner")
               .select(*unit, time, (F.col("__base") * F.col(ratio_col)).alias(value),
                       F.lit(1).alias(flag_col)))
    kept = loaded.select(*unit, time, value, F.lit(0).alias(flag_col))
    return kept.unionByName(imputed)
