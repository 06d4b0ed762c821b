"""Balanced (unit, time) panels: grid, chained left joins, zero fill, missingness and key QA.

P1 grid, J1/J2/J4/J5 left joins of sources onto the grid, P6 zero fill, A11 missing rates, X5 key QA.
Keys are parameters: ``unit`` is a list of unit columns, ``time`` one integer period column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.clean import zero_fill


def time_grid(units: DataFrame, time: str, first, last) -> DataFrame:
    """Every unit row times every period ``first..last``.

    ``first``/``last`` may be ints or Columns (e.g. scalar subqueries); the periods are generated per
    unit row with ``explode(sequence())`` -- a generator, not a join, so no pair of large sides meets.
    """
    lo = F.lit(first) if isinstance(first, int) else first
    hi = F.lit(last) if isinstance(last, int) else last
    return units.withColumn(time, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))


def time_bounds_expr(df: DataFrame, time: str):
    """(min, max) of the period column as scalar-subquery Columns: the bounds stay inside the plan
    (Catalyst merges both into one aggregate), no separate job and nothing passes through the driver."""
    return df.select(F.min(time)).scalar(), df.select(F.max(time)).scalar()


def time_bounds(df: DataFrame, time: str) -> tuple[int, int]:
    """Observed (min, max) of the period column: one small aggregate job, two scalars to the driver."""
    row = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    return int(row["lo"]), int(row["hi"])


def left_join_sources(base: DataFrame, keys: Sequence[str], sources: Sequence[DataFrame],
                      zero_fill_cols: Sequence[str] = (), check_unique: bool = False) -> DataFrame:
    """Chain of left joins of per-source tables onto the grid, each source projected first.

    Every source must be unique on ``keys`` (otherwise rows would multiply).  With
    ``check_unique=True`` that is verified (one aggregate per source) and a named error is raised.
    Count columns listed in ``zero_fill_cols`` become 0 when missing; everything else stays NULL (N10).
    """
    keys = list(keys)
    out = base
    for i, src in enumerate(sources):
        if check_unique:
            dup = src.groupBy(*keys).count().where("count > 1").limit(1).count()
            if dup:
                raise ValueError(f"source {i} is not unique on {keys}")
        out = out.join(src, on=keys, how="left")
    if zero_fill_cols:
        out = zero_fill(out, zero_fill_cols)
    return out


def coverage_flags(grid: DataFrame, unit: Sequence[str], time: str, values: DataFrame, value_cols: Sequence[str],
                   known_units: DataFrame, out: str = "coverage_flag",
                   flags: tuple[str, str, str] = ("observed", "missing_no_unit_data", "missing_no_code")) -> DataFrame:
    """Every grid row with ``value_cols`` and why they are there or missing: observed (any value), a known unit without
    data in that period, or a unit that the source does not know.  ``values`` is unique on (unit, time)."""
    unit = list(unit)
    known = known_units.select(*unit).distinct().withColumn("__known", F.lit(True))
    j = grid.join(values.select(*unit, time, *value_cols), [*unit, time], "left").join(known, unit, "left")
    observed = F.coalesce(*[F.col(c).cast("string") for c in value_cols]).isNotNull()
    return j.withColumn(out, F.when(observed, flags[0]).when(F.col("__known"), flags[1]).otherwise(flags[2])).drop("__known")


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None,
                  name_col: str = "column", rate_col: str = "missing_rate") -> DataFrame:
    """Share of NULL (or NaN) per column, one pass, returned in long form (column, rate)."""
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        is_missing = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            is_missing = is_missing | F.isnan(c)
        aggs.append(F.avg(is_missing.cast("double")).alias(c))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as ({name_col}, {rate_col})")


def key_qa(df: DataFrame, unit: Sequence[str], time: str) -> DataFrame:
    """Rows, distinct keys, duplicated keys, units, periods, expected grid rows, missing keys."""
    unit = list(unit)
    per_key = df.groupBy(*unit, time).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_keys"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("bigint").alias("n_duplicate_keys"),
        F.count_distinct(*[F.col(u) for u in unit]).cast("bigint").alias("n_units"),
        F.count_distinct(time).cast("bigint").alias("n_periods"),
    ).withColumn("n_expected", F.col("n_units") * F.col("n_periods")) \
     .withColumn("n_missing_keys", F.col("n_expected") - F.col("n_keys"))


def assert_balanced(df: DataFrame, unit: Sequence[str], time: str) -> None:
    """X5 as an assertion: no duplicate keys and rows = units x periods."""
    r = key_qa(df, unit, time).first()
    if r["n_duplicate_keys"] or r["n_missing_keys"]:
        raise AssertionError(f"panel not balanced: {r.asDict()}")


def dimension_lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, cols: Sequence[str],
                     aliases: DataFrame | None = None) -> DataFrame:
    """Left join of dimension attributes (e.g. code -> name, name -> code), with optional alias rows
    (alias, canonical key) so that variant spellings resolve; unknown keys get NULL attributes.
    The dimension is unique on its key (checked by the caller's data model); AQE broadcasts it when its
    runtime size is small."""
    d = dim.select(F.col(dim_key).alias("__k"), *cols)
    if aliases is not None:
        al = aliases.toDF("__k", "__canon").join(d.withColumnRenamed("__k", "__canon"), on="__canon").drop("__canon")
        d = d.unionByName(al)
    return df.join(d, df[key] == d["__k"], "left").drop("__k")
