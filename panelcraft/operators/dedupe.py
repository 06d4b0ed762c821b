"""Deduplication and source consolidation.

All "one row per group" operators are aggregates (``max_by``/``min_by`` over a struct of the row,
ordered by a struct of sort keys), not ``row_number`` windows: an aggregate combines map-side, so a
group holding a third of all rows is reduced in every task before the shuffle instead of being sorted
in one task.  Ties are broken by the full sort key the caller passes (Spark has no input order, N13).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.clean import normalize_name


def _ord(xs) -> Column:
    return F.struct(*[F.col(x) if isinstance(x, str) else x for x in xs])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """Per key, the row with the largest ``order`` struct (the last after sorting ascending)."""
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), _ord(order)).alias("__row"))
            .select(*keys, "__row.*"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """Per key, the row with the smallest ``order`` struct (O5 "sort by computed key, take first")."""
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*cols), _ord(order)).alias("__row"))
            .select(*keys, "__row.*"))


def priority_score(col: str, priorities: Mapping[str, int], default: int = 0) -> Column:
    """A CASE WHEN chain from a {value: score} mapping."""
    expr = None
    for v, s in priorities.items():
        expr = F.when(F.col(col) == v, F.lit(s)) if expr is None else expr.when(F.col(col) == v, F.lit(s))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def rule_score(rules: Sequence[tuple[int, Mapping[str, object]]], default: int = 0) -> Column:
    """P23 over several columns: the score of the first rule whose {column: value} all hold; NULL equals nothing."""
    expr = None
    for score, values in rules:
        hit = F.lit(True)
        for c, v in values.items():
            hit = hit & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
        expr = F.when(hit, F.lit(score)) if expr is None else expr.when(hit, F.lit(score))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def consolidate_sources(df: DataFrame, keys: Sequence[str], source_col: str | None,
                        priorities: Mapping[str, int] | Sequence[tuple[int, Mapping[str, object]]],
                        tiebreak: Sequence = (), score_col: str = "priority", default: int = 0) -> DataFrame:
    """Per key the row of the highest priority (then the largest ``tiebreak``).  ``priorities`` maps the values of
    ``source_col`` to scores, or lists rules over several columns (:func:`rule_score`)."""
    score = (priority_score(source_col, priorities, default) if isinstance(priorities, Mapping)
             else rule_score(priorities, default))
    return keep_last(df.withColumn(score_col, score), keys, [score_col, *tiebreak])


def inverse_lookup(dim: DataFrame, name: str, entries: DataFrame, entry_name: str, code: str,
                   aliases: DataFrame | None = None, out: str = "code", count: str | None = None) -> DataFrame:
    """Every member of ``dim`` with the shortest ``code`` (then the smallest) among the entries that bear its name, NULL
    without one.  Names are compared normalised (P3), and ``aliases`` (alias, canonical name) resolve other spellings.
    The entries are aggregated per name first, so a name on a third of them costs a row a task."""
    key = normalize_name(F.col(entry_name))
    e = entries.where(F.col(code).isNotNull()).select(key.alias("__n"), F.col(code).alias("__c"))
    per_name = e.groupBy("__n").agg(F.min_by("__c", F.struct(F.length(F.col("__c").cast("string")), "__c")).alias("__c"),
                                    F.count(F.lit(1)).alias("__k"))
    if aliases is not None:
        al = aliases.toDF("__n", "__canon").select(normalize_name(F.col("__n")).alias("__n"), normalize_name(F.col("__canon")).alias("__canon"))
        per_name = (per_name.join(al.distinct(), "__n", "left").withColumn("__n", F.coalesce("__canon", "__n"))
                    .groupBy("__n").agg(F.min_by("__c", F.struct(F.length(F.col("__c").cast("string")), "__c")).alias("__c"),
                                        F.sum("__k").alias("__k")))
    res = dim.withColumn("__n", normalize_name(F.col(name))).join(per_name, "__n", "left").withColumn(out, F.col("__c"))
    if count:
        res = res.withColumn(count, F.coalesce("__k", F.lit(0)).cast("bigint"))
    return res.drop("__n", "__c", "__k")


def first_last_non_null(df: DataFrame, unit: Sequence[str], time: str, value: str,
                        first: str = "first_value", last: str = "last_value",
                        first_time: str = "first_time", last_time: str = "last_time") -> DataFrame:
    """First and last non-null value per unit in time order, and their times."""
    nn = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return nn.groupBy(*unit).agg(
        F.min_by(value, time).alias(first), F.max_by(value, time).alias(last),
        F.min(time).alias(first_time), F.max(time).alias(last_time))


def latest_per_unit(df: DataFrame, unit: Sequence[str], time: str, cols: Sequence[str]) -> DataFrame:
    """The latest row per unit."""
    return keep_last(df.select(*unit, time, *cols), unit, [time])
