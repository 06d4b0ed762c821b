"""Exact medians of many columns without holding a column's distinct values in one task.

``median`` (and ``percentile``) collects every distinct value of a group with its count.  Here a mergeable sketch brackets the
median first, one pass counts the values below the bracket, and only the values inside it (about 4 / ``ACCURACY`` of the
rows, equal ones merged) are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.functions.partitioning import bounded_broadcast

ACCURACY = 10_000  # the sketch's rank error is at most 1 / ACCURACY of the rows


def exact_medians(df: DataFrame, key: str, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """(key, n, median) of the non-null values of every key; the mean of the two middle values where n is even."""
    v = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("__v"))
    away = 2.0 / accuracy
    bracket = (v.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                                  F.percentile_approx("__v", [max(0.0, 0.5 - away), min(1.0, 0.5 + away)], accuracy).alias("__q"))
               .select(key, "n", "__min", "__max", F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi")))
    bracket = bounded_broadcast(bracket)
    at = v.join(bracket, key).groupBy(key).agg(
        F.first("n").alias("n"), F.first("__min").alias("__min"), F.first("__max").alias("__max"),
        F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"),
        F.count_if(F.col("__v") < F.col("__lo")).alias("__below"),
        F.count_if(F.col("__v") <= F.col("__hi")).alias("__upto"))
    # both middle places lie in the bracket by the sketch's bound; were one outside, the whole column is ordered
    first, last = F.expr("(n - 1) div 2"), F.expr("n div 2")
    holds = (F.col("__below") <= first) & (F.col("__upto") > last)
    at = at.select(key, "n", first.alias("__i"), last.alias("__j"), F.when(holds, F.col("__lo")).otherwise(F.col("__min")).alias("__lo"),
                   F.when(holds, F.col("__hi")).otherwise(F.col("__max")).alias("__hi"),
                   F.when(holds, F.col("__below")).otherwise(0).alias("__below"))
    inside = (v.join(bounded_broadcast(at), key).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
              .groupBy(key, "n", "__i", "__j", "__below", "__v").agg(F.count(F.lit(1)).alias("__c")))
    upto = F.col("__below") + F.sum("__c").over(Window.partitionBy(key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    return (inside.withColumn("__upto", upto).groupBy(key, "n")
            .agg((0.5 * F.min(F.when(F.col("__upto") > F.col("__i"), F.col("__v")))
                  + 0.5 * F.min(F.when(F.col("__upto") > F.col("__j"), F.col("__v")))).alias("median")))
