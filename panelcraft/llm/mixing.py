"""Mixing sources to target weights.

Words are summed per source (combined before the shuffle, so a hot source costs nothing), targets come from
the weights with a cap on repetition, and every document is taken floor(rate) times plus once more when a hash
of its id falls below the fraction.  Only one row per source is ever ordered or broadcast.

Defined results: a null text has size 0; null sources form one source, ordered last; a null doc_id is hashed as
the empty string; repeated rows get the same decision each; further columns are kept; an empty table gives no
rows; if no document has a word, every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)       # of the sources by code point, repeating
MAX_REPEAT = 3            # a source is taken at most so many times
MAX_BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target.  A source whose share exceeds ``max_repeat`` times its size is capped
    there, and the rest is shared again by weight: with the sources ordered by cap / weight, all before the
    first one whose share fits are capped.  Integers decide, so the order of summing has no say."""
    whole = 1
    for w in weights:
        whole *= w
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("at", F.row_number().over(in_order) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("cap_per_weight", F.col("cap") * F.expr(f"{whole} div weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.sum("cap").over(by_cap) + F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_cap) + F.col("weight"))
        .withColumn("fits", F.col("left") * whole <= F.col("cap_per_weight") * F.col("weight_left"))
        .withColumn("level", F.when(F.col("fits"), F.col("left").cast("double") / F.col("weight_left")))
        .withColumn("level", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double"))
                    .otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _uniform(doc_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def with_copies(docs: DataFrame, seed: str = "mix:", **rules) -> DataFrame:
    """``docs`` with its size, its source's size and target, and how often the mix takes it (``copies``).
    The table of targets is broadcast behind a count of the sources; beyond it, it is joined."""
    sized = docs.withColumn("size", size_of(F.col("text")))
    targets = (source_targets(sized.select("source", "size"), **rules)
               .withColumnRenamed("source", "target_source").persist())
    small = targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    joined = sized.join(F.broadcast(targets) if small else targets,
                        F.col("source").eqNullSafe(F.col("target_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(
        rules.get("max_repeat", MAX_REPEAT))))).otherwise(0.0)
    more = (_uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + more).drop("target_source")


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document: what the mix takes of it."""
    mixed = with_copies(docs.select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each as often as it is taken, with its own columns."""
    names = docs.columns
    used = ("doc_id", "source", "text")
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names if c not in used)).alias("row")
    mixed = with_copies(docs.select(*used, rest)).where("copies > 0")
    mixed = mixed.select(*used, "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*(F.col(c) if c in used else F.col(f"row.`{c}`").alias(c) for c in names))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(nth % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM per),
ordered AS (
  SELECT *, cap * (10 // weight) AS cap_per_weight,
    (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights FROM weighed),
lefts AS (
  SELECT *,
    total - (sum(cap) OVER w)::BIGINT + cap AS left_over, weights - (sum(weight) OVER w)::BIGINT + weight AS weight_left
  FROM ordered WINDOW w AS (ORDER BY cap_per_weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, CASE WHEN left_over * 10 <= cap_per_weight * weight_left THEN left_over::DOUBLE / weight_left END AS own FROM lefts),
targets AS (
  SELECT source, source_size, cap, weight,
    first_value(own IGNORE NULLS) OVER (ORDER BY cap_per_weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS level FROM levels),
rates AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE level * weight END AS target FROM targets),
drawn AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source),
counted AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM counted
"""
