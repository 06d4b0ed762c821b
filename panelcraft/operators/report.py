"""Result tables of the reports and figures.

All inputs are DataFrames and all outputs are small DataFrames; sorting happens only where the sort
is the feature (a top-k list, a figure's order) and always with a full tie-break key (N13).
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def coverage_long(df: DataFrame, unit: Sequence[str], time: str, value_cols: Sequence[str] = ()) -> DataFrame:
    """A10: (metric, value) rows: n_rows, n_units, first/last period, non-missing count per column."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n_rows"),
            F.count_distinct(*[F.col(u) for u in unit]).cast("double").alias("n_units"),
            F.min(time).cast("double").alias("first_period"), F.max(time).cast("double").alias("last_period")]
    aggs += [F.count(c).cast("double").alias(f"n_observed_{c}") for c in value_cols]
    wide = df.agg(*aggs)
    names = wide.columns
    return wide.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (metric, value)")


def top_and_bottom(df: DataFrame, value: str, key: Sequence[str], k: int = 5,
                   labels: tuple[str, str] = ("largest_decrease", "largest_increase"), label_col: str = "grp") -> DataFrame:
    """The k smallest and the k largest rows by ``value`` (ties by ``key``), labelled and united.
    Each side is a TakeOrdered (per-partition top-k, then a k-row merge)."""
    nn = df.where(F.col(value).isNotNull())
    low = nn.orderBy(F.asc(value), *key).limit(k).withColumn(label_col, F.lit(labels[0]))
    high = nn.orderBy(F.desc(value), *key).limit(k).withColumn(label_col, F.lit(labels[1]))
    return low.unionByName(high)


def model_comparison(evals: DataFrame, score: str = "test_rmse") -> DataFrame:
    """Label ``task | model`` and the score, sorted by task then score (then model)."""
    return (evals.select(F.concat_ws(" | ", "task", "model").alias("label"), "task", "model", score)
            .orderBy("task", score, "model"))


def best_per_group(evals: DataFrame, group: Sequence[str], score: str, tiebreak: Sequence[str]) -> DataFrame:
    """A8 (whole rows, unlike the reference's per-column first, H10)."""
    from panelcraft.operators.dedupe import keep_first
    return keep_first(evals, group, [score, *tiebreak])


def unit_change(df: DataFrame, unit: Sequence[str], time: str, value: str) -> DataFrame:
    """First and last non-missing value per unit and their difference (one aggregation)."""
    from panelcraft.operators.dedupe import first_last_non_null
    return (first_last_non_null(df, unit, time, value, "early", "latest", "early_time", "latest_time")
            .withColumn("delta", F.col("latest") - F.col("early")))


def change_between_ends(df: DataFrame, unit: Sequence[str], time: str, value: str, base: str = "rate_base",
                        latest: str = "rate_latest", delta: str = "delta") -> DataFrame:
    """R2/J7 for the map: the units with a row in the panel's first AND last period, and the change between these two
    values (missing where one of them is).  One aggregation; the two periods are one row fetched before it."""
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    t = F.col(time)
    ends = (df.where((t == F.lit(lo)) | (t == F.lit(hi))).groupBy(*unit)
            .agg(F.max(F.when(t == F.lit(lo), F.col(value))).alias(base), F.max(F.when(t == F.lit(hi), F.col(value))).alias(latest),
                 F.bool_or(t == F.lit(lo)).alias("__a"), F.bool_or(t == F.lit(hi)).alias("__z")))
    return ends.where("__a AND __z").drop("__a", "__z").withColumn(delta, F.col(latest) - F.col(base))


def counts_by(df: DataFrame, cols: Sequence[str], out: str = "rows") -> DataFrame:
    """Rows per combination of columns, e.g. (source, flag); combinations with a missing part are left out."""
    return df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def report_tables(panel: DataFrame, waves: DataFrame, coefs: DataFrame, summary: DataFrame, evals: DataFrame, unit: str, time: str,
                  rate: str, wave_value: str, wave_source: str = "source", wave_flag: str = "coverage_flag",
                  outcome: str | None = None) -> dict[str, DataFrame]:
    """The six tables of the long report: coverage, causal (summary), event (of ``outcome``, else of all), models,
    state_change (five largest falls and rises of a unit's first and last known rate) and wave_coverage."""
    n = F.col("n_rows").cast("string")
    main = panel.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(unit).alias("n_units"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    wave = waves.agg(F.count(F.lit(1)).alias("n_rows"), F.count(wave_value).alias("n_obs"))
    pairs = lambda *rows: F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows]))
    span = F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))
    coverage = (main.select(pairs(("rows", n), ("units", F.col("n_units").cast("string")), ("periods", span)).alias("r"))
                .unionByName(wave.select(pairs(("wave_rows", n), ("wave_observations", F.col("n_obs").cast("string"))).alias("r"))).select("r.*"))
    event = coefs if outcome is None else coefs.where(F.col("outcome") == outcome)
    ends = top_and_bottom(unit_change(panel, [unit], time, rate), "delta", [unit], 5, ("most_improved", "most_worsened"))
    return {
        "coverage": coverage,
        "causal": summary.select("outcome", "nobs", "r2", "pretrend_pvalue", "placebo_mean", "placebo_std"),
        "event": event.select("event_time", "coef", "ci_low", "ci_high", "p_value").orderBy("event_time"),
        "models": evals.select("task", "model", "test_rmse", "test_mae", "test_r2").orderBy("task", "test_rmse", "model"),
        "state_change": ends.select("grp", unit, "early", "latest", "delta"),
        "wave_coverage": counts_by(waves, [wave_source, wave_flag]),
    }


def mean_post_effect(coefs: DataFrame, event_time: str = "event_time", coef: str = "coef") -> float | None:
    """Mean coefficient over event times >= 0 (one scalar)."""
    return coefs.where(F.col(event_time) >= 0).agg(F.avg(coef)).first()[0]


def scenarios(latest: DataFrame, value: str, effect: float | None, scenario_table: Sequence[tuple[str, float]],
              out: str = "projected") -> DataFrame:
    """``max(0, latest + effect * sign(change))`` for every unit and scenario (scenarios are a
    generated array per unit row, not a join).  A missing effect (None or NaN) counts as 0; a missing value stays so."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(c)).alias("change")) for n, c in scenario_table])
    s = latest.withColumn("__s", F.explode(arr)).select("*", "__s.*").drop("__s")
    eff = F.lit(0.0 if effect is None or effect != effect else float(effect))
    projected = F.greatest(F.lit(0.0), F.col(value) + eff * F.signum(F.col("change")))
    return s.withColumn(out, F.when(F.col(value).isNotNull(), projected))


def event_plot_data(coefs: DataFrame) -> DataFrame:
    """Error-bar lengths of an event-study table."""
    return coefs.select("event_time", "coef", (F.col("coef") - F.col("ci_low")).alias("err_low"),
                        (F.col("ci_high") - F.col("coef")).alias("err_high")).orderBy("event_time")


def run_status(spark: SparkSession, step: str, fn: Callable[[], object]) -> tuple[object, DataFrame]:
    """Run a step; return (result or None, one-row status table: step, status ok/failed, message).
    A failing optional step becomes a status row instead of failing the pipeline."""
    try:
        res = fn()
        return res, spark.createDataFrame([(step, "ok", None)], "step string, status string, message string")
    except Exception as e:  # noqa: BLE001 - the status row is the report of the failure
        msg = f"{type(e).__name__}: {e}".splitlines()[0]
        tb = traceback.format_exc(limit=2).splitlines()[-1]
        return None, spark.createDataFrame([(step, "failed", f"{msg} | {tb}")], "step string, status string, message string")
