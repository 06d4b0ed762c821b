"""The reference's three entries as DataFrame -> DataFrame plans, key columns as
parameters.  Nothing is written unless a sink path is given; Catalyst sees each entry as one plan and
a job starts only at a sink, a small collect of scalars, or the Gram collects of the regressions.

1. ``parse_policy_pages`` + ``build_panel``: pages -> blocks -> current values and intervals ->
   (unit, time) values; event pages -> events -> per-topic counts; sources joined onto the grid.
2. ``features`` + ``causal``: differences, increase events, lags; event study, placebo, ATT(g, t).
3. ``text_embeddings`` + ``predict``: text panel -> TF-IDF -> SVD vectors -> model ladder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.clean import jan_first, rate_per
from panelcraft.operators.intervals import point_in_interval
from panelcraft.operators.panel import left_join_sources, missing_rates, time_grid
from panelcraft.operators.segment import (block_fields, current_values, interval_values, line_tokens,
                                          segment_blocks, timeline_events)
from panelcraft.operators.series import topic_counts_on_grid


# ------------------------------------------------------------------------------------------------
# entry 1: data
# ------------------------------------------------------------------------------------------------


def parse_policy_pages(value_pages: DataFrame, interval_pages: DataFrame, names: DataFrame, first: int, last: int,
                       page: str = "page_id", text: str = "text", value_col: str = "value") -> DataFrame:
    """Pages with per-unit blocks -> (unit, unit_name, year, value, matched) on the unit x year grid.

    Value of a year = the value of the first interval (by start) containing Jan 1; a matched interval
    with a missing value stays missing; units/years without an interval get the current value (N8/N9).
    """
    cur = current_values(block_fields(segment_blocks(line_tokens(value_pages, page, text), [page], "pos", "token",
                                                     names), [page], "pos", "token"), [page, "block_no"])
    ivs = interval_values(block_fields(segment_blocks(line_tokens(interval_pages, page, text), [page], "pos",
                                                      "token", names), [page], "pos", "token"))
    units = names.select(F.col("code").alias("unit"), F.col("name").alias("unit_name"))
    grid = time_grid(units, "year", first, last).withColumn("__p", jan_first("year"))
    # a unit of several blocks keeps the last one
    cur1 = cur.groupBy("unit").agg(F.max_by("value", F.struct(page, "block_no")).alias("__default"))
    pts = grid.join(cur1, on="unit", how="left")
    res = point_in_interval(pts, ivs, ["unit"], "__p", "start_dt", "end_dt", "value", out=value_col,
                            tiebreak=["end_dt"], default="__default")
    return res.select("unit", "unit_name", "year", value_col, "matched")


def policy_event_counts(timeline_pages: DataFrame, names: DataFrame, topics: Mapping[str, str], first: int,
                        last: int, page: str = "page_id", text: str = "text", topic_col: str = "topic",
                        dedupe: bool = False, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """F1 events of all topic pages and A5 per-topic counts on the unit x year grid.  ``aliases`` (alias, name) resolve
    other spellings of a unit's name (P3).

    ``dedupe=True`` counts each (topic, unit, date) once; the default keeps the reference's repeated
    rows (H1)."""
    ev = timeline_events(timeline_pages, page, text, names, topic_col, first, last, aliases=aliases)
    if dedupe:
        ev = ev.dropDuplicates(["topic_key", "unit", "effective_date"])
    grid = time_grid(names.select(F.col("code").alias("unit")), "year", first, last)
    counts = topic_counts_on_grid(ev, grid, ["unit", "year"], "topic_key", dict(topics))
    return ev, counts


def build_panel(units: DataFrame, unit: Sequence[str], time: str, first: int, last: int,
                sources: Sequence[DataFrame], zero_fill: Sequence[str] = (),
                rates: Mapping[str, tuple[str, str, float, float]] | None = None,
                check_unique: bool = True) -> tuple[DataFrame, DataFrame]:
    """P1 grid + J1 left joins + P6 zero fill + P7 rates; returns (panel, missingness).

    ``rates`` maps an output column to (numerator, denominator, per, denominator scale).
    """
    grid = time_grid(units, time, first, last)
    panel = left_join_sources(grid, [*unit, time], sources, zero_fill, check_unique=check_unique)
    for out, (num, den, per, scale) in (rates or {}).items():
        panel = panel.withColumn(out, rate_per(num, den, per, scale))
    return panel, missing_rates(panel)


# ------------------------------------------------------------------------------------------------
# entry 2: features and causal
# ------------------------------------------------------------------------------------------------


def features(panel: DataFrame, unit: Sequence[str], time: str, treatment_value: str, lag_cols: Sequence[str],
             lags: Sequence[int] = (1, 2)) -> DataFrame:
    from panelcraft.operators.features import add_diff, add_lags
    p = add_diff(panel, unit, time, treatment_value, f"{treatment_value}_delta", f"{treatment_value}_increase_event")
    return add_lags(p, unit, time, lag_cols, lags)


def wave_features(waves: DataFrame, panel: DataFrame, unit: Sequence[str], time: str, context: Sequence[str],
                  lag_cols: Sequence[str]) -> DataFrame:
    """A wave panel (fewer periods than the main one) with the main panel's ``context`` columns of the same cell, and
    each unit's value of the wave before."""
    from panelcraft.operators.features import add_lags
    joined = left_join_sources(waves, [*unit, time], [panel.select(*unit, time, *context)])
    return add_lags(joined, list(unit), time, list(lag_cols), [1])


def causal(feat: DataFrame, unit: str, time: str, event: str, outcomes: Sequence[str], covariates: Sequence[str],
           n_draws: int = 100, seed: int = 42, n_boot: int = 999) -> dict[str, DataFrame]:
    """Event study + placebo per outcome (rows with a missing outcome/covariate dropped first), summary
    table, and per outcome the doubly robust effects by event time given the covariates, with standard errors and the
    critical value of the uniform band (``att_dynamic``)."""
    from panelcraft.operators.did import att_dynamic_dr
    from panelcraft.operators.features import add_event_time
    from panelcraft.operators.regression import event_study, hash_assignments, placebo_coefficients

    spark = feat.sparkSession
    d = add_event_time(feat, [unit], time, event, "treatment_time", "event_time")
    events, summaries, atts = [], [], []
    for y in outcomes:
        sub = d.dropna(subset=[y, *covariates])
        table, s = event_study(sub, y, covariates, [unit], time)
        treated = sub.where(F.col("treatment_time").isNotNull()).select(unit)
        draws = hash_assignments(treated, unit, sub.select(time), time, n_draws, seed)
        pl = placebo_coefficients(sub, y, covariates, unit, time, draws)
        st = pl.agg(F.avg("coef").alias("m"), F.stddev_samp("coef").alias("s")).first()
        events.append(table)
        summaries.append((y, s["nobs"], s["r2"], s["pretrend_pvalue"], st["m"], st["s"]))
        dyn = att_dynamic_dr(sub, unit, time, y, "treatment_time", covariates, n_boot=n_boot, seed=seed)
        atts.append(dyn.withColumn("outcome", F.lit(y)))
    ev = events[0]
    for t in events[1:]:
        ev = ev.unionByName(t)
    at = atts[0]
    for t in atts[1:]:
        at = at.unionByName(t)
    summary = spark.createDataFrame(summaries, "outcome string, nobs double, r2 double, pretrend_pvalue double, "
                                               "placebo_mean double, placebo_std double")
    return {"event_study": ev, "summary": summary, "att_dynamic": at}


# ------------------------------------------------------------------------------------------------
# entry 3: text embeddings and prediction
# ------------------------------------------------------------------------------------------------


def text_embeddings(grid: DataFrame, events: DataFrame, keys: Sequence[str], text: F.Column, order: Sequence,
                    default: str, max_features: int = 2048, dims: int = 64, encoder=None,
                    meta: dict | None = None) -> DataFrame:
    """T1 text panel -> embedding.  T6: a caller's ``encoder`` (list[str] -> vectors, run per Arrow batch)
    is tried first; without one, or if it fails, T2 TF-IDF + T3 SVD is the fallback.  ``meta`` (a dict)
    receives the encoder name and the dimension (S7 writes it with ``write_json_meta``)."""
    if encoder is not None:
        from panelcraft.operators.text import encode_batches, text_panel
        from panelcraft.session import cut_lineage
        try:
            tp = text_panel(grid, events, list(keys), text, order, default)
            out = cut_lineage(encode_batches(tp, "policy_text", encoder))  # every row is encoded before the decision
            widths = [r[0] for r in out.select(F.size("embedding")).distinct().limit(2).collect()]
            if len(widths) > 1:
                raise ValueError("the encoder returned vectors of unequal widths")
            if meta is not None:
                meta.update({"encoder": getattr(encoder, "__name__", "custom"), "n_dims": widths[0] if widths else 0})
            return out
        except Exception as e:  # noqa: BLE001 - any encoder failure selects the built-in fallback (T6)
            if meta is not None:
                meta["encoder_error"] = f"{type(e).__name__}: {e}"
    if meta is not None:
        meta.update({"encoder": "tfidf_svd_fallback"})
    return _tfidf_svd_embeddings(grid, events, keys, text, order, default, max_features, dims, meta)


def _tfidf_svd_embeddings(grid, events, keys, text, order, default, max_features, dims, meta) -> DataFrame:
    from panelcraft.operators.regression import sparse_svd_project
    from panelcraft.operators.text import text_panel, tfidf_vectors
    from panelcraft.session import cut_lineage

    tp = cut_lineage(text_panel(grid, events, list(keys), text, order, default))  # read by the vocabulary and the counts
    rows, vocab = tfidf_vectors(tp, "policy_text", max_features)
    p = vocab.count()
    k = min(dims, max(2, p - 1))
    if meta is not None:
        meta["n_dims"] = k
    return sparse_svd_project(rows, "tfidf", max(p, 1), k)[0]


def predict(panel: DataFrame, features_: Sequence[str], target: str, keys: Sequence[str], time: str, task: str,
            train, val, test, models: dict | None = None, vectors: DataFrame | None = None):
    """Entry 3's second half.  ``vectors`` is a table of the keys and one array column, e.g. from ``text_embeddings``:
    it is joined to the panel (J3), and its entries are features beside the scalar ones (M11)."""
    from panelcraft.operators.predict import join_vectors, model_ladder, split_with_fallback
    panel = panel.where(F.col(target).isNotNull())  # rows without a target have no say in the split
    arrays = []
    if vectors is not None:
        arrays = [f.name for f in vectors.schema.fields if f.dataType.typeName() == "array"]
        panel = join_vectors(panel, vectors.select(*keys, *arrays), keys)
    s = split_with_fallback(panel, time, train, val, test)
    return model_ladder(s, features_, target, keys, task, models=models, vectors=arrays)
