"""Panel features: lags, differences, increase events, treatment cohorts, event time and dummies.

W1 lag 1..k of many columns with ONE window spec, W2 first difference, W3 lag by previous observed
wave (row based), P15 null-safe indicator, A6/J11/G1 treatment cohorts, P16 event time, P17 dummies.

Lags are row based (pandas ``shift``): on an unbalanced panel the previous *row* of the unit, not the
previous period.  On a panel with unique (unit, time) cells a unit has at most #periods rows, so the
per-unit window is bounded; pass ``bucket`` (see ``functions.ordered``) for raw rows with hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.functions.clean import event_term_name, indicator
from panelcraft.functions.ordered import shift_rows


def add_lags(df: DataFrame, unit: Sequence[str], time: str, cols: Sequence[str], lags: Sequence[int] = (1, 2),
             bucket: Column | None = None) -> DataFrame:
    """``{col}_lag{k}`` for every column and lag, one window (or one shift join)."""
    return shift_rows(df, unit, [time], cols, list(lags), bucket=bucket)


def add_diff(df: DataFrame, unit: Sequence[str], time: str, col: str, out: str | None = None,
             event_out: str | None = None, threshold: float = 0.0, threshold_sd: float | None = None) -> DataFrame:
    """W2 (+P15): ``col - lag(col)`` and optionally ``event = coalesce(diff > threshold, false)``.

    With ``threshold_sd = k`` the event is instead ``diff > k * stddev_samp(diff of the unit)`` -- a
    scale-free rule (the noise of a cell mean shrinks as cells grow).  NULL difference is no event (the
    reference's ``NaN > 0`` is False; Spark would order NaN high, so NaN is nulled first).
    """
    out = out or f"{col}_delta"
    w = Window.partitionBy(*unit).orderBy(time)
    x = F.when(~F.isnan(F.col(col)), F.col(col)) if dict(df.dtypes)[col] in ("double", "float") else F.col(col)
    df = df.withColumn(out, x - F.lag(x, 1).over(w))
    if event_out:
        if threshold_sd is None:
            bound = F.lit(threshold)
        else:
            bound = F.lit(float(threshold_sd)) * F.stddev_samp(out).over(Window.partitionBy(*unit))
        df = df.withColumn(event_out, indicator(F.col(out) > bound))
    return df


def treatment_cohorts(df: DataFrame, unit: Sequence[str], time: str, event: str,
                      out: str = "treatment_time") -> DataFrame:
    """First period with ``event = 1`` per unit (units without an event are absent)."""
    return (df.where(F.col(event) == 1).groupBy(*unit).agg(F.min(time).alias(out)))


def add_event_time(df: DataFrame, unit: Sequence[str], time: str, event: str,
                   treat_col: str = "treatment_time", out: str = "event_time") -> DataFrame:
    """G1 = A6 + J11 + P16: first event period of the unit on every row, event time = time - treatment.

    On a panel (unique (unit, time) cells, at most #periods rows per unit) this is a per-unit window
    ``min(time) filter (event = 1)``: the same partitioning as the lag/difference windows before it, and
    no second pass over the panel's source for a join back (``treatment_cohorts`` is the table form).
    """
    first = F.min(F.when(F.col(event) == 1, F.col(time))).over(Window.partitionBy(*unit))
    return df.withColumn(treat_col, first).withColumn(out, F.col(time) - F.col(treat_col))


def add_event_dummies(df: DataFrame, event_time: str = "event_time", treat_col: str = "treatment_time",
                      min_k: int = -5, max_k: int = 5, omit_k: int = -1,
                      bin_endpoints: bool = False) -> tuple[DataFrame, list[str]]:
    """Dummies ``evt_m5 .. evt_p5`` without the omitted period.

    Default: event times outside [min_k, max_k] are 0 in every dummy (N12, pooled with the omitted period
    and never-treated units); ``bin_endpoints=True`` folds them into the end dummies instead.
    """
    names, exprs = [], {}
    for k in range(min_k, max_k + 1):
        if k == omit_k:
            continue
        et = F.col(event_time)
        if bin_endpoints and k == min_k:
            pred = et <= k
        elif bin_endpoints and k == max_k:
            pred = et >= k
        else:
            pred = et == k
        name = event_term_name(k)
        exprs[name] = indicator(pred & F.col(treat_col).isNotNull())
        names.append(name)
    return df.withColumns(exprs), names


def post_indicator(time: str, treat_col: str, out: str = "post") -> Column:
    """``time >= treatment`` with missing treatment = 0."""
    return indicator(F.col(treat_col).isNotNull() & (F.col(time) >= F.col(treat_col))).alias(out)
