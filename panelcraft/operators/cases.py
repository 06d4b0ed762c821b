"""Case-level flags and flagged sums.

The reference finds the distinct cases that have at least one qualifying detail row (a drinking driver,
an impaired driver), inner-joins them to the case table and sums per group, once per flag, then joins
the per-flag totals.  Here every flag comes out of ONE aggregation over the detail table (``bool_or``
with map-side combine, so a hot case key costs nothing extra), is joined once to the case table, and all
totals come out of ONE conditional aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.partitioning import bounded_broadcast


def existence_flags(detail: DataFrame, case_key: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Per case key, whether ANY detail row satisfies each predicate (NULL predicate = false).

    Rows that satisfy no predicate are filtered before the shuffle, so only candidate rows move.
    """
    case_key = list(case_key)
    preds = {n: F.coalesce(p, F.lit(False)) for n, p in flags.items()}
    # the pre-filter uses the raw predicates so that it reaches the scan (PushedFilters / row-group
    # skipping); a NULL predicate drops the row exactly like false
    any_pred = None
    for p in flags.values():
        any_pred = p if any_pred is None else (any_pred | p)
    return (detail.where(any_pred)
            .groupBy(*case_key)
            .agg(*[F.bool_or(p).alias(n) for n, p in preds.items()]))


def flagged_sums(cases: DataFrame, case_key: Sequence[str], group: Sequence[str], value: str | Column,
                 flags: DataFrame, flag_names: Sequence[str], total_name: str = "total",
                 out_names: Mapping[str, str] | None = None, fill_zero: bool = True,
                 count_name: str | None = None) -> DataFrame:
    """A2: per group, total of ``value`` and the totals restricted to flagged cases, side by side.

    ``flags`` is the output of :func:`existence_flags` (unique on ``case_key``), so the left join
    cannot multiply case rows.  Totals of groups without any flagged case are 0 (``fill_zero``).
    """
    out_names = dict(out_names or {})
    v = F.col(value) if isinstance(value, str) else value
    joined = cases.join(flags, on=list(case_key), how="left")
    aggs = [F.sum(v).alias(total_name)]
    if count_name:
        aggs.append(F.count(F.lit(1)).alias(count_name))
    for f in flag_names:
        s = F.sum(F.when(F.coalesce(F.col(f), F.lit(False)), v))
        if fill_zero:
            s = F.coalesce(s, F.lit(0).cast("double") if _is_fractional(joined, v) else F.lit(0))
        aggs.append(s.alias(out_names.get(f, f"{total_name}_{f}")))
    return joined.groupBy(*group).agg(*aggs)


def _is_fractional(df: DataFrame, c: Column) -> bool:
    try:
        return df.select(c).dtypes[0][1] in ("double", "float") or df.select(c).dtypes[0][1].startswith("decimal")
    except Exception:  # noqa: BLE001 - expression without a resolvable type: keep integral zero
        return False


def thresholds_by_period(thresholds: DataFrame, period: str, first: str = "period_from", last: str = "period_to") -> DataFrame:
    """A table of coding rules (first, last, lo, hi) as one row per period, so that it joins on the period by equality
    instead of by a range; where rules overlap the one that begins last holds."""
    per = thresholds.withColumn(period, F.explode(F.sequence(F.col(first).cast("int"), F.col(last).cast("int"))))
    rest = [c for c in thresholds.columns if c not in (first, last)]
    return per.groupBy(period).agg(F.max_by(F.struct(*rest), F.struct(first, last)).alias("__r")).select(period, "__r.*")


def flags_by_period(detail: DataFrame, case_key: Sequence[str], code: str, period: str, thresholds: DataFrame,
                    flag: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """J9 with P12: per case key, whether any detail row's code lies in the range of its period.  ``thresholds`` is unique
    on the period (see :func:`thresholds_by_period`), one row per period; a period without a rule flags nothing."""
    joined = detail.join(bounded_broadcast(thresholds.select(period, F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))), period)
    return existence_flags(joined, case_key, {flag: F.col(code).between(F.col("__lo"), F.col("__hi"))})
